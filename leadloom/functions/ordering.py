"""Orders and keys that differ from Spark's own: enum ranks, nulls last, canonical JSON text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_rank(column: Column, values: Sequence[str]) -> Column:
    """1 for the first declared value; null for null and for a value outside the domain."""
    place = F.array_position(F.array(*(F.lit(v) for v in values)), column)
    return F.when(place > 0, place)


def by_enum(column: Column, values: Sequence[str]) -> Column:
    """Ascending in declared order, nulls last."""
    return enum_rank(column, values).asc_nulls_last()


def canonical_key(dimension: Column) -> Column:
    """One text for equal string maps: entries by length of key, then key, as ``{"a": "1", "bb": "2"}``.

    A null map is null, an empty one ``{}``; null values are written as null.
    """
    entries = F.transform(F.map_entries(dimension), lambda e: F.struct(F.octet_length(e["key"]).alias("size"), e["key"].alias("key"), e["value"].alias("value")))
    parts = F.transform(
        F.array_sort(entries),
        lambda e: F.concat(_quoted(e["key"]), F.lit(": "), F.coalesce(_quoted(e["value"]), F.lit("null"))),
    )
    return F.when(dimension.isNotNull(), F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")))


_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and what is below a blank are escaped."""
    escaped = F.regexp_replace(text, r'(["\\])', r"\\$1")
    clean = escaped
    for code in range(32):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(_ESCAPES.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(escaped.rlike(r"[\x00-\x1f]"), clean).otherwise(escaped), F.lit('"'))


#: A string, and a container that holds no other, of JSON text.  Possessive, so that long ones need no stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_INNER = r"[\[{][^\[\]{}]*+[\]}]"
#: What stands for the brackets and separators of a finished container, so that the next one out is found.
_DONE = {c: chr(0xE000 + k) for k, c in enumerate("[]{},:")}


def _bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _number(text: Column) -> Column:
    """A JSON number in plain digits as they were written, without the sign of a zero."""

    def plain(x: Column) -> Column:
        digits = F.concat(x["whole"], x["part"])
        point = F.length(x["whole"]) + F.when(x["power"] == "", 0).otherwise(x["power"].cast("int"))
        after = F.length(digits) - point
        shifted = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(after <= 0, F.concat(digits, F.repeat(F.lit("0"), -after)))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, after)))
        )
        return F.concat(F.when(digits.rlike("[1-9]"), x["sign"]).otherwise(""), F.regexp_replace(shifted, r"^0+(?=[0-9])", ""))

    found = {name: F.regexp_extract(text, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([-+]?[0-9]+))?$", k) for k, name in enumerate(("sign", "whole", "part", "power"), 1)}
    odd = text.startswith("-0") | text.contains("e") | text.contains("E")
    return F.when(odd, _bound(F.struct(*(c.alias(n) for n, c in found.items())), plain)).otherwise(text)


def _atom(text: Column) -> Column:
    return F.when(F.substring(text, 1, 1).isin(*"-0123456789"), _number(text)).otherwise(text)


def _container(text: Column, strings: Column) -> Column:
    """An array or object of finished values: an object's entries by the length of their key in bytes, then its bytes; of equal keys the last stays."""
    items = F.filter(F.split(F.substring(text, F.lit(2), F.length(text) - 2), ",", -1), lambda x: x != "")

    def entry(item: Column, place: Column) -> Column:
        """An entry ``"number":value`` under the string of that number."""
        quoted = F.substring_index(item, ":", 1)
        name = F.get(strings, F.substring(quoted, F.lit(2), F.length(quoted) - 2).cast("int"))
        value = F.transform(F.array(F.substring_index(item, ":", -1)), _atom)
        return F.struct(F.octet_length(name).alias("size"), name.alias("name"), place.alias("place"), F.concat(quoted, F.lit(_DONE[":"] + " "), F.get(value, F.lit(0))).alias("text"))

    def last(entries: Column) -> Column:
        return F.filter(entries, lambda e, k: F.coalesce(F.get(entries, k + 1)["name"] != e["name"], F.lit(True)))

    listed = F.transform(_bound(F.array_sort(F.transform(items, entry)), last), lambda e: e["text"])
    comma = _DONE[","] + " "
    array = F.concat(F.lit(_DONE["["]), F.array_join(F.transform(items, _atom), comma), F.lit(_DONE["]"]))
    return F.when(text.startswith("["), array).otherwise(F.concat(F.lit(_DONE["{"]), F.array_join(listed, comma), F.lit(_DONE["}"])))


def _between(pieces: Column, found: Column) -> Column:
    """The pieces of a split with what has been found between them."""
    return F.array_join(F.zip_with(pieces, found, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")


def json_key(value: Column) -> Column:
    """One text for equal JSON values, given as JSON text: any nesting; null for null, and text that is no JSON raises.

    Strings are set aside, then containers are rebuilt from the innermost level outwards, as often as
    they are nested.  Numbers keep the digits that the text has; Spark's variant type has none of a
    decimal's last zeros.  SQL functions alone, so it runs in the JVM.
    """

    def finish(skeleton: Column, strings: Column) -> Column:
        def outward(text: Column, _: Column) -> Column:
            made = F.transform(F.regexp_extract_all(text, F.lit(_INNER), F.lit(0)), lambda c: _container(c, strings))
            return _between(F.split(text, _INNER, -1), made)

        brackets = F.split(F.regexp_replace(skeleton, r"[^\[\]{}]", ""), "")
        zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

        def nested(depth: Column, c: Column) -> Column:
            now = depth["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
            return F.struct(now.alias("now"), F.greatest(depth["most"], now).alias("most"))

        levels = F.aggregate(brackets, zero, nested, lambda d: d["most"])
        steps = F.filter(F.sequence(F.lit(0), levels), lambda k: k > 0)
        built = F.translate(_atom(F.aggregate(steps, skeleton, outward)), "".join(_DONE.values()), "".join(_DONE))
        # Outside and inside of quotes take turns; inside stands a string's number.
        parts = F.transform(F.split(built, '"', -1), lambda p, k: F.when(k % 2 == 1, _bound(F.get(strings, p.cast("int")), _quoted)).otherwise(p))
        return F.array_join(parts, "")

    def key(text: Column) -> Column:
        strings = F.from_json(F.concat(F.lit("["), F.array_join(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), ","), F.lit("]")), "array<string>")
        pieces = F.split(F.regexp_replace(F.regexp_replace(text, _STRING, '"'), "[ \t\n\r]+", ""), '"', -1)
        numbers = F.transform(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), lambda _, k: F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
        skeleton = _between(pieces, numbers)
        return _bound(F.struct(skeleton.alias("skeleton"), strings.alias("strings")), lambda x: finish(x["skeleton"], x["strings"]))

    def checked(text: Column) -> Column:
        one = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1
        return F.when(one, key(text)).when(text.isNotNull(), F.raise_error(F.concat(F.lit("MALFORMED JSON: "), F.left(text, F.lit(100)))))

    return _bound(value, checked)
