import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from leadloom.llm import chatrepair
from tests.conftest import SF

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Sorted rows (turn, role, text) -> their first faults."""
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows, found):
    """The cheapest edits of a few rows by trying all, with up to two rows inserted anywhere."""
    best = None
    gap = [()] + [(r,) for r in "ua"] + list(itertools.product("ua", repeat=2))
    edits = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in found]
    for chosen in itertools.product(*edits):
        for ins in itertools.product(gap, repeat=len(rows) + 1):
            roles, audit, cost, out = "", "", 0, []
            for k in range(len(rows) + 1):
                for r in ins[k]:
                    roles, audit, cost = roles + r, audit + "I", cost + 5
                    out.append(({"u": "user", "a": "assistant"}[r], ""))
                if k == len(rows):
                    break
                e, (_, role, text) = chosen[k], rows[k]
                if e != "D":
                    role = role if e == "K" else {"u": "user", "a": "assistant"}[e]
                    roles, cost = roles + (role[:1] or "-"), cost + 5 * (found[k] == "truncated")
                    out.append((role, text))
                audit += e if e in "DK" else "R"
                cost += {"D": 2, "K": 0}.get(e, 1)
            if re.fullmatch("(s?(ua)+)?", roles):
                key = (cost, audit, "\n".join(f"{a}:{b}" for a, b in out))
                best = key if best is None else min(best, key)
    return best


def stepwise(rows, found):
    """The same by strings from the last row on, for rows of any number."""
    after = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    given = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))

    def grown(out):
        """With rows inserted, up to three: more than can pay."""
        for _ in range(3):
            more = [out[t] and (out[t][0] + 5, "I" + out[t][1], ((role, ""), *out[t][2])) for t, role in given]
            out = [min((w for w in pair if w), key=lambda w: w[:2], default=None) for pair in zip(out, more)]
        return out

    best = grown([(0, "", ()), None, None, (0, "", ())])
    for (_, role, text), fault in zip(reversed(rows), reversed(found)):
        new, late = [], 5 * (fault == "truncated")
        for s in range(4):
            ways = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                if (t := after[s].get(role[:1])) is not None:
                    ways.append((best[t][0] + late, "K" + best[t][1], ((role, text), *best[t][2])))
                t, name = given[s]
                ways.append((best[t][0] + late + 1, "R" + best[t][1], ((name, text), *best[t][2])))
            new.append(min(ways, key=lambda x: x[:2]))
        best = grown(new)
    cost, audit, out = best[0]
    return cost, audit, "\n".join(f"{a}:{b}" for a, b in out)


def facts(rows):
    turns = [t for t, _, _ in rows if t is not None]
    found = faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))


def ordered(rows):
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute(rows):
    """Rows (conv_id, turn, role, text) -> by conversation what ``repair`` returns."""
    by = defaultdict(list)
    for c, *row in rows:
        by[c].append(tuple(row))
    out = {}
    for c, own in by.items():
        own = ordered(own)
        cost, audit, text = stepwise(own, faults(own))
        out[c] = (*facts(own), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(5)
    out = []
    for c in range(300):
        for t in range(dice.randint(1, 9)):
            role = dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "Said"])
            out.append((c, dice.choice([t, t, t + 3, None]), role, dice.choice(["Yes.", "No", " ", "", None, f"w{t}!", "what? \n", "a.b", "é. "])))
    out += [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, None, "user", "x.")]
    return out


def test_stepwise_equals_exhaustive():
    dice = random.Random(3)
    for _ in range(30):
        own = [(k, dice.choice(["user", "assistant", "system", "tool"]), dice.choice(["a.", "b", "", "c!"])) for k in range(dice.randint(0, 3))]
        found = faults(own)
        assert stepwise(own, found) == exhaustive(own, found)


@pytest.mark.parametrize("size", [1, 2, 3, 256])
def test_equals_brute_force(spark, rows, size):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert made(chatrepair.repair(df, size)) == brute(rows)


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay tasks of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversation_is_cut(spark, uncoalesced):
    """One conversation of most rows, a third of them copies: it spans tasks and segments, and equals the strings."""
    dice = random.Random(9)
    rows = [(1, k // 2 if k % 7 else None, dice.choice(["user", "assistant", "system"]), dice.choice(["Yes.", "No", f"t{k}.", f"u{k}", ""])) for k in range(1500)]
    rows += [(1, 40, "user", "again and again.")] * 700 + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    parts = chatrepair.segments(df, 64)
    cut = [r["rows"] for r in parts.where("not whole").collect()]
    assert len(cut) > 20 and max(map(len, cut)) <= 64 and parts.select("part").distinct().count() > 1
    assert made(chatrepair.repair(df, 64)) == brute(rows)
    text = [r for r in chatrepair.repaired_rows(df, 64).where("conv_id = 1").orderBy("part", "seg", "nth").collect()]
    joined = "\n".join(f"{r['role']}:{r['text']}" for r in text)
    assert hashlib.sha256(joined.encode()).hexdigest() == brute(rows)[1][-1]


def test_audits_of_the_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    table += [(None, 3, "user", "hi."), (-1, None, None, None), (-2, 0, "user", "Ja. " * 20000)] + [(-3 - k, 0, "user", "x.") for k in range(30)]
    left = []
    for c, t, role, text in table:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            left += [(c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)] * (2 if d == 3 else 1)
    want = brute(left)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want |= {c: none for c, *_ in table if c not in want}
    assert none in want.values()
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert made(chatrepair.audits(df)) == want


def test_empty_and_clashing_names(spark):
    kind = "conv_id long, turn int, role string, text string, cost int, `a.b` int, part string, seg int, n int, audit string"
    assert chatrepair.audits(spark.createDataFrame([], kind)).collect() == []
    out = made(chatrepair.repair(spark.createDataFrame([(1, 0, "user", "a.", 1, 2, "x", 3, 4, "z")], kind)))
    assert out[1][5:7] == (2, "D")
