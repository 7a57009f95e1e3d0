"""The operN queries with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bytebpe, chat, chatrepair, fptree, language, maxent, mixing, nndescent, pieces, repeats, templates, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, list_transform(list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda w: w <> ''),
        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS t FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT *, len(t) AS n, t[1:{templates.DEPTH}] AS lead FROM l WHERE len(t) > 0),
busy AS (SELECT n, lead FROM k GROUP BY ALL HAVING count(DISTINCT r) >= {templates.MIN_DOCS}),
b AS (SELECT * FROM k SEMI JOIN busy USING (n, lead)),
c AS (SELECT n, lead, t, count(DISTINCT r) AS docs FROM b GROUP BY ALL),
p AS (SELECT *, t[pos] AS tok FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM c)),
h AS (SELECT n, lead, pos, tok FROM p GROUP BY ALL HAVING sum(docs) >= {templates.MIN_DOCS}),
f AS (SELECT n, lead, t, list(pos || ' ' || tok ORDER BY pos) AS fixed, bool_or(tok <> '<*>') AS word FROM p JOIN h USING (n, lead, pos, tok) GROUP BY ALL),
x AS (SELECT r, doc_id, i, n, lead, fixed FROM b JOIN f USING (n, lead, t) WHERE word AND len(fixed) >= n * CAST({templates.SHARE} AS DOUBLE)),
g AS (SELECT n, lead, fixed, min(doc_id) AS keeper FROM x GROUP BY ALL HAVING count(DISTINCT r) >= {templates.MIN_DOCS}),
gone AS (SELECT r, list(i) AS gi FROM x JOIN g USING (n, lead, fixed) WHERE doc_id <> keeper GROUP BY r)
SELECT doc_id, len(ls) AS n_lines, CAST(coalesce(len(gi), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(list_filter(ls, lambda x, i: gi IS NULL OR NOT list_contains(gi, i)), chr(10))) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
)
def op2_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g, count(*) AS n FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN t x ON a = x.doc_id JOIN t y ON b = y.doc_id WHERE 10 * k >= 8 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY a
"""
)
def op3_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def _level(level: str, parents: str, keys: str, weights: str) -> str:
    """One level of the budget: the fullest shares of the children of each node, in DuckDB SQL."""
    return f"""
c_{level} AS (SELECT {keys} {level}, sum(capacity) AS capacity, first({weights}) AS w FROM leaves GROUP BY ALL),
f_{level} AS (SELECT c.*, p.budget AS total, sum(c.capacity) OVER o AS cum, sum(w) OVER o AS v, sum(w) OVER (PARTITION BY {keys} 1) AS allw
  FROM c_{level} c JOIN {parents}
  WINDOW o AS (PARTITION BY {keys} 1 ORDER BY c.capacity / w, {level} ROWS UNBOUNDED PRECEDING)),
g_{level} AS (SELECT *, capacity::HUGEINT * (allw - v + w)::HUGEINT <= (total - cum + capacity)::HUGEINT * w::HUGEINT AS filled FROM f_{level}),
h_{level} AS (SELECT *, total - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER (PARTITION BY {keys} 1) AS rest,
  greatest(1, sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY {keys} 1)) AS wrest,
  sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY {keys} 1 ORDER BY capacity / w, {level} ROWS UNBOUNDED PRECEDING) AS run FROM g_{level}),
b_{level} AS (SELECT {keys} {level}, CASE WHEN filled THEN capacity ELSE (rest::HUGEINT * run::HUGEINT) // wrest::HUGEINT - (rest::HUGEINT * (run - w)::HUGEINT) // wrest::HUGEINT END AS budget FROM h_{level})"""


def _case(level: str) -> str:
    names = "".join(f" WHEN '{k}' THEN {w}" for k, w in mixing.WEIGHTS[level].items())
    return f"CASE {level}{names} ELSE {mixing.DEFAULT_WEIGHT} END"


#: DuckDB has no crc32: the domains of the sources that the tables hold, as the operator gives them.
_DOMAINS = {f"src{k}": f"d{zlib.crc32(f'src{k}'.encode()) % 3}" for k in range(20)}
_MIX_SQL = rf"""
WITH d AS (SELECT doc_id, CASE source {"".join(f" WHEN '{s}' THEN '{d}'" for s, d in _DOMAINS.items())} END AS domain, lang, source, text,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {mixing.EPOCHS} AS capacity FROM d GROUP BY ALL),
root AS (SELECT CAST(floor(sum(tokens) * {mixing.BUDGET_PER_MILLE} / 1000) AS BIGINT) AS budget FROM leaves),
{_level("domain", "root p ON true", "", _case("domain"))},
{_level("lang", "b_domain p USING (domain)", "domain,", _case("lang"))},
{_level("source", "b_lang p USING (domain, lang)", "domain, lang,", _case("source"))},
plan AS (SELECT domain, lang, source, CAST(budget // tokens AS INTEGER) AS passes, budget % tokens AS prefix FROM b_source JOIN leaves USING (domain, lang, source)),
r AS (SELECT d.*, passes, prefix, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{mixing.SEED}', passes, doc_id)), doc_id ROWS UNBOUNDED PRECEDING) - n AS start
  FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(n AS BIGINT) AS take_tokens FROM r, range(0, passes) t(e)
UNION ALL
SELECT doc_id, domain, lang, source, passes, CAST(n AS BIGINT), CAST(least(n, prefix - start) AS BIGINT) FROM r WHERE start < prefix
"""


@query(_MIX_SQL)
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row", "content")


_ESCAPED = f"regexp_replace(text, '{chat.FIND}', '\\1\\\\\\2\\3', 'g')"


@query(
    f"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(role) + length({_ESCAPED}) + {len(chat.OPEN) + len(chat.CLOSE) + 2}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, lone
"""
)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


@query(
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
)
def op5_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


@query()
def op6_sentencepiece_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs).drop("text")


@query(
    """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
)
def op7_nn_descent_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(table(spark, sf_dir, "documents"))


@query()
def op9_maxent_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE len(w) >= 35)),
twice AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM starts SEMI JOIN twice USING (win)),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM docs LEFT JOIN lost USING (r)
"""
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op12_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Offsets would pass through the decoder for nothing.
    out = bytebpe.decode(bytebpe.encode(docs).drop("text", "starts", "ends"))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_shared")


def _way(f: str, cost: int | str, letter: str, item: str | None) -> str:
    """A way of op13's SQL with an edit before it: ten digits of cost, the letters, chr(1), and the repaired rows, each with a line break."""
    row = f"{item} || chr(10) || " if item else ""
    return (
        f"(lpad(CAST(CAST(left({f}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || '{letter}' || substr({f}, 11, instr({f}, chr(1)) - 10)"
        f" || {row}substr({f}, instr({f}, chr(1)) + 1))"
    )


def _ways(state: int) -> str:
    """The least way from a state through a row, without insertions: what follows are the ways f0 to f3."""
    late = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    given = chatrepair.GIVEN[state]
    kept = "".join(f" WHEN '{initial}' THEN {_way(f'f{after}', late, 'K', 'role || chr(58) || text')}" for initial, after in chatrepair.AFTER[state].items())
    free = "fault NOT IN ('blank', 'duplicate')"
    keep = f"CASE WHEN {free} THEN CASE left(role, 1){kept} END END"
    rerole = f"CASE WHEN {free} THEN {_way(f'f{given}', f'1 + {late}', 'R', repr(chatrepair.ROLES[state] + ':') + ' || text')} END"
    return f"least({_way(f'f{state}', 2, 'D', None)}, {keep}, {rerole}) AS b{state}"


def _inserted(state: int) -> str:
    return f"least(b{state}, {_way(f'b{chatrepair.GIVEN[state]}', 5, 'I', repr(chatrepair.ROLES[state] + ':'))}) AS f{state}"


_BARE = "regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '')"
_END = {0: "'0000000000' || chr(1)", 3: "'0000000000' || chr(1)", 2: "'0000000005I' || chr(1) || 'assistant:' || chr(10)", 1: "'0000000010II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10)"}


@query(
    rf"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295::BIGINT],
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS d FROM conversations, tbl),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM drawn, range(2) c(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
told AS (SELECT *, CASE WHEN {_BARE} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches({_BARE}, '[.!?]$') THEN 'truncated' ELSE 'none' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
ways AS (SELECT conv_id, count(*) AS i, {", ".join(f"{x} AS f{s}" for s, x in sorted(_END.items()))} FROM placed GROUP BY conv_id
  UNION ALL SELECT conv_id, i, {", ".join(_inserted(s) for s in range(4))}
  FROM (SELECT w.conv_id, w.i - 1 AS i, {", ".join(_ways(s) for s in range(4))} FROM ways w JOIN told r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i)),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(f0, 10), '0') AS BIGINT) AS cost, coalesce(substr(f0, 11, instr(f0, chr(1)) - 11), '') AS audit,
  sha256(coalesce(left(substr(f0, instr(f0, chr(1)) + 1), length(f0) - instr(f0, chr(1)) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ways w ON w.i = 0 AND w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatrepair.audits(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


_FOUND = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{fptree.TERM}')"


@query(
    f"""
WITH q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_FOUND}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FOUND} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_all FROM d),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
m AS (SELECT r, 75 + ((25 * len(t) * n_docs) // n_all) AS m FROM d, s),
p AS (SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {fptree.TOP}
"""
)
def op11_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
