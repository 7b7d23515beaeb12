"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, filter_audit, hamming, html_main, mixing, multi_index, packing, phrases, secrets, sharding, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"))


def op5_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.dedup_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(_table(spark, sf_dir, "pages")), keep=("page_id",))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op12_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def ann_whole_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted multi-index walked to its end, which is exact at any size."""
    got = multi_index.search(_table(spark, sf_dir, "embeddings"), scan_share=1.0, shard_rows=128)
    return got.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def hamming_small_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hamming search over many small blocks."""
    return hamming.exact_top_k(_table(spark, sf_dir, "embeddings"), block_rows=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_temperature_mix": op2_temperature_mix,
    "op3_simhash": op3_simhash,
    "op4_multi_index": op4_multi_index,
    "op5_repeated_phrases": op5_repeated_phrases,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_hamming_top_k": op9_hamming_top_k,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minimax_shards": op12_minimax_shards,
    "op13_filter_interactions": op13_filter_interactions,
    "ann_whole_scan": ann_whole_scan,
    "hamming_small_blocks": hamming_small_blocks,
}

_WORD = r"[^\x20\x09-\x0D]+"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
x AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win,
  count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM w),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM x WHERE n = 20),
c AS (SELECT w.doc_id, w.i, word, coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.i = f.i),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _op6_sql() -> str:
    quote = lambda p: p.replace("'", "''")
    parts = " UNION ALL ".join(
        f"SELECT rid, {no} AS no, unnest(regexp_extract_all(t, '{quote(p)}')) AS m, unnest(string_split_regex(t, '{quote(p)}')[1:len(regexp_extract_all(t, '{quote(p)}'))]) AS p, unnest(range(len(regexp_extract_all(t, '{quote(p)}')))) AS j FROM d WHERE regexp_matches(t, '{quote(p)}')"
        for no, p in enumerate(secrets.PATTERNS.values())
    )
    text = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e){cond}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, lang, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
a AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY rid, no ORDER BY j) AS e FROM m),
b AS (SELECT rid, no, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE WHEN no = 0 THEN regexp_extract(m, '{quote(secrets.ASSIGN)}', 2) ELSE m END AS v FROM a),
c AS (SELECT * FROM b WHERE (no <> 0 OR length(v) >= 12) AND (no <> 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
u AS (SELECT * FROM c WHERE no < 3 UNION ALL SELECT * FROM c o WHERE no = 3 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.rid = o.rid AND x.no < 3 AND x.s < o.e AND o.s < x.e)),
o AS (SELECT v, count(*) AS n, count(DISTINCT (source, coalesce(lang, ''))) AS repos, count(DISTINCT source) AS owners FROM u JOIN d USING (rid) GROUP BY 1),
g AS (SELECT u.*, owners < {secrets.MIN_OWNERS} AS live, n || '/' || repos || '/' || owners AS seen, ['assign', 'access', 'hex', 'opaque'][no + 1] AS kind FROM u JOIN o USING (v) WHERE no < 3 OR owners = 1),
r AS (SELECT rid, count(*) FILTER (no = 0) AS n0, count(*) FILTER (no = 1) AS n1, count(*) FILTER (no = 2) AS n2, count(*) FILTER (no = 3) AS n3, count(*) FILTER (live) AS nl, count(*) FILTER (NOT live) AS nc,
  {text(' FILTER (no < 3)')} AS base, {text('')} AS spans, string_agg(seen, ',' ORDER BY s, no, e) AS seen FROM g GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n3, 0) AS n_opaque, coalesce(nl, 0) AS n_live, coalesce(nc, 0) AS n_copied, coalesce(seen, '') AS seen FROM d LEFT JOIN r USING (rid)"""


# The given pages name their article, hold paragraphs, headings, <b> and <br> in it, and
# two kinds of references; other pages are held against hand-written texts in the tests.
OP1_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
p AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN string_split_regex(a, '</?(?:p|h1)>')] AS xs FROM a),
t AS (SELECT page_id, url, array_to_string([x FOR x IN xs IF x <> ''], chr(10)) AS text FROM p)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""

ANN_SQL = """
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS s FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 9) AS score FROM r WHERE rank <= 20"""

OP9_SQL = """
WITH c AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS b FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([abs(z[1] - z[2]) FOR z IN list_zip(q.b, c.b)]) AS BIGINT) AS distance FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 20"""

# CRC-32 has no function there; the decoding is a recursion over the rows of all conversations at once.
OP11_SQL = r"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, dense_rank() OVER (ORDER BY conv_id) AS g FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(key, '')]),
  lambda h, x: list_reduce(list_prepend(xor(h, x), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 AS fate FROM k),
e AS (SELECT g, turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
  unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
f AS (SELECT *, regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
  NOT regexp_full_match(text, '(?s).*[.!?][\x20\x09-\x0D]*') AS cut, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM i),
n AS (SELECT *, blank OR again AS gone, CASE WHEN blank OR again OR NOT cut THEN 0 ELSE 3 END AS extra FROM f),
t AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (extra = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM n GROUP BY 1),
legal(f, x, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put(f, made, t) AS (SELECT s, '', s FROM range(4) r(s) UNION ALL SELECT f, x, t FROM legal WHERE x <> 's' UNION ALL SELECT a.f, a.x || b.x, b.t FROM legal a JOIN legal b ON a.t = b.f WHERE a.x = 'u' AND a.f < 2),
act(f, edit, x, t, cost) AS (SELECT s, 'D', NULL, s, 4 FROM range(4) r(s) UNION ALL SELECT f, 'K', x, t, 0 FROM legal UNION ALL SELECT f, 'R', x, t, 3 FROM legal WHERE x <> 's'),
v AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS made FROM (SELECT DISTINCT g FROM k)
  UNION ALL SELECT g, i, s, cost, audit, made FROM (
    SELECT n.g, n.i, act.t AS s, v.cost + 3 * length(put.made) + act.cost + CASE WHEN edit = 'D' THEN 0 ELSE extra END AS cost, v.audit || repeat('I', length(put.made)) || edit AS audit,
      v.made || [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END FOR x IN string_split(put.made, '') IF x <> ''] || CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE act.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END AS made
    FROM v JOIN n ON n.g = v.g AND n.i = v.i + 1 JOIN put ON put.f = v.s JOIN act ON act.f = put.t
    WHERE CASE edit WHEN 'D' THEN true WHEN 'K' THEN NOT gone AND left(role, 1) = act.x ELSE NOT gone END)
    QUALIFY row_number() OVER (PARTITION BY g, s ORDER BY cost, audit) = 1),
z AS (SELECT v.g, v.cost + 3 * length(put.made) AS cost, audit || repeat('I', length(put.made)) AS audit, v.made || [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END FOR x IN string_split(put.made, '') IF x <> ''] AS made
  FROM v LEFT JOIN t USING (g) JOIN put ON put.f = v.s WHERE v.i = coalesce(t.n, 0) AND put.t IN (0, 3) QUALIFY row_number() OVER (PARTITION BY v.g ORDER BY v.cost + 3 * length(put.made), v.audit || repeat('I', length(put.made))) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(made, chr(10))) AS repaired_sha256
FROM z JOIN (SELECT DISTINCT g, conv_id FROM k) USING (g) LEFT JOIN t USING (g)"""

OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY 1),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN f USING (t) LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
i AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string([chr(CAST(65 + x AS INT)) FOR x IN o], '') AS filter_order, unnest(range(1, 6)) AS step, o FROM o),
b AS (SELECT filter_order, step, 1 << o[step] AS own, CAST(list_sum([1 << x FOR x IN o[1:step]]) AS BIGINT) AS upto FROM s),
r AS (SELECT part, filter_order, step, own,
  sum(n) FILTER (mask & upto = 0) AS kept, sum(n) FILTER (mask & own <> 0 AND mask & (upto - own) = 0) AS removed, sum(n) FILTER (mask & own <> 0 AND mask & (upto - own) <> 0) AS redundant,
  sum(n) FILTER (mask = own) AS unique_fails, sum(g) FILTER (mask & own <> 0 AND mask & (upto - own) = 0) AS good_lost, sum(x) FILTER (mask & own <> 0 AND mask & (upto - own) = 0) AS toxic_lost
  FROM n CROSS JOIN b GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

ORACLE_SQL: dict[str, str] = {"op1_main_text": OP1_SQL, "ann_whole_scan": ANN_SQL, "hamming_small_blocks": OP9_SQL, "op5_repeated_phrases": OP5_SQL, "op6_secret_scan": _op6_sql(), "op9_hamming_top_k": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op13_filter_interactions": OP13_SQL}
