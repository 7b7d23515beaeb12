"""Queries of encoders, vocabularies and latents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.keyed import normal_sql, uniform, uniform_sql
from ..operators import encode as E
from ..operators import profile as P
from ..operators.generate import latent_moments as moments
from ..operators.neighbors import scaler, standardise
from ..operators.sampling import inject_nulls
from .registry import query, table

LINE_Q = 100


def _refs(n: int) -> str:
    return "[" + ", ".join(repr(i / (n - 1)) for i in range(n)) + "]"


def _knots(tab: str, col: str, n: int) -> str:
    return f"SELECT unnest(quantile_cont({col}, {_refs(n)})) AS k, unnest({_refs(n)}) AS r FROM {tab}"


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(unnest(range(1000)) AS BIGINT) AS pos, round(unnest(quantile_cont({c}, {_refs(1000)})), 6) AS quantile, round(unnest({_refs(1000)}), 9) AS reference, median({c}) AS fill_value FROM lineitem" for c in ("l_quantity", "l_extendedprice"))
)
def quantile_fit(spark, sf_dir):
    got = E.fit_quantiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    each = got.select("column_name", "fill_value", F.posexplode(F.arrays_zip("quantiles", "references")).alias("pos", "x"))
    return each.select("column_name", F.col("pos").cast("bigint").alias("pos"), F.round("x.quantiles", 6).alias("quantile"), F.round("x.references", 9).alias("reference"), "fill_value")


def _encode_sql(tab: str, key: str, col: str, n: int) -> str:
    return f"""WITH k AS ({_knots(tab, col, n)}), d AS (SELECT k, max(r) AS r, min(r) AS f FROM k GROUP BY k),
e AS (SELECT k AS k0, r AS r0, lead(k) OVER (ORDER BY k) AS k1, lead(f) OVER (ORDER BY k) AS r1 FROM d)
SELECT {key}, CAST(CAST(2 * CASE WHEN k1 IS NULL OR {col} = k0 THEN r0 ELSE r0 + ({col} - k0) * ((r1 - r0) / (k1 - k0)) END - 1 AS FLOAT) AS DOUBLE) AS z
FROM {tab} ASOF JOIN e ON {col} >= k0"""


@query(f"WITH x AS ({_encode_sql('lineitem', 'l_orderkey, l_linenumber', 'l_extendedprice', LINE_Q)}) SELECT l_orderkey, l_linenumber, round(z, 4) AS z FROM x")
def quantile_encode(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    q = E.Quantiles.collect(E.fit_quantiles(df, ["l_extendedprice"], LINE_Q))["l_extendedprice"]
    return df.select("l_orderkey", "l_linenumber", F.round(q.encode(F.col("l_extendedprice")).cast("double"), 4).alias("z"))


@query(f"WITH x AS ({_encode_sql('lineitem', 'l_orderkey, l_linenumber', 'l_extendedprice', E.QUANTILES)}) SELECT l_orderkey, l_linenumber, round(z, 4) AS z FROM x")
def quantile_encode_default(spark, sf_dir):
    """With the default number of knots."""
    df = table(spark, sf_dir, "lineitem")
    q = E.Quantiles.collect(E.fit_quantiles(df, ["l_extendedprice"]))["l_extendedprice"]
    return df.select("l_orderkey", "l_linenumber", F.round(q.encode(F.col("l_extendedprice")).cast("double"), 4).alias("z"))


@query(
    f"""WITH k AS (SELECT quantile_cont(l_extendedprice, {_refs(LINE_Q)}) AS k FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, {uniform_sql('(l_orderkey * 10 + l_linenumber)', 3, 'dec')} * {LINE_Q - 1} AS u FROM lineitem),
i AS (SELECT *, CAST(least(floor(u), {LINE_Q - 2}) AS INTEGER) AS i FROM v)
SELECT l_orderkey, l_linenumber, round(k[i + 1] + (k[i + 2] - k[i + 1]) * (u - i), 4) AS x FROM i, k"""
)
def quantile_decode(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    q = E.Quantiles.collect(E.fit_quantiles(df, ["l_extendedprice"], LINE_Q))["l_extendedprice"]
    v = 2 * uniform(F.col("l_orderkey") * 10 + F.col("l_linenumber"), 3, "dec") - 1
    return df.select("l_orderkey", "l_linenumber", F.round(q.decode(v), 4).alias("x"))


def _vocab_sql(tab: str, col: str) -> str:
    return f"""SELECT '{col}' AS column_name, token, idx, freq FROM (
SELECT {col} AS token, row_number() OVER (ORDER BY {col}) + 1 AS idx, count(*) AS freq FROM {tab} WHERE {col} IS NOT NULL GROUP BY {col}
UNION ALL SELECT '__NULL__', 1, count(*) FROM {tab} WHERE {col} IS NULL UNION ALL SELECT '__UNKNOWN__', 0, 0)"""


ORDERS_NULLED = f"(SELECT o_orderkey, o_orderstatus, CASE WHEN {uniform_sql('o_orderkey', 9, 'null-o_orderpriority')} > 0.2 THEN o_orderpriority END AS o_orderpriority FROM orders)"


def _orders(spark, sf_dir):
    return inject_nulls(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 0.2, 9).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"{_vocab_sql(ORDERS_NULLED, 'o_orderstatus')} UNION ALL {_vocab_sql(ORDERS_NULLED, 'o_orderpriority')}")
def vocab_fit(spark, sf_dir):
    return E.fit_vocabulary(_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


@query(
    f"""WITH d AS {ORDERS_NULLED}, v AS ({_vocab_sql("(SELECT o_orderpriority FROM d WHERE o_orderpriority IS NULL OR o_orderpriority <> '1-URGENT')", 'o_orderpriority')})
SELECT o_orderkey, coalesce(idx, 0) AS idx FROM d LEFT JOIN v ON coalesce(o_orderpriority, '__NULL__') = token"""
)
def vocab_encode(spark, sf_dir):
    df = _orders(spark, sf_dir)
    vocab = E.fit_vocabulary(df.where("o_orderpriority IS NULL OR o_orderpriority <> '1-URGENT'"), ["o_orderpriority"])
    return E.encode_category(df, vocab, "o_orderpriority", "idx").select("o_orderkey", "idx")


@query(
    f"""WITH v AS ({_vocab_sql('orders', 'o_orderpriority')})
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE coalesce(token, '__UNKNOWN__') END AS token FROM orders LEFT JOIN v ON o_orderkey % 10 = idx"""
)
def vocab_decode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    vocab = E.fit_vocabulary(df, ["o_orderpriority"])
    return E.decode_category(df.withColumn("i", F.col("o_orderkey") % 10), vocab, "o_orderpriority", "i", "token").select("o_orderkey", "token")


@query(
    """SELECT 'c_mktsegment' AS column_name, count(DISTINCT c_mktsegment) + 2 AS cardinality, count(*) FILTER (c_mktsegment IS NULL) AS rare_category_count FROM customer
UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), NULL FROM customer"""
)
def profile_enrich(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    return P.enrich(P.profile(df), E.fit_vocabulary(df, ["c_mktsegment"])).select("column_name", "cardinality", "rare_category_count")


CUST_Q = 100


def _encoder(df):
    q = E.Quantiles.collect(E.fit_quantiles(df, ["c_acctbal"], CUST_Q))
    return q, E.fit_vocabulary(df, ["c_mktsegment"])


@query(
    f"""WITH n AS ({_encode_sql('customer', 'c_custkey', 'c_acctbal', CUST_Q)}), v AS ({_vocab_sql('customer', 'c_mktsegment')})
SELECT c_custkey, round(z, 4) AS x_num, idx AS x_cat FROM n JOIN customer USING (c_custkey) JOIN v ON c_mktsegment = token"""
)
def encode_table(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    q, vocab = _encoder(df)
    got = E.encode_table(df, q, vocab, ["c_acctbal"], ["c_mktsegment"])
    return got.select("c_custkey", F.round(F.col("x_num")[0].cast("double"), 4).alias("x_num"), F.col("x_cat")[0].alias("x_cat"))


@query("SELECT count(*) AS n, count(*) AS n_close, count(*) AS n_same FROM customer")
def decode_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    q, vocab = _encoder(df)
    coded = E.encode_table(df, q, vocab, ["c_acctbal"], ["c_mktsegment"])
    back = E.decode_table(coded, q, vocab, ["c_acctbal"], ["c_mktsegment"], {"c_acctbal": "double", "c_mktsegment": "string"}, prefix="d_")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("d_c_acctbal") - F.col("c_acctbal")) < 0.01).alias("n_close"), F.count_if(F.col("d_c_mktsegment") == F.col("c_mktsegment")).alias("n_same"))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def standardize(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    fit = scaler(df, ["c_acctbal"])["c_acctbal"]
    return df.select("c_custkey", F.round(standardise(F.col("c_acctbal"), fit), 6).alias("z"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) AS scale FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def scaler_fit(spark, sf_dir):
    got = scaler(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    rows = spark.createDataFrame([(c, m, s) for c, (m, s, _) in got.items()], "column_name string, mean double, scale double")
    return rows.select("column_name", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("SELECT c_custkey, round(c_acctbal, 6) AS x0, round(sin(k), 6) AS x1, round(cos(k), 6) AS x2 FROM (SELECT c_custkey, c_acctbal, least(c_nationkey + 3, 24) AS k FROM customer)")
def latent_assemble(spark, sf_dir):
    book = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), F.array(F.sin("n_nationkey"), F.cos("n_nationkey")).alias("vector"))
    df = table(spark, sf_dir, "customer")
    got = E.assemble_latent(df, F.array("c_acctbal"), [(F.col("c_nationkey").cast("bigint") + 3, book)])
    return got.select("c_custkey", *(F.round(F.col("latent")[i], 6).alias(f"x{i}") for i in range(3)))


NOISE_STEPS = 100


def _width(df) -> int:
    return df.agg(F.max(F.size("embedding"))).first()[0] or 1


@query(
    f"""WITH s AS (SELECT t, least(greatest(1 - pow(cos(((t + 1.0) / {NOISE_STEPS} + 0.008) / 1.008 * pi() / 2), 2) / pow(cos((t * 1.0 / {NOISE_STEPS} + 0.008) / 1.008 * pi() / 2), 2), 1e-5), 0.999) AS b FROM range({NOISE_STEPS}) AS r(t)),
a AS (SELECT t, greatest(exp(sum(ln(1 - b)) OVER (ORDER BY t)), 1e-8) AS ab FROM s),
v AS (SELECT vec_id, CAST(floor({uniform_sql('vec_id', 5, 't')} * {NOISE_STEPS}) AS BIGINT) AS t, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
n AS (SELECT vec_id, t, i, round(sqrt(ab) * x + sqrt(1 - ab) * {normal_sql('vec_id', 5, "e' || i || '")}, 5) AS y FROM v JOIN a USING (t))
SELECT vec_id, t, list(CASE WHEN y = 0 THEN 0.0 ELSE y END ORDER BY i) AS noised FROM n GROUP BY vec_id, t""",
    "noising_pairs",
)
def noising_pairs_whole(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    got = E.noising_pairs(df, "vec_id", "embedding", _width(df), NOISE_STEPS, 5)
    return got.select("vec_id", "t", F.transform("noised", lambda x: F.round(x, 5)).alias("noised"))


@query(
    """WITH v AS (SELECT row_number() OVER () AS r, embedding FROM embeddings), u AS (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM v),
m AS (SELECT i, avg(x) AS mean FROM u GROUP BY i), c AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS cov FROM u a JOIN u b ON a.r = b.r AND b.i <= a.i GROUP BY 1, 2)
SELECT c.i, c.j, round(p.mean, 6) AS mean_i, round(q.mean, 6) AS mean_j, round(cov, 6) AS cov FROM c JOIN m p ON p.i = c.i JOIN m q ON q.i = c.j""",
    "latent_moments",
)
def latent_moments_whole(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    got = moments(df, "embedding", _width(df))
    return got.select("i", "j", *(F.round(c, 6).alias(c) for c in ("mean_i", "mean_j", "cov")))


_PLACES = "SELECT o_orderkey, concat_ws('', CASE o_orderpriority WHEN '2-HIGH' THEN '1000' WHEN '3-MEDIUM' THEN '0100' WHEN '4-NOT SPECIFIED' THEN '0010' WHEN '5-LOW' THEN '0001' ELSE '0000' END) AS places FROM orders"


@query(_PLACES)
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    vocab = E.fit_vocabulary(df.where("o_orderpriority <> '1-URGENT'"), ["o_orderpriority"])
    places = E.one_hot(vocab, "o_orderpriority", F.col("o_orderpriority"))
    return df.select("o_orderkey", F.array_join(F.transform(places, lambda x: x.cast("int")), "").alias("places"))


@query(_PLACES)
def one_hot_sparse(spark, sf_dir):
    """The same places from sparse vectors."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    vocab = E.fit_vocabulary(df.where("o_orderpriority <> '1-URGENT'"), ["o_orderpriority"])
    got = E.with_sparse(df, vocab, "o_orderpriority", "v")
    return got.select("o_orderkey", F.array_join(F.transform(vector_to_array("v"), lambda x: x.cast("int")), "").alias("places"))
