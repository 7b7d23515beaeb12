"""Queries of nearest neighbours and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import uniform, uniform_sql
from ..operators import neighbors as N
from .registry import query, table

NUM, CAT = ["c_acctbal", "c_nationkey"], ["c_mktsegment"]


def _real(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", *NUM, *CAT)


def synthetic(real):
    """Customers with moved balances and, for some, a segment nobody else has."""
    u = uniform("c_custkey", 21, "move")
    return real.withColumn("c_acctbal", F.col("c_acctbal") + 200 * (u - 0.5)).withColumn("c_mktsegment", F.when(u < 0.1, F.lit("NEW")).otherwise(F.col("c_mktsegment")))


REAL = "(SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer)"
_U = uniform_sql("c_custkey", 21, "move")
SYNTHETIC = f"(SELECT c_custkey, c_acctbal + 200 * ({_U} - 0.5) AS c_acctbal, c_nationkey, CASE WHEN {_U} < 0.1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer)"


def pairs_sql(left: str, right: str, fit: str | None = None) -> str:
    """Distances of all pairs, for the check on a small table."""
    fit = fit or right
    return f"""(SELECT a.c_custkey, b.c_custkey AS other, sqrt(pow((a.c_acctbal - b.c_acctbal) / s.a, 2) + pow((a.c_nationkey - b.c_nationkey) / s.n, 2)
+ CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 0 WHEN a.c_mktsegment IN (SELECT c_mktsegment FROM {fit}) THEN 2 ELSE 1 END) AS dist
FROM {left} a, {right} b, (SELECT stddev_pop(c_acctbal) AS a, stddev_pop(c_nationkey) AS n FROM {fit}) s)"""


NEAREST = f"SELECT c_custkey, min(dist) AS dist FROM {pairs_sql(SYNTHETIC, REAL)} GROUP BY 1"
OWN = f"SELECT c_custkey, min(dist) AS dist FROM {pairs_sql(REAL, REAL)} WHERE c_custkey <> other GROUP BY 1"


@query(f"SELECT c_custkey, round(dist, 6) AS dist FROM ({NEAREST})")
def dcr_nearest(spark, sf_dir):
    real = _real(spark, sf_dir)
    got = N.knn(synthetic(real), real, "c_custkey", NUM, CAT)
    return got.select("c_custkey", F.round(F.get("near", 0), 6).alias("dist"))


@query(f"SELECT c_custkey, round(dist, 6) AS dist FROM ({OWN})")
def self_nn(spark, sf_dir):
    real = _real(spark, sf_dir)
    got = N.knn(real, real, "c_custkey", NUM, CAT, exclude_self=True)
    return got.select("c_custkey", F.round(F.get("near", 0), 6).alias("dist"))


@query("SELECT count(*) AS n, true AS recall_is_enough FROM customer")
def dcr_approximate(spark, sf_dir):
    """Nearest real rows by random projections: of how many rows the true least distance is found."""
    real = _real(spark, sf_dir)
    exact, found = (f(synthetic(real), real, "c_custkey", NUM, CAT).select("c_custkey", F.get("near", 0).alias(n)) for f, n in ((N.knn, "a"), (N.knn_approximate, "b")))
    hit = F.coalesce(F.col("b") <= F.col("a") + 1e-9, F.lit(False))
    return exact.join(found, "c_custkey").agg(F.count(F.lit(1)).alias("n"), (F.avg(hit.cast("double")) >= 0.9).alias("recall_is_enough"))


_BOTH = f"(SELECT * FROM {REAL} UNION ALL SELECT * FROM {SYNTHETIC})"


@query(
    f"""WITH r AS (SELECT c_custkey, dist, row_number() OVER (PARTITION BY c_custkey ORDER BY dist) AS k FROM {pairs_sql(REAL, SYNTHETIC, _BOTH)})
SELECT c_custkey, round(min(dist), 6) AS d_min, round(avg(dist), 6) AS d_mean, round(stddev_pop(dist), 6) AS d_std, round(min(dist) / greatest(avg(dist), 1e-8), 6) AS d_ratio FROM r WHERE k <= 5 GROUP BY 1"""
)
def knn_features(spark, sf_dir):
    real = _real(spark, sf_dir)
    got = N.knn_features(real, synthetic(real), "c_custkey", NUM, CAT, 5)
    return got.select("c_custkey", *(F.round(c, 6).alias(c) for c in ("d_min", "d_mean", "d_std", "d_ratio")))


@query(
    """WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT vec_id, c.label, sqrt(sum((x - m) * (x - m))) AS dist FROM e JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, CAST(arg_min(label, dist) AS BIGINT) AS code, round(min(dist), 6) AS code_distance FROM d GROUP BY 1"""
)
def nearest_centroid(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    each = df.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    book = each.groupBy(F.col("label").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("vector"))
    return N.nearest_code(df, "embedding", book).select("vec_id", "code", F.round("code_distance", 6).alias("code_distance"))


_P = """SELECT a.vec_id, [CAST(x AS DOUBLE) FOR x IN a.embedding] AS x, [CAST(x AS DOUBLE) + CASE WHEN a.vec_id % 50 = 0 THEN 0.5 ELSE 0.000001 END FOR x IN a.embedding] AS y FROM embeddings a"""


@query(
    f"""WITH p AS ({_P}), g AS (SELECT vec_id, list_max([abs(z[1] - z[2]) FOR z IN list_zip(x, y)]) AS gap, len([1 FOR z IN list_zip(x, y) IF abs(z[1] - z[2]) > 1e-5 + 1e-5 * abs(z[2])]) = 0 AS ok,
list_position(x, list_max(x)) = list_position(y, list_max(y)) AS same FROM p)
SELECT count(*) AS n_rows, round(max(gap), 9) AS max_abs_diff, bool_and(ok) AS all_close, round(max(gap) * 3.0, 9) AS amplified_max_abs_diff, max(gap) * 3.0 <= 1e-5 AS amplified_within, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 9) AS argmax_agreement, CAST(3.0 AS DOUBLE) AS cfg_scale FROM g"""
)
def parity_report(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    move = F.when(F.col("vec_id") % 50 == 0, 0.5).otherwise(0.000001)
    b = a.withColumn("v", F.transform("v", lambda x: x + move))
    got = N.parity_report(a, b, "vec_id", "v", scale=3.0)
    return got.select("n_rows", F.round("max_abs_diff", 9).alias("max_abs_diff"), "all_close", F.round("amplified_max_abs_diff", 9).alias("amplified_max_abs_diff"), "amplified_within", F.round("argmax_agreement", 9).alias("argmax_agreement"), "cfg_scale")
