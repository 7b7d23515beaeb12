"""Queries of metrics over scored labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import uniform, uniform_sql
from ..operators import metrics as M
from .neighbours import NEAREST, NUM, CAT, OWN, _real, synthetic
from .registry import query, table

SCORED = f"(SELECT toxic AS label, least(1.0, round(0.7 * {uniform_sql('doc_id', 31, 'score')} + 0.3 * toxic, 2)) AS score FROM labels)"


def _scored(spark, sf_dir):
    score = F.least(F.lit(1.0), F.round(0.7 * uniform("doc_id", 31, "score") + 0.3 * F.col("toxic"), 2))
    return table(spark, sf_dir, "labels").select(F.col("toxic").alias("label"), score.alias("score"))


@query(
    f"""WITH g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM {SCORED} GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY score) AS cum FROM g)
SELECT round(sum(p * (cum - n / 2.0)) / (sum(p) * sum(n)), 9) AS auc FROM c"""
)
def roc_auc(spark, sf_dir):
    return M.roc_auc(_scored(spark, sf_dir), "score", "label").select(F.round("auc", 9).alias("auc"))


@query(
    f"""WITH g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM {SCORED} GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g)
SELECT round(sum(p * tp * 1.0 / (tp + fp)) / sum(p), 9) AS average_precision FROM c"""
)
def average_precision(spark, sf_dir):
    return M.average_precision(_scored(spark, sf_dir), "score", "label").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"SELECT round(2.0 * count(*) FILTER (score >= 0.5 AND label = 1) / (2 * count(*) FILTER (score >= 0.5 AND label = 1) + count(*) FILTER (score >= 0.5 AND label = 0) + count(*) FILTER (score < 0.5 AND label = 1)), 9) AS f1 FROM {SCORED}")
def f1_at_half(spark, sf_dir):
    return M.f1(_scored(spark, sf_dir), "score", "label").select(F.round("f1", 9).alias("f1"))


@query(
    """SELECT label, round(coalesce(a.c * 1.0 / (SELECT count(*) FROM customer), 0), 9) AS real_share, round(coalesce(b.c * 1.0 / (SELECT count(*) FROM customer WHERE c_nationkey < 5), 0), 9) AS other_share,
round(coalesce(b.c * 1.0 / (SELECT count(*) FROM customer WHERE c_nationkey < 5), 0) - coalesce(a.c * 1.0 / (SELECT count(*) FROM customer), 0), 9) AS diff
FROM (SELECT c_mktsegment AS label, count(*) AS c FROM customer GROUP BY 1) a FULL JOIN (SELECT c_mktsegment AS label, count(*) AS c FROM customer WHERE c_nationkey < 5 GROUP BY 1) b USING (label)"""
)
def class_share_compare(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    got = M.class_shares(df, df.where("c_nationkey < 5"), "c_mktsegment")
    return got.select("label", *(F.round(c, 9).alias(c) for c in ("real_share", "other_share", "diff")))


def _kde_sql(src: str, name: str) -> str:
    return f"SELECT g, sum(exp(-pow((-1000 + 11000.0 * g / 24 - c_acctbal) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())) AS {name} FROM {src}, (SELECT count(*) AS n, stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h FROM {src}), range(25) AS r(g) GROUP BY 1"


@query(f"SELECT CAST(g AS INTEGER) AS g, round(real_density * 1e6, 6) AS real_density, round(other_density * 1e6, 6) AS other_density FROM ({_kde_sql('customer', 'real_density')}) JOIN ({_kde_sql('supplier_like', 'other_density')}) USING (g)".replace("supplier_like", "(SELECT c_acctbal FROM customer WHERE c_nationkey < 5)"))
def kde_compare(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    a = M.kde(df, "c_acctbal", -1000.0, 10000.0, 25).select("g", F.round(F.col("density") * 1e6, 6).alias("real_density"))
    b = M.kde(df.where("c_nationkey < 5"), "c_acctbal", -1000.0, 10000.0, 25).select("g", F.round(F.col("density") * 1e6, 6).alias("other_density"))
    return a.join(b, "g")


@query(
    """WITH s AS (SELECT count(l_extendedprice) AS n, stddev_samp(CAST(l_extendedprice AS DOUBLE)) * pow(count(l_extendedprice), -0.2) AS h FROM lineitem),
p AS (SELECT (CAST(l_extendedprice AS DOUBLE) - 0.0) / (h / 64) AS p FROM lineitem, s WHERE l_extendedprice IS NOT NULL), b AS (SELECT floor(p) AS i, sum(1 - (p - floor(p))) AS a, sum(p - floor(p)) AS b FROM p GROUP BY 1)
SELECT CAST(g AS INTEGER) AS g, round(1e6 * sum(a * exp(-pow((100000.0 * g / 40 - i * (h / 64)) / h, 2) / 2) + b * exp(-pow((100000.0 * g / 40 - (i + 1) * (h / 64)) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM b, s, range(41) r(g) GROUP BY 1"""
)
def kde_prices(spark, sf_dir):
    """The density of all line prices, by bins."""
    got = M.kde_binned(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 100000.0, 41)
    return got.select("g", F.round(F.col("density") * 1e6, 6).alias("density"))


@query(f"SELECT round(median(d.dist), 6) AS median, round(quantile_cont(d.dist, 0.05), 6) AS p5, round(avg(CASE WHEN d.dist < t THEN 1.0 ELSE 0.0 END), 9) AS share_below FROM ({NEAREST}) d, (SELECT quantile_cont(dist, 0.01) AS t FROM ({OWN}))")
def dcr_summary(spark, sf_dir):
    from ..operators.audit import distances

    real = _real(spark, sf_dir)
    near, own = distances(real, synthetic(real), "c_custkey", NUM, CAT)
    t = M.percentiles(own, {"dist": F.col("dist")}, [0.01])["dist"][0]
    return M.distance_summary(near, "dist", t).select(F.round("median", 6).alias("median"), F.round("p5", 6).alias("p5"), F.round("share_below", 9).alias("share_below"))


@query(
    f"""WITH m AS (SELECT CASE WHEN s = 0 THEN 'r' ELSE 's' END AS src, avg(score) AS auc, avg(score * score) AS f1 FROM (SELECT score, label AS s FROM {SCORED}) GROUP BY 1)
SELECT round(r.auc, 9) AS trtr_auc, round(r.f1, 9) AS trtr_f1, round(s.auc, 9) AS tstr_auc, round(s.f1, 9) AS tstr_f1, round(s.auc / r.auc, 9) AS auc_ratio, round(s.f1 / r.f1, 9) AS f1_ratio, s.auc / r.auc >= 0.9 AS approved FROM m r, m s WHERE r.src = 'r' AND s.src = 's'"""
)
def mle_ratio(spark, sf_dir):
    df = _scored(spark, sf_dir)
    part = lambda y: df.where(F.col("label") == y).agg(F.avg("score").alias("auc"), F.avg(F.col("score") * F.col("score")).alias("f1"))
    got = M.mle_ratio(part(0), part(1))
    return got.select(*(F.round(c, 9).alias(c) for c in ("trtr_auc", "trtr_f1", "tstr_auc", "tstr_f1", "auc_ratio", "f1_ratio")), "approved")
