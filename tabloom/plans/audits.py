"""Queries of the privacy and utility audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import normal_sql, uniform_sql
from ..operators import audit as A
from ..operators.sampling import bootstrap_jitter
from .neighbours import CAT, NEAREST, NUM, OWN, _real, synthetic
from .registry import query, table

#: The attack on all rows.
WHOLE = A.ShadowConfig()


@query(
    f"""WITH d AS ({NEAREST}), t AS (SELECT quantile_cont(dist, 0.01) AS t FROM ({OWN})), s AS (SELECT t, median(dist) AS m, quantile_cont(dist, 0.05) AS p, avg(CASE WHEN dist < t THEN 1.0 ELSE 0.0 END) AS below FROM d, t GROUP BY t)
SELECT round(t, 6) AS dcr_threshold, round(m, 6) AS dcr_median, round(p, 6) AS dcr_p5, round(below, 9) AS memorized_share, below < 0.01 AS dcr_approved, t = 0 AS threshold_is_zero FROM s"""
)
def dcr_audit(spark, sf_dir):
    real = _real(spark, sf_dir)
    got = A.dcr_audit(real, synthetic(real), "c_custkey", NUM, CAT)
    return got.select(F.round("dcr_threshold", 6).alias("dcr_threshold"), F.round("dcr_median", 6).alias("dcr_median"), F.round("dcr_p5", 6).alias("dcr_p5"), F.round("memorized_share", 9).alias("memorized_share"), "dcr_approved", "threshold_is_zero")


def _shadow_sql(k: int, seed: int, shadows: int, share: float) -> str:
    """The shadows in SQL: the split into random halves, the bootstrap, the features."""
    u = lambda key, s, stream: uniform_sql(key, s, stream)
    parts = [f"WITH base AS (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_mktsegment FROM customer)"]
    outs = []
    for s in range(shadows):
        z = seed + s
        member = f"row_number() OVER (ORDER BY {u('c_custkey', z, 'split')}, c_custkey) <= floor(0.5 * (SELECT count(*) FROM base) + 1e-9)"
        parts.append(
            f"""p{s} AS (SELECT *, {member} AS m FROM base),
r{s} AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM p{s} WHERE m),
g{s} AS (SELECT c_acctbal + {normal_sql('i', z, 'jitter-c_acctbal')} * 0.01 * (SELECT stddev_samp(c_acctbal) FROM r{s}) AS a, c_nationkey + {normal_sql('i', z, 'jitter-c_nationkey')} * 0.01 * (SELECT stddev_samp(c_nationkey) FROM r{s}) AS n, c_mktsegment AS c
  FROM range((SELECT CAST(greatest(1, floor(count(*) * {share})) AS BIGINT) FROM r{s})) AS t(i) JOIN r{s} ON k = floor({u('i', z, 'boot')} * (SELECT count(*) FROM r{s})) + 1)"""
        )
        for label, cond in ((1, "m"), (0, "NOT m")):
            f = f"(SELECT c_acctbal AS a, c_nationkey AS n, c_mktsegment AS c FROM p{s} WHERE {cond} UNION ALL SELECT a, n, c FROM g{s})"
            outs.append(
                f"""SELECT c_custkey, round(min(d), 6) AS d_min, round(avg(d), 6) AS d_mean, round(stddev_pop(d), 6) AS d_std, round(min(d) / greatest(avg(d), 1e-8), 6) AS d_ratio, {label} AS label, {s} AS shadow_id
FROM (SELECT x.c_custkey, sqrt(pow((x.c_acctbal - g.a) / f.a, 2) + pow((x.c_nationkey - g.n) / f.n, 2) + CASE WHEN x.c_mktsegment = g.c THEN 0 ELSE 2 END) AS d,
row_number() OVER (PARTITION BY x.c_custkey ORDER BY sqrt(pow((x.c_acctbal - g.a) / f.a, 2) + pow((x.c_nationkey - g.n) / f.n, 2) + CASE WHEN x.c_mktsegment = g.c THEN 0 ELSE 2 END)) AS r
FROM p{s} x, g{s} g, (SELECT stddev_pop(a) AS a, stddev_pop(n) AS n FROM {f}) f WHERE x.{'m' if label else 'm = false'}) WHERE r <= {k} GROUP BY 1"""
            )
    return ", ".join(parts) + " " + " UNION ALL ".join(outs)


def _shadow_rows(spark, sf_dir):
    return _real(spark, sf_dir).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))


@query(_shadow_sql(WHOLE.n_neighbors, WHOLE.seed, WHOLE.n_shadow_models, WHOLE.multiplier), "shadow_set")
def shadow_set_whole(spark, sf_dir):
    got = A.shadow_set(_shadow_rows(spark, sf_dir), "c_custkey", NUM, CAT, WHOLE)
    return got.select("c_custkey", *(F.round(c, 6).alias(c) for c in A.FEATURES), "label", "shadow_id")


@query()
def mia_scores(spark, sf_dir):
    real = _shadow_rows(spark, sf_dir)
    members, others = real.where("c_custkey % 2 = 0"), real.where("c_custkey % 2 = 1")
    return A.mia_scores(members, synthetic(members), "c_custkey", NUM, CAT, WHOLE, holdout=others)


@query(None, "mia_audit")
def mia_audit_whole(spark, sf_dir):
    real = _shadow_rows(spark, sf_dir)
    return A.mia_audit(real, synthetic(real), "c_custkey", NUM, CAT, WHOLE)


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def _made(df):
    return bootstrap_jitter(df, "doc_id", ["n_chars"], df.count(), 5).drop("doc_id").withColumnRenamed("draw", "doc_id")


@query()
def utility_audit(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return A.utility_audit(df, _made(df), "doc_id", "quality", ["n_chars"], ["lang", "source"])


@query()
def utility_audit_200(spark, sf_dir):
    """At the full number of boosting rounds."""
    df = _labelled(spark, sf_dir)
    return A.utility_audit(df, _made(df), "doc_id", "quality", ["n_chars"], ["lang", "source"], rounds=200)


@query()
def full_audit(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    got = A.full_audit(df, _made(df).select(*df.columns), "doc_id", label="quality", config=WHOLE)
    return got.select("overall_verdict", "privacy_approved", F.to_json(F.struct("dcr", "mia", "utility")).alias("report"))
