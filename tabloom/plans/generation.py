"""Queries of the fitted generator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import uniform_sql
from ..operators import generate as G
from ..operators.sampling import inject_nulls
from .registry import query, table

COLUMNS = ["c_acctbal", "c_nationkey", "c_mktsegment"]


def _model(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", *COLUMNS)
    return df, G.fit(df, "c_custkey", COLUMNS, seed=1)


@query()
def sample_rows(spark, sf_dir):
    df, model = _model(spark, sf_dir)
    return G.sample(spark, model, df.count(), 7)


@query()
def sample_mixture(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", *COLUMNS)
    model = G.fit(df, "c_custkey", COLUMNS, seed=1, components=3)
    return G.sample(spark, model, df.count(), 7)


@query()
def augment(spark, sf_dir):
    df, model = _model(spark, sf_dir)
    return G.augment(df, model, df.count() // 2, 7)


@query()
def balance(spark, sf_dir):
    df, model = _model(spark, sf_dir)
    n = df.count()
    return G.balance(df, model, "c_mktsegment", {"BUILDING": n // 2, "MACHINERY": n // 3, "HOUSEHOLD": 1}, 7)


@query(
    """WITH n AS (SELECT count(*) AS n FROM customer), g AS (SELECT c_mktsegment, count(*) AS k FROM customer GROUP BY 1)
SELECT c_mktsegment, greatest(k, CASE c_mktsegment WHEN 'BUILDING' THEN n // 2 WHEN 'MACHINERY' THEN n // 3 ELSE 0 END) AS n FROM g, n"""
)
def balance_counts(spark, sf_dir):
    """Every class has its target, none lost a row."""
    return balance(spark, sf_dir).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) + count(*) // 2 AS n, CAST(0 AS BIGINT) AS lost FROM customer")
def augment_kept(spark, sf_dir):
    """The number of rows, and of the table's own rows that are not among them."""
    got = augment(spark, sf_dir)
    lost = table(spark, sf_dir, "customer").select(*COLUMNS).exceptAll(got.select(*COLUMNS)).agg(F.count(F.lit(1)).alias("lost"))
    return got.agg(F.count(F.lit(1)).alias("n")).join(lost)


def _within(rows, df):
    """``rows`` with ``within``: every cell is there and lies in the table's range or tokens."""
    lo = df.agg(F.min("c_acctbal").alias("a0"), F.max("c_acctbal").alias("a1"), F.min("c_nationkey").alias("n0"), F.max("c_nationkey").alias("n1"), F.collect_set("c_mktsegment").alias("tokens"))
    ok = F.col("c_acctbal").between(F.col("a0"), F.col("a1")) & F.col("c_nationkey").between(F.col("n0"), F.col("n1")) & F.array_contains("tokens", F.col("c_mktsegment"))
    return rows.join(F.broadcast(lo)).withColumn("within", F.coalesce(ok, F.lit(False)))  # one row


@query("SELECT count(*) AS n, count(*) AS n_within FROM customer")
def sample_within(spark, sf_dir):
    """Sampled rows, and how many lie within the table's ranges and tokens."""
    df, model = _model(spark, sf_dir)
    got = _within(G.sample(spark, model, df.count(), 7), df)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if("within").alias("n_within"))


@query("SELECT c_custkey, 'BUILDING' AS c_mktsegment, true AS within FROM customer")
def counterfactual_fixed(spark, sf_dir):
    """One row a row, with the intervention in place and the other cells drawn anew."""
    df, model = _model(spark, sf_dir)
    got = G.counterfactual(df, model, "c_custkey", {"c_mktsegment": "BUILDING"}, 7)
    return _within(got, df).select("c_custkey", "c_mktsegment", "within")


def _holes(df):
    df = inject_nulls(df, "c_acctbal", "c_custkey", 0.5, 7)
    return inject_nulls(df, "c_mktsegment", "c_custkey", 0.3, 8)


@query()
def inpaint(spark, sf_dir):
    df, model = _model(spark, sf_dir)
    return G.inpaint(_holes(df), model, "c_custkey", 7)


@query(
    f"""SELECT c_custkey, c_nationkey, CASE WHEN {uniform_sql('c_custkey', 7, 'null-c_acctbal')} > 0.5 THEN c_acctbal END AS known_acctbal,
CASE WHEN {uniform_sql('c_custkey', 8, 'null-c_mktsegment')} > 0.3 THEN c_mktsegment END AS known_segment,
CASE WHEN c_custkey % 3 > 0 THEN 9007199254740993 + 2 * c_custkey END AS large, true AS filled FROM customer"""
)
def inpaint_known_kept(spark, sf_dir):
    """Known cells, and a column beside the model's with nulls and numbers no double holds."""
    df, model = _model(spark, sf_dir)
    holes = _holes(df).withColumn("large", F.expr("CASE WHEN c_custkey % 3 > 0 THEN 9007199254740993 + 2 * c_custkey END"))
    done = G.inpaint(holes, model, "c_custkey", 7)
    known = holes.select("c_custkey", F.col("c_acctbal").isNotNull().alias("a"), F.col("c_mktsegment").isNotNull().alias("m"))
    got = done.join(known, "c_custkey")
    full = F.col("c_acctbal").isNotNull() & F.col("c_mktsegment").isNotNull()
    return got.select("c_custkey", "c_nationkey", F.when(F.col("a"), F.col("c_acctbal")).alias("known_acctbal"), F.when(F.col("m"), F.col("c_mktsegment")).alias("known_segment"), "large", full.alias("filled"))


@query()
def counterfactual(spark, sf_dir):
    df, model = _model(spark, sf_dir)
    return G.counterfactual(df, model, "c_custkey", {"c_mktsegment": "BUILDING"}, 7)
