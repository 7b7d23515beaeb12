"""Queries of splits, samples, unions and class logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import normal_sql, uniform_sql
from ..operators import sampling as S
from ..operators.sets import class_counts as counts
from ..operators.sets import class_deficit as deficit
from ..operators.sets import union_relaxed as union
from .registry import query, table


def _rank(key: str, seed: int, stream: str, part: str = "") -> str:
    return f"row_number() OVER ({part} ORDER BY {uniform_sql(key, seed, stream)}, {key})"


@query(f"SELECT o_orderkey, {_rank('o_orderkey', 42, 'split')} <= floor(0.7 * (SELECT count(*) FROM orders) + 1e-9) AS in_train FROM orders")
def split_random(spark, sf_dir):
    return S.split_random(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.7, 42)


@query(
    f"""SELECT o_orderkey, o_orderpriority, r <= round(0.2 * n) AS in_test FROM (SELECT o_orderkey, o_orderpriority,
{_rank('o_orderkey', 42, 'strat', 'PARTITION BY o_orderpriority')} AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""
)
def split_stratified(spark, sf_dir):
    return S.split_stratified(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.2, 42)


@query(f"SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY {uniform_sql('o_orderkey', 42, 'fold')}, o_orderkey) AS INTEGER) AS fold FROM orders")
def kfold(spark, sf_dir):
    return S.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5, 42)


@query(f"SELECT c_custkey, c_mktsegment FROM customer ORDER BY {uniform_sql('c_custkey', 11, 'sample')}, c_custkey LIMIT 100")
def sample_n(spark, sf_dir):
    return S.sample_n(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 100, 11)


def _boot(seed: int, n: str = "(SELECT count(*) FROM customer)") -> str:
    return f"""(SELECT draw, r.* FROM (SELECT i AS draw, CAST(floor({uniform_sql('i', seed, 'boot')} * (SELECT count(*) FROM customer)) + 1 AS BIGINT) AS k FROM range({n}) AS t(i)) d
JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) r ON d.k = r.k)"""


@query(f"SELECT draw, c_custkey FROM {_boot(13)}")
def bootstrap_idx(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey")
    return S.bootstrap(df, "c_custkey", df.count(), 13)


@query(f"SELECT draw, c_custkey, round(c_acctbal + {normal_sql('draw', 13, 'jitter-c_acctbal')} * 0.01 * (SELECT stddev_samp(c_acctbal) FROM customer), 5) AS c_acctbal, c_mktsegment FROM {_boot(13)}")
def bootstrap_jitter(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    got = S.bootstrap_jitter(df, "c_custkey", ["c_acctbal"], df.count(), 13)
    return got.select("draw", "c_custkey", F.round("c_acctbal", 5).alias("c_acctbal"), "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE (c_mktsegment = 'BUILDING' AND r <= 10) OR (c_mktsegment = 'MACHINERY' AND r <= 25)")
def take_per_class(spark, sf_dir):
    wanted = spark.createDataFrame([("BUILDING", 10), ("MACHINERY", 25)], "label string, n long")
    return S.take_per_class(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", wanted, "c_custkey")


@query("SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1")
def class_counts(spark, sf_dir):
    return counts(table(spark, sf_dir, "customer"), "c_mktsegment")


TARGETS = {"BUILDING": 400, "MACHINERY": 100, "SPACE": 7}


@query(
    """SELECT label, target, coalesce(n, 0) AS current, greatest(0, target - coalesce(n, 0)) AS deficit FROM (VALUES ('BUILDING', CAST(400 AS BIGINT)), ('MACHINERY', CAST(100 AS BIGINT)), ('SPACE', CAST(7 AS BIGINT))) AS t(label, target)
LEFT JOIN (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1) USING (label)"""
)
def class_deficit(spark, sf_dir):
    return deficit(table(spark, sf_dir, "customer"), "c_mktsegment", TARGETS)


@query("SELECT CAST(s_suppkey AS DOUBLE) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS place FROM supplier UNION ALL SELECT c_acctbal, c_name, c_mktsegment FROM customer")
def union_relaxed(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS place")
    return union(a, table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS place", "c_name AS name", "c_acctbal AS id"))
