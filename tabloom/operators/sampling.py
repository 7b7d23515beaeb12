"""Ranks, splits and samples from keyed random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import normal, uniform
from ..sources.scratch import written
from .metrics import RANGE_ROWS, in_ranges, running


def global_rank(df: DataFrame, order: list[Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with a row number over the whole table, from 1.

    Small tables use one sorted task. Larger ones are dealt to at most 2,000 ranges of the
    order, ranked inside, and shifted by the sizes of the ranges before.
    ``order`` must be unique for the numbers to be the same each time.
    """
    n = df.count()
    if n <= range_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    dealt = in_ranges(df, order, n, range_rows)
    sizes = dealt.groupBy("__part").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("bigint"))
    return inside.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def rank_within(df: DataFrame, group: str, order: list[Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with a row number inside each group, from 1; a null is a group.

    It is the rank over the whole table, by group and order, less the rows of the groups
    before, so a group may hold most of the table."""
    rank = global_rank(df, [F.col(group).asc_nulls_first(), *order], "__all", range_rows)
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(sizes, F.col("__g").asc_nulls_first(), {"__upto": "__n"}, range_rows)
    starts = written(upto.select("__g", (F.col("__upto") - F.col("__n")).alias("__start")), "starts")  # a written side lets the join split a large group
    return rank.join(starts, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col("__all") - F.col("__start")).drop("__all", "__g", "__start")


def _random_rank(df: DataFrame, key: str, seed: int, stream: str) -> DataFrame:
    return global_rank(df.withColumn("__u", uniform(key, seed, stream)), [F.col("__u"), F.col(key)], "__rank").drop("__u")


def split_random(df: DataFrame, key: str, fraction: float, seed: int, stream: str = "split") -> DataFrame:
    """``in_train``: a random ``floor(fraction * n)`` rows."""
    take = int(fraction * df.count() + 1e-9)
    return _random_rank(df, key, seed, stream).withColumn("in_train", F.col("__rank") <= take).drop("__rank")


def split_stratified(df: DataFrame, key: str, label: str, test_share: float, seed: int) -> DataFrame:
    """``in_test``: of each class ``round(test_share * n)`` random rows."""
    ranked = rank_within(df.withColumn("__u", uniform(key, seed, "strat")), label, [F.col("__u"), F.col(key)], "__rank")
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.round(F.count(F.lit(1)) * test_share).cast("bigint").alias("__take"))
    out = ranked.join(sizes, F.col(label).eqNullSafe(F.col("__label")))
    return out.withColumn("in_test", F.col("__rank") <= F.col("__take")).drop("__u", "__rank", "__take", "__label")


def kfold(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``fold`` from 1: a shuffled split in k; the first n mod k folds are one larger."""
    n = df.count()
    k = max(1, min(k, n))
    size, over = divmod(n, k)
    r, big = F.col("__rank") - 1, (size + 1) * over
    fold = F.when(r < big, F.floor(r / (size + 1))).otherwise(over + F.floor((r - big) / max(size, 1))) + 1
    return _random_rank(df, key, seed, "fold").withColumn("fold", fold.cast("int")).drop("__rank")


def sample_n(df: DataFrame, key: str, n: int, seed: int, stream: str = "sample") -> DataFrame:
    """n rows without replacement (a top-k, not a full sort)."""
    return df.withColumn("__u", uniform(key, seed, stream)).orderBy("__u", key).limit(n).drop("__u")


def bootstrap(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows with replacement: draw ``draw`` takes the row of rank floor(u * size) + 1."""
    size = df.count()
    ranked = global_rank(df, [F.col(key)], "__rank")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("__rank", F.floor(uniform("draw", seed, "boot") * size) + 1)
    return draws.join(ranked, "__rank").drop("__rank")


def bootstrap_jitter(df: DataFrame, key: str, numbers: list[str], n: int, seed: int, share: float = 0.01) -> DataFrame:
    """Bootstrap rows; numbers get normal noise of 1% of their sample deviation."""
    spread = df.agg(*(F.stddev_samp(F.col(c).cast("double")).alias(c) for c in numbers)).first()
    out = bootstrap(df, key, n, seed)
    for c in numbers:
        sd = spread[c] if spread[c] else 0.0
        out = out.withColumn(c, F.col(c).cast("double") + normal("draw", seed, f"jitter-{c}") * (share * sd if sd > 0 else 1e-6))
    return out


def split_each(df: DataFrame, by: str, key: str, fraction: float, seed: int, stream: str = "split") -> DataFrame:
    """``split_random`` of every group of ``by`` (small whole numbers, added to the seed), in
    one pass over all of them: ``in_train`` for a random ``floor(fraction * n)`` rows each."""
    ranked = rank_within(df.withColumn("__u", uniform(key, F.lit(seed) + F.col(by), stream)), by, [F.col("__u"), F.col(key)], "__rank")
    take = df.groupBy(F.col(by).alias("__by")).agg(F.floor(F.count(F.lit(1)) * fraction + 1e-9).alias("__take"))
    return ranked.join(take, F.col(by) == F.col("__by")).withColumn("in_train", F.col("__rank") <= F.col("__take")).drop("__u", "__rank", "__take", "__by")


def bootstrap_jitter_each(df: DataFrame, by: str, key: str, numbers: list[str], multiplier: float, seed: int, share: float = 0.01) -> DataFrame:
    """``bootstrap_jitter`` of every group of ``by`` (whole numbers, added to the seed), in
    one pass: ``floor(multiplier * n)`` rows each, at least one, numbered in ``draw``."""
    spread = [F.stddev_samp(F.col(c).cast("double")).alias(f"__sd_{c}") for c in numbers]
    n = F.count(F.lit(1))
    sizes = written(df.groupBy(F.col(by).alias("__by")).agg(n.alias("__n"), F.greatest(F.lit(1), F.floor(n * multiplier)).cast("bigint").alias("__take"), *spread), "bootstrap-sizes")
    most = sizes.agg(F.max("__take").alias("m"), F.max("__by").alias("b")).first()
    ranked = rank_within(df, by, [F.col(key)], "__rank")
    draws = df.sparkSession.range((most.b + 1) * most.m if most.m else 0).select(F.expr(f"int(id div {most.m or 1})").alias("__by"), (F.col("id") % (most.m or 1)).alias("draw"))
    draws = draws.join(F.broadcast(sizes), "__by").where("draw < __take")  # a row a group
    z = F.lit(seed) + F.col("__by")
    draws = draws.withColumn("__draw", F.floor(uniform("draw", z, "boot") * F.col("__n")) + 1)
    out = draws.join(ranked, (F.col("__by") == F.col(by)) & (F.col("__draw") == F.col("__rank")))
    for c in numbers:
        sd = F.coalesce(F.col(f"__sd_{c}"), F.lit(0.0))
        out = out.withColumn(c, F.col(c).cast("double") + normal("draw", z, f"jitter-{c}") * F.when(sd > 0, sd * share).otherwise(1e-6))
    return out.drop("__by", "__n", "__take", "__draw", "__rank", *(f"__sd_{c}" for c in numbers))


def take_per_class(df: DataFrame, label: str, wanted: DataFrame, key: str) -> DataFrame:
    """Up to ``wanted.n`` rows of each label, first by key."""
    got = df.join(wanted.select(F.col("label").alias("__label"), F.col("n").alias("__n")), F.col(label).cast("string") == F.col("__label"))
    got = rank_within(got, "__label", [F.col(key)], "__rank")
    return got.where("__rank <= __n").drop("__label", "__n", "__rank")


def inject_nulls(df: DataFrame, col: str, key: str, share: float, seed: int) -> DataFrame:
    """``col`` becomes null where the keyed uniform does not exceed ``share``."""
    return df.withColumn(col, F.when(uniform(key, seed, f"null-{col}") > share, F.col(col)))


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)
