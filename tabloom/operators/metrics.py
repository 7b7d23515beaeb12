"""Metrics of scores, distances and distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from ..sources.scratch import written

RANGE_ROWS, MAX_RANGES = 200_000, 2000


def in_ranges(df: DataFrame, order: list[Column], rows: int, range_rows: int) -> DataFrame:
    """``df`` dealt to ranges of ``order``, numbered in ``__part``, written.

    There are never more than 2,000 of them, so what is known of each may be broadcast."""
    parts = min(MAX_RANGES, -(-rows // range_rows))
    return written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: Column | list[Column], sums: dict[str, str], range_rows: int = RANGE_ROWS, rows: int | None = None) -> DataFrame:
    """Running totals over the whole table in ``order``; long tables are summed by ranges
    of the order, and shifted by the totals of the ranges before. The table is written
    first, unless its number of ``rows`` is given."""
    order = order if isinstance(order, list) else [order]
    df = written(df, "totals") if rows is None else df
    n = df.count() if rows is None else rows
    if n <= range_rows:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    dealt = in_ranges(df, order, n, range_rows)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__part").agg(*(F.sum(c).alias(f"__{o}") for o, c in sums.items()))
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in sums))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({o: F.sum(c).over(own) for o, c in sums.items()}).join(F.broadcast(totals), "__part")
    return out.withColumns({o: F.col(o) + F.col(f"__{o}") for o in sums}).drop("__part", *(f"__{o}" for o in sums))


def value_places(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """``(column_name, v, lo, hi)`` of each distinct number of each column, and how many
    numbers each column has: in sorted order ``v`` fills the places ``lo`` to ``hi - 1``.

    All columns go through one pre-aggregated shuffle. Nulls, NaN and infinities are left
    out; nothing but a count a column reaches the driver.
    """
    known = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), known(x.cast("double")).alias("v")) for c, x in columns.items()))).alias("x")
    counts = df.select(cells).select("x.*").where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts, "values")
    per = {r.column_name: r for r in counts.groupBy("column_name").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    run = running(counts, [F.col("column_name"), F.col("v")], {"hi": "c"}, rows=sum(r.rows for r in per.values()))
    first, before = F.lit(0).cast("long"), 0
    for c in sorted(per, key=str.encode):
        first = F.when(F.col("column_name") == c, before).otherwise(first)
        before += per[c].n
    run = run.withColumn("hi", F.col("hi") - first)
    return run.select("column_name", "v", (F.col("hi") - F.col("c")).alias("lo"), "hi"), {c: per[c].n if c in per else 0 for c in columns}


def percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact percentiles of each column, linearly interpolated; None for a column without
    numbers. They come from running counts, so no task holds a column's values."""
    places, counts = value_places(df, columns)
    picks, aggs = [], []
    for c, n in counts.items():
        for share in shares if n else []:
            at = share * (n - 1)
            for place in (math.floor(at), math.ceil(at)):
                aggs.append(F.max(F.when((F.col("column_name") == c) & (F.col("lo") <= place) & (F.col("hi") > place), F.col("v"))).alias(f"x{len(aggs)}"))
            picks.append((c, at - math.floor(at)))
    got = list(places.agg(*aggs).first()) if aggs else []
    out: dict[str, list[float | None]] = {c: [] if n else [None] * len(shares) for c, n in counts.items()}
    for k, (c, part) in enumerate(picks):
        low, high = got[2 * k], got[2 * k + 1]
        out[c].append(low + (high - low) * part)
    return out


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve; ties count half, a single class gives 0.5."""
    run = running(_by_score(df, score, label), F.col("s").asc(), {"cum": "neg"})
    got = run.agg(F.sum(F.col("pos") * (F.col("cum") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return got.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise average precision: recall gained at each score, times precision there."""
    run = running(_by_score(df, score, label), F.col("s").desc(), {"tp": "pos", "fp": "neg"})
    got = run.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"), F.sum("pos").alias("p"))
    return got.select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).otherwise(0.0).alias("average_precision"))


def f1(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """F1 of ``score >= threshold``; nothing to divide by gives 0."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    got = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    return got.select(safe_ratio(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")).alias("f1"))


def distance_summary(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Median, 5th percentile and the share strictly below a threshold."""
    df = written(df.select(col), "distances")
    median, p5 = percentiles(df, {col: F.col(col)}, [0.5, 0.05])[col]
    below = F.avg((F.col(col) < threshold).cast("double")).alias("share_below")
    return df.agg(below).select(F.lit(median).cast("double").alias("median"), F.lit(p5).cast("double").alias("p5"), "share_below")


def class_shares(real: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """``(label, real_share, other_share, diff)`` over the labels of both."""

    def shares(df, name):
        n = df.agg(F.count(F.lit(1)).alias("__n"))
        per = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("__NULL__")).alias("label")).agg(F.count(F.lit(1)).alias("c"))
        return per.join(F.broadcast(n)).select("label", (F.col("c") / F.col("__n")).alias(name))

    both = shares(real, "real_share").join(shares(other, "other_share"), "label", "full").fillna(0.0, ["real_share", "other_share"])
    return both.withColumn("diff", F.col("other_share") - F.col("real_share"))


def kde(df: DataFrame, col: str, low: float, high: float, points: int) -> DataFrame:
    """``(g, density)``: a Gaussian kernel density on an even grid, Scott's bandwidth.

    Equal values meet first, so the grid multiplies distinct values, not rows."""
    x = F.col(col).cast("double")
    stats = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s")).first()
    n, h = stats.n, (stats.s or 1.0) * max(stats.n, 1) ** -0.2
    grid = F.array(*(F.lit(low + (high - low) * i / (points - 1)) for i in range(points)))
    each = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    each = each.select("x", "c", F.posexplode(grid).alias("g", "at"))
    bump = F.exp(-F.pow((F.col("at") - F.col("x")) / h, 2) / 2) * F.col("c")
    return each.groupBy("g").agg(F.first("at").alias("at"), (F.sum(bump) / (n * h * math.sqrt(2 * math.pi))).alias("density"))


def kde_binned(df: DataFrame, col: str, low: float, high: float, points: int, per_width: int = 64) -> DataFrame:
    """``kde`` by linear binning: each value is shared out to the two nearest of bins
    ``per_width`` to a bandwidth, and the kernel is summed over the bins that are not empty.

    The work is in proportion to the rows, plus grid points times bins. A density differs
    from ``kde`` by at most ``0.4 / (8 * per_width ** 2)`` over the bandwidth, which is a
    32,000th of the kernel's height at 64 bins. Nulls count for nothing; no row gives zeros."""
    x = F.col(col).cast("double")
    stats = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s")).first()
    n, h = stats.n, (stats.s or 1.0) * max(stats.n, 1) ** -0.2
    step = h / per_width
    place = (x - low) / step
    bins = df.where(x.isNotNull()).select(F.floor(place).alias("i"), (place - F.floor(place)).alias("w"))
    bins = bins.groupBy("i").agg(F.sum(1 - F.col("w")).alias("a"), F.sum("w").alias("b"))
    grid = F.array(*(F.lit(low + (high - low) * i / (points - 1)) for i in range(points)))
    each = bins.select("*", F.posexplode(grid).alias("g", "at"))
    bump = lambda i: F.exp(-F.pow((F.col("at") - low - i * step) / h, 2) / 2)
    total = F.sum(F.col("a") * bump(F.col("i")) + F.col("b") * bump(F.col("i") + 1))
    found = each.groupBy("g").agg((total / (max(n, 1) * h * math.sqrt(2 * math.pi))).alias("density"))
    places = df.sparkSession.createDataFrame([(i, low + (high - low) * i / (points - 1)) for i in range(points)], "g int, at double")
    return places.join(found, "g", "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def mle_ratio(real: DataFrame, synthetic: DataFrame, minimum: float = 0.90) -> DataFrame:
    """Ratios of two one-row tables ``(auc, f1)`` and the verdict on the first."""
    a = real.select(F.col("auc").alias("trtr_auc"), F.col("f1").alias("trtr_f1"))
    both = a.join(F.broadcast(synthetic.select(F.col("auc").alias("tstr_auc"), F.col("f1").alias("tstr_f1"))))
    both = both.withColumn("auc_ratio", safe_ratio(F.col("tstr_auc"), F.col("trtr_auc"))).withColumn("f1_ratio", safe_ratio(F.col("tstr_f1"), F.col("trtr_f1")))
    return both.withColumn("approved", F.col("auc_ratio") >= minimum)
