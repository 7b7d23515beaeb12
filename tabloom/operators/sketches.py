"""Profiles that grow with new files: mergeable sketches kept beside the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lenient_double

#: Sizes of the sketches: 2 ** LOG_BUCKETS registers, and the length of a quantile level.
LOG_BUCKETS, QUANTILE_K = 12, 400
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: ``column_name, rows, nulls, low, high, distinct, places``, of which
    the last two are a distinct-count and a quantile sketch (null for what is no number).

    One aggregate over the table, whose partial sums are of a fixed size; the state of many
    files is a few kilobytes a column each, to be kept and merged (``merged``)."""
    names = columns or df.columns
    aggs = []
    for i, c in enumerate(names):
        kind, col = df.schema[c].dataType.simpleString(), F.col(f"`{c}`")
        number = lenient_double(col) if kind.startswith(NUMBERS) else F.lit(None).cast("double")
        token = col.cast("string") if kind not in ("binary",) else F.hex(col)
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count_if(col.isNull()).alias("nulls"), F.min(number).alias("low"), F.max(number).alias("high"),
                F.hll_sketch_agg(token, F.lit(LOG_BUCKETS)).alias("distinct"), F.kll_sketch_agg_double(number, F.lit(QUANTILE_K)).alias("places"),
            ).alias(f"s{i}")
        )
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*(F.col(f"s{i}") for i in range(len(names))))).alias("s")).select("s.*")


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows that the states have seen, without reading these again."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct", F.lit(False)).alias("distinct"), F.kll_merge_agg_double("places").alias("places"),
    )


def readout(found: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """``column_name, rows, null_ratio, n_unique, low, high, quantiles`` of a state. The
    distinct count is within about 1.6 % (one standard error), a quantile's rank within
    about 1 % of the rows."""
    known = F.col("low").isNotNull()
    at = F.when(known, F.kll_sketch_get_quantile_double("places", F.array(*(F.lit(float(s)) for s in shares))))
    return found.select(
        "column_name", "rows", (F.col("nulls") / F.greatest(F.col("rows"), F.lit(1))).alias("null_ratio"), F.hll_sketch_estimate("distinct").alias("n_unique"), "low", "high", at.alias("quantiles")
    )


def grown(path: str, new: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The state kept at ``path``, if there is one, merged with that of new rows, which is
    added there as a further file; only the new rows are read."""
    spark = new.sparkSession
    state(new, columns).coalesce(1).write.mode("append").parquet(path)  # a row a column
    return merged(spark.read.parquet(path))
