"""Unions and class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def supertype(a: T.DataType, b: T.DataType) -> str:
    """The type that holds both: whole numbers widen, with floats they are doubles, decimals
    keep all digits before and after the point (38 at most, those after it give way first),
    a date and a time are a time, anything with text is text."""
    x, y = a.simpleString(), b.simpleString()
    if x == y or y == "void":
        return x
    if x == "void":
        return y
    if "string" in (x, y):
        return "string"
    if x in ORDER and y in ORDER:
        wide = max(x, y, key=ORDER.index)
        return "double" if wide == "float" and {x, y} != {"float"} else wide
    digits = [_digits(t) for t in (a, b)]
    if all(digits):
        whole, part = max(p - s for p, s in digits), max(s for _, s in digits)
        return f"decimal({min(38, whole + part)},{min(part, max(0, 38 - whole))})"
    if any(isinstance(t, T.DecimalType) for t in (a, b)) and {x, y} & {"float", "double"}:
        return "double"
    times = ("date", "timestamp_ntz", "timestamp")
    if x in times and y in times:
        return max(x, y, key=times.index)
    return "string"


def _digits(kind: T.DataType) -> tuple[int, int] | None:
    """Precision and scale of a decimal or a whole number."""
    if isinstance(kind, T.DecimalType):
        return kind.precision, kind.scale
    return {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0)}.get(kind.simpleString())


def union_relaxed(top: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, in the columns of the first; types widen where they differ. A table that
    lacks a column is an error."""
    out = top
    for other in others:
        missing = [c for c in top.columns if c not in other.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        kinds = {c: supertype(out.schema[c].dataType, other.schema[c].dataType) for c in top.columns}
        cast = lambda d: d.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in top.columns))  # noqa: B023, E731
        out = cast(out).unionByName(cast(other))
    return out


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_deficit(df: DataFrame, label: str, targets: dict[str, int]) -> DataFrame:
    """``(label, target, current, deficit)`` of each requested label."""
    if label not in df.columns:
        raise ValueError(f"no such column: {label}")
    wanted = df.sparkSession.createDataFrame([(str(k), int(v)) for k, v in targets.items()], "label string, target long")
    got = wanted.join(class_counts(df, label), "label", "left").withColumn("current", F.coalesce("n", F.lit(0)).cast("bigint"))
    return got.select("label", "target", "current", F.greatest(F.lit(0).cast("bigint"), F.col("target") - F.col("current")).alias("deficit"))
