"""Column expressions used across the library."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for null in messy inputs.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "None")
NULL_TOKEN, UNKNOWN_TOKEN = "__NULL__", "__UNKNOWN__"


def null_tokens(col: Column) -> Column:
    """Exact null tokens become null."""
    return F.when(col.isin(*NULL_TOKENS), F.lit(None)).otherwise(col)


def lenient_double(col: Column) -> Column:
    """Double, or null where the value cannot be read as one."""
    return col.try_cast("double")


def normalise_category(col: Column, kind: T.DataType) -> Column:
    """Text of a category; null and NaN are a category of their own."""
    empty = col.isNull() | F.isnan(col) if isinstance(kind, (T.FloatType, T.DoubleType)) else col.isNull()
    return F.when(empty, F.lit(NULL_TOKEN)).otherwise(col.cast("string"))


def cyclical(col: Column) -> dict[str, Column]:
    """Month, weekday and hour of a date or time as points on circles."""
    parts = {"month": (F.month(col), 12), "weekday": (F.dayofweek(col), 7), "hour": (F.hour(col.cast("timestamp_ntz")), 24)}
    return {f"{name}_{f}": fn(2 * math.pi * x / n) for name, (x, n) in parts.items() for f, fn in (("sin", F.sin), ("cos", F.cos))}


def safe_ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is within 1e-12 of 0."""
    return F.when(F.abs(den) > 1e-12, num / den).otherwise(F.lit(0.0))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 7e-8 (rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function on [1e-7, 1 - 1e-7]."""
    p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    # Coefficients of a public rational approximation (relative error 1.2e-9).
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)

    def poly(x, coefficients):
        out = F.lit(0.0)
        for k in coefficients:
            out = out * x + k
        return out

    def tail(x):
        q = F.sqrt(-2 * F.log(x))
        return poly(q, c) / (poly(q, d) * q + 1)

    q = p - 0.5
    r = q * q
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(poly(r, a) * q / (poly(r, b) * r + 1))


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A key for tables that have none: hash of all columns and an occurrence number."""
    from pyspark.sql import Window

    h = F.xxhash64(*df.columns)
    n = F.row_number().over(Window.partitionBy("__h").orderBy(F.lit(1)))
    return df.withColumn("__h", h).withColumn("__n", n).withColumn(name, F.concat_ws("-", "__h", "__n")).drop("__h", "__n")
