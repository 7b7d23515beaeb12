"""Reversible encodings: quantile tables for numbers, vocabularies for categories."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NULL_TOKEN, UNKNOWN_TOKEN, lenient_double, normalise_category
from ..sources.scratch import written
from .metrics import value_places
from .sampling import rank_within

QUANTILES = 1000
MAP_LIMIT = 1000


def _finite(c: str) -> Column:
    x = lenient_double(F.col(f"`{c}`"))
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def fit_quantiles(df: DataFrame, columns: list[str], q: int = QUANTILES, exact: bool = True) -> DataFrame:
    """``(column_name, quantiles, references, fill_value)``, one row a column.

    ``min(max(n, 2), q)`` evenly spaced probabilities of the finite values, linearly
    interpolated; none gives ``[0.0, 0.0]``. Exact quantiles come from running counts of
    the distinct values of all columns at once; ``exact=False`` sketches them.
    """
    if exact:
        places, counts = value_places(df, {c: lenient_double(F.col(f"`{c}`")) for c in columns})
        places = written(places, "places")  # read three times
    else:
        counts = df.agg(*(F.count(_finite(c)).alias(c) for c in columns)).first().asDict()
    steps = {c: min(max(n, 2), q) - 1 for c, n in counts.items()}
    facts = df.sparkSession.createDataFrame([(c, counts[c], steps[c]) for c in columns], "column_name string, n long, steps long")
    refs = F.expr("transform(sequence(0L, steps), i -> i / CAST(steps AS DOUBLE))").alias("references")
    if exact:
        got = facts.join(exact_quantiles(places.join(F.broadcast(facts), "column_name")), "column_name", "left")  # a row a column
    else:
        lines = F.array(*(F.struct(F.lit(c).alias("column_name"), F.percentile_approx(_finite(c), [i / m for i in range(m + 1)], 100_000).cast("array<double>").alias("quantiles"), F.percentile_approx(_finite(c), 0.5, 100_000).alias("fill_value")) for c, m in steps.items()))
        got = facts.join(df.agg(lines.alias("x")).select(F.explode("x").alias("x")).select("x.*"), "column_name", "left")
    empty = F.col("n") == 0
    line = F.when(empty, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.col("quantiles")).alias("quantiles")
    return got.select("column_name", line, refs, F.when(empty, 0.0).otherwise(F.col("fill_value")).alias("fill_value"))


def exact_quantiles(run: DataFrame) -> DataFrame:
    """``column_name, quantiles, fill_value``: the numbers at k/steps for k from 0, and the
    median, from ``(column_name, v, lo, hi, n, steps)``.

    A distinct value fills the sorted places ``lo`` to ``hi - 1``; the quantiles that need
    one of these as their lower or upper neighbour follow by whole-number arithmetic."""
    run = run.withColumn("top", F.greatest(F.col("n") - 1, F.lit(1)))
    first = lambda place: f"greatest(0L, (({place}) * steps + top - 1L) div top)"  # noqa: E731  the first k with floor(k top / steps) >= place
    near = lambda lo, hi: F.expr(f"CASE WHEN least({first(hi)} - 1, steps) >= {first(lo)} THEN sequence({first(lo)}, least({first(hi)} - 1, steps)) ELSE array() END")
    own = ("column_name", "n", "steps")
    low = run.select(*own, "v", F.explode(near("lo", "hi")).alias("k")).select(*own, "k", F.col("v").alias("a"), F.lit(None).cast("double").alias("b"))
    high = run.select(*own, "v", F.explode(near("lo - 1", "hi - 1")).alias("k")).select(*own, "k", F.lit(None).cast("double").alias("a"), F.col("v").alias("b"))
    part = F.expr("(k * (n - 1) % steps) / CAST(steps AS DOUBLE)")
    at = low.unionByName(high).groupBy(*own, "k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    at = at.select("column_name", "k", (F.col("a") + F.coalesce(F.col("b") - F.col("a"), F.lit(0.0)) * part).alias("x"))
    line = at.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("quantiles"))
    holds = lambda place: F.max(F.when(F.expr(f"lo <= {place} AND hi > {place}"), F.col("v")))
    middle = run.groupBy("column_name").agg(((holds("(n - 1) div 2") + holds("n div 2")) / 2).alias("fill_value"))
    return line.join(middle, "column_name")


def lookup(keys: list[float], value, kind: str):
    """A column function: ``value(x, i)`` for each number, where ``i`` is the last of the
    sorted ``keys`` that is not above ``x`` (0 if none is). One Arrow batch at a time: a
    binary search as an expression would run row by row in the interpreter."""
    table = np.array(keys, np.float64)

    def run(x: pa.Array) -> pa.Array:
        x = x.to_numpy(zero_copy_only=False)
        return pa.array(value(x, np.maximum(np.searchsorted(table, x, side="right") - 1, 0)))

    return F.arrow_udf(run, kind)


@dataclass(frozen=True)
class Quantiles:
    """A fitted quantile table on the driver: at most ``q`` numbers a column."""

    column: str
    knots: tuple[float, ...]
    references: tuple[float, ...]
    fill: float

    @staticmethod
    def collect(table: DataFrame) -> dict[str, Quantiles]:
        out = {}
        for r in table.collect():
            run, top = [], -math.inf
            for v in r["quantiles"]:
                top = max(top, v)
                run.append(top)
            out[r["column_name"]] = Quantiles(r["column_name"], tuple(run), tuple(r["references"]), r["fill_value"])
        return out

    def encode(self, col: Column) -> Column:
        """Value to ``2p - 1``. A tied value gets the highest reference of its tie, and
        values below it lead up to the lowest."""
        x = lenient_double(col)
        x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(self.fill)).otherwise(x)
        ks, firsts, rs = [], [], []
        for k, r in zip(self.knots, self.references):
            if ks and ks[-1] == k:
                rs[-1] = r
            else:
                ks.append(k)
                firsts.append(r)
                rs.append(r)
        if len(ks) == 1:
            return (F.when(x < ks[0], -1.0).otherwise(1.0)).cast("float")
        knots, on = np.array(ks), np.array(rs)
        slope = np.r_[(np.array(firsts)[1:] - on[:-1]) / np.diff(knots), 0.0]

        def place(x, i):
            p = np.where(x < knots[0], 0.0, np.where(x > knots[-1], 1.0, on[i] + (x - knots[i]) * slope[i]))
            return (p * 2 - 1).astype(np.float32)

        return lookup(ks, place, "float")(x)

    def decode(self, col: Column) -> Column:
        """``2p - 1`` back to a value; the references are evenly spaced."""
        n = len(self.knots)
        knots, n = np.array(self.knots), len(self.knots)

        def value(x, _):
            u = np.clip((np.asarray(x, np.float64) + 1) / 2, 0.0, 1.0) * (n - 1)
            i = np.minimum(np.floor(np.nan_to_num(u)), n - 2).astype(np.int64)
            return knots[i] + (knots[i + 1] - knots[i]) * (u - i)

        return F.when(col.isNotNull(), lookup([0.0], value, "double")(F.coalesce(col.cast("double"), F.lit(0.0))))


def fit_vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, token, idx, freq)``: unknown is 0, null 1, then tokens from 2 in
    code-point order."""
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), normalise_category(F.col(f"`{c}`"), df.schema[c].dataType).alias("token")) for c in columns))
    freq = df.select(F.explode(each).alias("x")).groupBy("x.column_name", "x.token").agg(F.count(F.lit(1)).alias("freq"))
    tokens = freq.where(~F.col("token").isin(NULL_TOKEN, UNKNOWN_TOKEN))
    tokens = rank_within(tokens, "column_name", [F.col("token")], "idx").withColumn("idx", F.col("idx") + 1)
    fixed = df.sparkSession.createDataFrame([(c, t, i) for c in columns for t, i in ((UNKNOWN_TOKEN, 0), (NULL_TOKEN, 1))], "column_name string, token string, idx long")
    fixed = fixed.join(freq, ["column_name", "token"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("bigint"))
    return fixed.select("column_name", "token", "idx", "freq").unionByName(tokens.select("column_name", "token", "idx", "freq"))


def encode_category(df: DataFrame, vocabulary: DataFrame, column: str, out: str) -> DataFrame:
    """Token to index by a left join; unseen tokens get 0. The vocabulary is broadcast by
    Spark where it is small enough, and shuffled otherwise."""
    words = vocabulary.where(F.col("column_name") == column).select(F.col("token").alias("__token"), F.col("idx").alias("__idx"))
    got = df.join(words, normalise_category(F.col(f"`{column}`"), df.schema[column].dataType) == F.col("__token"), "left")
    return got.withColumn(out, F.coalesce("__idx", F.lit(0)).cast("bigint")).drop("__token", "__idx")


def decode_category(df: DataFrame, vocabulary: DataFrame, column: str, index: str, out: str) -> DataFrame:
    """Index to token: 1 is null, what is out of range is ``__UNKNOWN__``."""
    words = vocabulary.where(F.col("column_name") == column).select(F.col("token").alias("__token"), F.col("idx").alias("__idx"))
    got = df.join(words, F.col(index) == F.col("__idx"), "left")
    return got.withColumn(out, F.when(F.col(index) == 1, F.lit(None)).otherwise(F.coalesce("__token", F.lit(UNKNOWN_TOKEN)))).drop("__token", "__idx")


def encode_table(df: DataFrame, quantiles: dict[str, Quantiles], vocabulary: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``df`` with ``x_num`` (floats) and ``x_cat`` (indexes)."""
    out = df
    for i, c in enumerate(categorical):
        out = encode_category(out, vocabulary, c, f"__c{i}")
    x_num = F.array(*(quantiles[c].encode(F.col(f"`{c}`")) for c in numeric)).cast("array<float>")
    x_cat = F.array(*(F.col(f"__c{i}") for i in range(len(categorical)))).cast("array<bigint>")
    return out.withColumn("x_num", x_num).withColumn("x_cat", x_cat).drop(*(f"__c{i}" for i in range(len(categorical))))


def decode_table(df: DataFrame, quantiles: dict[str, Quantiles], vocabulary: DataFrame, numeric: list[str], categorical: list[str], types: dict[str, str], prefix: str = "") -> DataFrame:
    """Numbers first, then categories, cast back to their types; other columns go on."""
    out = df
    for i, c in enumerate(numeric):
        x = quantiles[c].decode(F.col("x_num")[i])
        out = out.withColumn(prefix + c, (F.round(x) if types[c] in ("tinyint", "smallint", "int", "bigint") else x).cast(types[c]))
    for i, c in enumerate(categorical):
        out = decode_category(out.withColumn("__i", F.col("x_cat")[i]), vocabulary, c, "__i", "__v").withColumn(prefix + c, F.col("__v").try_cast(types[c])).drop("__i", "__v")
    return out.drop("x_num", "x_cat")


def one_hot(vocabulary: DataFrame, column: str, col: Column) -> Column:
    """1.0 at the place of the category among the fitted tokens, which must be at most
    1,000; a token that was not seen is all zeros."""
    tokens = [r.token for r in vocabulary.where((F.col("column_name") == column) & (F.col("idx") > 1)).orderBy("idx").limit(MAP_LIMIT + 1).collect()]
    if len(tokens) > MAP_LIMIT:
        raise ValueError(f"{column} has more than {MAP_LIMIT} tokens: with_one_hot takes any number")
    return F.array(*(F.coalesce((col.cast("string") == t).cast("double"), F.lit(0.0)) for t in tokens)).cast("array<double>")


def with_one_hot(df: DataFrame, vocabulary: DataFrame, column: str, out: str) -> DataFrame:
    """The same as a column ``out``, for any number of tokens: the place comes from a join."""
    n = vocabulary.where((F.col("column_name") == column) & (F.col("idx") > 1)).count()
    got = encode_category(df, vocabulary, column, "__place")
    places = F.transform(F.sequence(F.lit(2), F.lit(n + 1)), lambda i: (i == F.col("__place")).cast("double")) if n else F.array().cast("array<double>")
    return got.withColumn(out, places).drop("__place")


def with_sparse(df: DataFrame, vocabulary: DataFrame, column: str, out: str) -> DataFrame:
    """The same as a sparse vector of one place, for the stages of ``pyspark.ml``: a row's
    memory does not depend on the vocabulary. The length is the number of fitted tokens;
    a token that was not seen is a vector of zeros."""
    n = vocabulary.where((F.col("column_name") == column) & (F.col("idx") > 1)).count()
    places = df.sparkSession.createDataFrame([(float(max(n - 1, 0)),)], "__place double")  # the encoder learns its length alone
    encoder = OneHotEncoder(inputCol="__place", outputCol=out, handleInvalid="keep").fit(places)
    place = F.when(F.col("__no") > 1, F.col("__no") - 2).otherwise(n + 1)
    return encoder.transform(encode_category(df, vocabulary, column, "__no").withColumn("__place", place.cast("double"))).drop("__no", "__place")


def sparse_features(df: DataFrame, vocabulary: DataFrame, numeric: list[str], categorical: list[str], out: str = "features") -> DataFrame:
    """``out``: numbers and one-hot places as one vector, sparse where that is smaller."""
    rows = df
    for i, c in enumerate(categorical):
        rows = with_sparse(rows, vocabulary, c, f"__v{i}")
    parts = [*numeric, *(f"__v{i}" for i in range(len(categorical)))]
    return VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep").transform(rows).drop(*(f"__v{i}" for i in range(len(categorical))))


def embedding_width(cardinality: int, rule: str = "log") -> int:
    """Width of a category's slice: by logarithm, or by the power rule up to 50."""
    if rule == "log":
        return max(2, math.ceil(math.log2(max(cardinality, 1))))
    return min(50, max(2, int(1.6 * cardinality**0.56)))


def assemble_latent(df: DataFrame, numbers: Column, lookups: list[tuple[Column, DataFrame]]) -> DataFrame:
    """``latent``: the numbers, then the looked-up vector of each category.

    Each codebook has ``(idx, vector)`` from index 0; indexes are clamped into it."""
    out, parts = df, [numbers.cast("array<double>")]
    for i, (index, book) in enumerate(lookups):
        top = book.agg(F.max("idx")).first()[0]
        small = book.select(F.col("idx").alias(f"__k{i}"), F.col("vector").cast("array<double>").alias(f"__v{i}"))
        out = out.withColumn(f"__i{i}", F.least(F.greatest(index, F.lit(0)), F.lit(top))).join(small, F.col(f"__i{i}") == F.col(f"__k{i}"), "left")
        parts.append(F.col(f"__v{i}"))
    drop = [f"__{a}{i}" for i in range(len(lookups)) for a in "kvi"]
    return out.withColumn("latent", F.concat(*parts)).drop(*drop)


def known_mask(df: DataFrame, columns: list[str], widths: dict[str, int]) -> Column:
    """1 for each latent place of a column with a value, else 0."""
    return F.concat(*(F.array_repeat(F.col(f"`{c}`").isNotNull().cast("tinyint"), widths.get(c, 1)) for c in columns))


def intervention_mask(columns: list[str], widths: dict[str, int], fixed: set[str]) -> Column:
    return F.concat(*(F.array_repeat(F.lit(int(c in fixed)).cast("tinyint"), widths.get(c, 1)) for c in columns))


def intervene(df: DataFrame, values: dict) -> DataFrame:
    """``do(col = value)``; a column that the table lacks is an error."""
    missing = [c for c in values if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


def noise_schedule(spark, steps: int, kind: str = "cosine") -> DataFrame:
    """``(t, beta, alpha_bar)`` for t from 0: a table of ``steps`` rows."""
    t = F.col("t").cast("double")
    rows = spark.range(steps).withColumnRenamed("id", "t")
    if kind == "cosine":
        f = lambda x: F.pow(F.cos((x / steps + 0.008) / 1.008 * math.pi / 2), 2)
        beta = F.least(F.greatest(1 - f(t + 1) / f(t), F.lit(1e-5)), F.lit(0.999))
    elif kind == "linear":
        beta = F.lit(1e-4) + t * ((0.02 - 1e-4) / max(steps - 1, 1))
    else:
        raise ValueError(f"unknown schedule {kind}")
    rows = rows.withColumn("beta", beta)
    run = F.exp(F.sum(F.log(1 - F.col("beta"))).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("alpha_bar", F.greatest(run, F.lit(1e-8)))


def noising_pairs(df: DataFrame, key: str, latent: str, width: int, steps: int, seed: int, kind: str = "cosine") -> DataFrame:
    """A timestep, normal noise and the noised latent for each row, from keyed numbers."""
    from ..functions.keyed import normal, uniform

    t = F.floor(uniform(key, seed, "t") * steps).cast("bigint")
    out = df.withColumn("t", t).withColumn("noise", F.array(*(normal(key, seed, f"e{i}") for i in range(width))))
    out = out.join(F.broadcast(noise_schedule(df.sparkSession, steps, kind).select("t", "alpha_bar")), "t")
    mixed = F.zip_with(latent, "noise", lambda x, e: F.sqrt("alpha_bar") * x + F.sqrt(1 - F.col("alpha_bar")) * e)
    return out.withColumn("noised", mixed)
