"""Column profiles: one row a column, from one melt and one two-level aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NULL_TOKEN

#: Fixed value: names that mark an identifier.
IDENTIFIER_NAME = r"(?i)(^id$|_id$|cpf|cnpj|cns|cartao|prontuario|aih|nis|sus|uuid|guid|email|telefone|phone)"
#: The limits of the classifier; the names of topologies, strategies and reasons below are fixed too.
RARE, HIGH, DISCRETE = 5, 50, 15
LONG_TEXT, SPARSE_RATIO, UNIQUE_RATIO, UNIQUE_ROWS = 80, 0.95, 0.98, 1000

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(kind: T.DataType) -> str:
    """The kinds of types that the classifier tells apart."""
    for name, types in (("boolean", T.BooleanType), ("datetime", TIMES), ("integer", INTEGERS), ("float", (T.FloatType, T.DoubleType)), ("string", T.StringType)):
        if isinstance(kind, types):
            return name
    return "other"


def melt(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value)``: every cell as text; -0.0 is 0.0; nested cells as JSON."""
    pairs = []
    for c in columns or df.columns:
        col, kind = F.col(f"`{c}`"), family(df.schema[c].dataType)
        if kind == "float":
            col = F.when(col == 0, F.lit(0.0)).otherwise(col)
        if kind == "other" and not isinstance(df.schema[c].dataType, (T.DecimalType, T.BinaryType)):
            col = F.to_json(F.struct(col.alias("v"))) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else col
            col = F.when(F.col(f"`{c}`").isNotNull(), col)
        pairs.append(F.struct(F.lit(c).alias("column_name"), col.cast("string").alias("value")))
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, n)``: the distinct cells of each column; null is a value."""
    return melt(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def category_frequencies(df: DataFrame) -> DataFrame:
    """``(column_name, token, n)`` of text and boolean columns; null is ``__NULL__``."""
    names = [c for c in df.columns if family(df.schema[c].dataType) in ("boolean", "string")]
    counts = value_counts(df, names) if names else df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    return counts.select("column_name", F.coalesce("value", F.lit(NULL_TOKEN)).alias("token"), "n")


def column_stats(df: DataFrame, exact: bool = True, rare: int = RARE) -> DataFrame:
    """Rows, nulls, cardinality (null counts as one value), mean text length and number of
    rare categories of each column. ``exact=False`` counts distinct values by sketch, in
    one pass without a shuffle of values; it has no rare count."""
    if exact:
        # long texts travel as 128-bit digests with their length; short cells as they are
        digest = F.when(F.length("value") > 32, F.md5(F.col("value").cast("binary"))).otherwise(F.col("value"))
        cells = melt(df).select("column_name", digest.alias("value"), F.length("value").alias("size"))
        per = cells.groupBy("column_name", "value", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("column_name")
        length = F.sum(F.when(F.col("value").isNotNull(), F.col("size") * F.col("n"))) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
        got = per.agg(
            F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count(F.lit(1)).alias("cardinality"), length.alias("avg_length"), F.count_if(F.col("n") <= rare).alias("rare"),
        )
    else:
        got = melt(df).groupBy("column_name").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"),
            (F.approx_count_distinct("value", 0.01) + F.max(F.col("value").isNull().cast("int"))).alias("cardinality"), F.avg(F.length("value")).alias("avg_length"), F.lit(None).cast("bigint").alias("rare"),
        )
    return got


def classify(stats: DataFrame, schema: T.StructType, target: str | None = None, high: int = HIGH, unique_ratio: float = UNIQUE_RATIO) -> DataFrame:
    """Topology and strategy of each column, first rule that holds."""
    name = F.col("column_name")
    kinds = F.create_map(*(F.lit(x) for f in schema.fields for x in (f.name, family(f.dataType))))
    types = F.create_map(*(F.lit(x) for f in schema.fields for x in (f.name, f.dataType.simpleString())))
    kind, card = kinds[name], F.col("cardinality")
    is_target = F.lit(False) if target is None else name == target
    ratio = F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(1.0)
    identifier = name.rlike(IDENTIFIER_NAME) | ((F.col("row_count") > UNIQUE_ROWS) & (card / F.greatest(F.col("row_count"), F.lit(1)) > unique_ratio))
    rules = (
        ((ratio > SPARSE_RATIO) & ~is_target, "SPARSE", "DROP", "null_ratio_gt_0.95"),
        (identifier & ~is_target, "IDENTIFIER", "DROP", "identifier_policy"),
        ((kind == "boolean") | (card == 2), "BOOLEAN", "BINARY_ENCODING", None),
        (kind == "datetime", "DATETIME", "CYCLICAL_ENCODING", None),
        ((kind == "integer") & (card <= min(DISCRETE, high)), "NUMERICAL_DISCRETE", "QUANTILE_TRANSFORM", None),
        (kind.isin("integer", "float"), "NUMERICAL_CONTINUOUS", "QUANTILE_TRANSFORM", None),
        ((kind == "string") & (F.coalesce("avg_length", F.lit(0)) > LONG_TEXT) & (card > high), "FREE_TEXT", "DROP", "free_text"),
        ((kind == "string") & (card > high), "CATEGORICAL_HIGH_CARDINALITY", "HIERARCHICAL_EMBEDDING", None),
        (kind == "string", "CATEGORICAL_LOW_CARDINALITY", "CONTINUOUS_EMBEDDING", None),
    )
    last = F.struct(F.lit("UNKNOWN").alias("t"), F.lit("DROP").alias("s"), F.lit("unsupported_dtype").alias("r"))
    pick = last
    for cond, t, s, r in reversed(rules):
        pick = F.when(cond, F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(r).cast("string").alias("r"))).otherwise(pick)
    counted = kind.isin("boolean", "string")
    out = stats.withColumn("__p", pick)
    return out.select(
        name, types[name].alias("original_dtype"), F.col("__p.t").alias("inferred_topology"), F.col("__p.s").alias("encoding_strategy"), card.cast("bigint").alias("cardinality"), ratio.alias("null_ratio"),
        F.when(counted, F.col("rare")).cast("bigint").alias("rare_category_count"), F.when(counted, F.lit(RARE)).alias("rare_category_threshold"), F.lit(True).alias("rare_categories_preserved"),
        is_target.alias("is_target"), (F.col("__p.s") != "DROP").alias("retained"), F.col("__p.r").alias("reason"),
    )


def profile(df: DataFrame, target: str | None = None, exact: bool = True, sample_rows: int | None = None, high: int = HIGH) -> DataFrame:
    """One row a column, over the whole table unless ``sample_rows`` asks for a prefix.

    An empty table has no cells to melt; its columns are profiled as all null.
    """
    rows = df.limit(sample_rows) if sample_rows else df
    stats = column_stats(rows, exact)
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    stats = names.join(stats, "column_name", "left").fillna(0, ["row_count", "null_count", "cardinality", "rare"])
    return classify(stats, df.schema, target, high)


def retained_columns(profile_df: DataFrame, df: DataFrame) -> list[str]:
    """Names of the retained columns in table order; the profile has a row a column."""
    keep = {r.column_name for r in profile_df.where("retained").select("column_name").collect()}
    return [c for c in df.columns if c in keep]


def ingest(df: DataFrame, target: str | None = None, withheld: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The profile, and the table without the columns that are not retained or ``withheld``.

    Whether a number is an identifier by its share of distinct values depends on the size
    of the table (prices repeat in a larger one); what must stay out at any size is named."""
    found = profile(df, target)
    return found, df.select(*(c for c in retained_columns(found, df) if c not in withheld))


def drop_prefixed(df: DataFrame, prefixes: tuple[str, ...], target: str | None = None) -> DataFrame:
    """Without columns whose name starts with a prefix (in any case); the target first."""
    keep = [c for c in df.columns if not c.upper().startswith(tuple(p.upper() for p in prefixes)) or c == target]
    if target is not None:
        keep = [target] + [c for c in keep if c != target]
    return df.select(*keep)


def active_columns(profile_rows: list) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of a collected profile (a row a column)."""
    active = [r for r in profile_rows if r.retained and r.encoding_strategy != "DROP"]
    numeric = [r.column_name for r in active if "NUMERICAL" in r.inferred_topology]
    return numeric, [r.column_name for r in active if "CATEGORICAL" in r.inferred_topology or r.inferred_topology == "BOOLEAN"]


def enrich(profile_df: DataFrame, vocabulary: DataFrame, rare: int = RARE) -> DataFrame:
    """The profile after fitting: cardinality is the size of the vocabulary (with its two
    sentinels), the rare count is that of its tokens."""
    per = vocabulary.groupBy("column_name").agg(F.count(F.lit(1)).alias("__n"), F.count_if((F.col("freq") > 0) & (F.col("freq") <= rare)).alias("__rare"))
    out = profile_df.join(per, "column_name", "left")
    out = out.withColumn("cardinality", F.coalesce("__n", "cardinality")).withColumn("rare_category_count", F.coalesce("__rare", "rare_category_count"))
    return out.drop("__n", "__rare")
