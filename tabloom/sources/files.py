"""Readers and writers of tables, schemas, encoders and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import normal, uniform
from ..functions.scalars import null_tokens

DELIMITERS = (",", ";", "\t", "|")
SNIFF_BYTES = 64 * 1024
ROW_GROUP_ROWS = 100_000


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A table by the suffix of its path: delimited text (also gzipped), Parquet or ORC."""
    low = path.lower()
    if low.endswith((".csv", ".csv.gz")):
        return read_delimited(spark, path)
    if low.endswith((".tsv", ".tsv.gz")):
        return read_delimited(spark, path, "\t")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".orc"):
        return spark.read.orc(path)
    raise ValueError(f"unsupported file type: {path}")


def delimiter_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(delimiter, fields, lines)``: how many of the first lines (64 KiB, decompressed)
    agree on a number of separators above zero."""
    head = spark.read.text(path).limit(SNIFF_BYTES).withColumn("n", F.monotonically_increasing_id())
    upto = F.sum(F.octet_length("value") + 1).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    head = head.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < SNIFF_BYTES)
    each = head.select(F.explode(F.array(*(F.struct(F.lit(d).alias("delimiter"), (F.length("value") - F.length(F.translate("value", d, ""))).alias("fields")) for d in DELIMITERS))).alias("x")).select("x.*")
    return each.where("fields > 0").groupBy("delimiter", "fields").agg(F.count(F.lit(1)).alias("lines"))


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The separator on which most lines agree, more separators first; ``;`` if none."""
    best = delimiter_scores(spark, path).orderBy(F.desc("lines"), F.desc("fields"), "delimiter").first()
    return best["delimiter"] if best else ";"


#: The ladder of types: name, what a text must look like, what it must cast to.
LADDER = (
    ("boolean", r"^(?i:true|false)$", "boolean"),
    ("bigint", r"^[+-]?[0-9]+$", "bigint"),
    ("double", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "double"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "date"),
    ("timestamp_ntz", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}", "timestamp_ntz"),
)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, infer_rows: int | None = None) -> DataFrame:
    """Tolerant read with a header: null tokens become null, ragged rows are cut or padded,
    each column gets the first type of the ladder that all of its texts fit. With
    ``infer_rows`` only the first texts count, and later ones that do not fit become null."""
    sep = sep or detect_delimiter(spark, path)
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    raw = raw.select(*(null_tokens(F.col(f"`{c}`")).alias(c) for c in raw.columns))
    fits = [F.every(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").rlike(look) & F.col(f"`{c}`").try_cast(kind).isNotNull())).alias(f"{i}:{name}") for i, c in enumerate(raw.columns) for name, look, kind in LADDER]
    seen = (raw if infer_rows is None else raw.limit(infer_rows)).agg(F.count(F.lit(1)).alias("n"), *fits).first() if raw.columns else None
    out = []
    for i, c in enumerate(raw.columns):
        kind = next((k for name, _, k in LADDER if seen["n"] and seen[f"{i}:{name}"]), "string")
        out.append(F.col(f"`{c}`").try_cast(kind).alias(c))
    return raw.select(*out)


def fingerprint(config: dict) -> str:
    """SHA-256 of the sorted JSON of a run's configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def write_table(df: DataFrame, path: str, config: dict | None = None, row_group_rows: int = ROW_GROUP_ROWS) -> None:
    """Snappy Parquet in row groups of at most 100,000 rows, stamped with the configuration;
    a file holds as many groups as its task has, no row is shuffled."""
    if config is not None:
        df = df.withColumn("run_fingerprint", F.lit(fingerprint(config)))
    df.write.mode("overwrite").option("compression", "snappy").option("parquet.block.row.count.limit", row_group_rows).parquet(path)


def write_schema(profile: DataFrame, path: str) -> None:
    """The profile as JSON lines, one object a column, sorted by name."""
    fields = sorted(profile.columns)
    lines = profile.orderBy("column_name").select(F.to_json(F.struct(*fields)).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)  # one line a column of the table


def read_schema(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("x")).select("x.*")


def write_encoder(quantiles: DataFrame, vocabulary: DataFrame, profile: DataFrame, path: str) -> None:
    for name, table in (("quantiles", quantiles), ("vocabulary", vocabulary), ("profile", profile)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_encoder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("quantiles", "vocabulary", "profile"))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def latest_report(spark: SparkSession, pattern: str) -> DataFrame:
    """The newest report that matches ``pattern``, by modification time."""
    found = spark.read.json(pattern).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"))
    return found.orderBy(F.desc("modified"), F.desc("file_path")).limit(1)


def report_domains(spark: SparkSession, pattern: str) -> DataFrame:
    """Sorted names of the folders that hold a report."""
    path = spark.read.json(pattern).select(F.split(F.col("_metadata.file_path"), "/").alias("p"))
    return path.select(F.element_at("p", -3).alias("domain")).distinct().orderBy("domain")


def first_available(spark: SparkSession, sources: Iterable[Callable[[SparkSession], DataFrame]], required: str, default) -> DataFrame:
    """The first source that can be read and has rows; ``required`` is added if missing."""
    for source in sources:
        try:
            df = source(spark)
            empty = df.isEmpty()
        except Exception as error:  # noqa: BLE001  a source that is not there is passed over
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            continue
        if not empty:
            return df if required in df.columns else df.withColumn(required, F.lit(default))
    raise ValueError("no source has rows")


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parts of one table under several paths; columns that some lack are null there."""
    out = None
    for p in paths:
        out = scan(spark, p) if out is None else out.unionByName(scan(spark, p), allowMissingColumns=True)
    return out


def generate_table(keys: DataFrame, key: str, spec: dict[str, dict], seed: int) -> DataFrame:
    """A column for each entry of ``spec`` on the rows of ``keys``.

    Kinds: ``choice`` (values, weights), ``integer`` (low, high), ``poisson`` (mean, cap)
    and ``lognormal`` (mean, sd, digits). All are looked up from keyed uniforms.
    """
    import math

    cols = [F.col(key)]
    for name, s in spec.items():
        u = uniform(key, seed, name)
        if s["kind"] == "choice":
            total, run, col = float(sum(s["weights"])), 0.0, None
            for v, w in zip(s["values"][:-1], s["weights"]):
                run += w / total
                col = F.when(u < run, F.lit(v)) if col is None else col.when(u < run, F.lit(v))
            col = col.otherwise(F.lit(s["values"][-1])) if col is not None else F.lit(s["values"][0])
        elif s["kind"] == "integer":
            col = (F.floor(u * (s["high"] - s["low"] + 1)) + s["low"]).cast("bigint")
        elif s["kind"] == "poisson":
            run, term, table = 0.0, math.exp(-s["mean"]), []
            for k in range(s["cap"] + 1):
                run += term
                table.append(run)
                term *= s["mean"] / (k + 1)
            col = F.least(F.size(F.filter(F.array(*(F.lit(t) for t in table)), lambda t: t <= u)), F.lit(s["cap"])).cast("bigint")
        elif s["kind"] == "lognormal":
            col = F.round(F.exp(s["mean"] + s["sd"] * normal(key, seed, name)), s["digits"])
        else:
            raise ValueError(f"unknown kind {s['kind']}")
        cols.append(col.alias(name))
    return keys.select(*cols)


def training_batches(df: DataFrame, key: str, batch_size: int, epoch: int, seed: int) -> DataFrame:
    """``batch_id`` and its place in an epoch.

    Batches are contiguous runs of ``batch_size`` rows in key order; their order is a
    permutation that depends on ``seed + epoch``. The row numbers come from ranges of the
    key with offsets, so no task sees the whole table.
    """
    from ..operators.sampling import global_rank

    out = global_rank(df, [F.col(key)], "__rank").withColumn("batch_id", F.floor((F.col("__rank") - 1) / batch_size))
    batches = out.groupBy("batch_id").count().select("batch_id", uniform("batch_id", seed + epoch, "epoch").alias("u"))
    order = global_rank(batches, [F.col("u"), F.col("batch_id")], "batch_order").select("batch_id", "batch_order")
    return out.drop("__rank").join(order, "batch_id")


def write_batches(batches: DataFrame, path: str) -> None:
    """Training batches, a folder for each, so a reader takes one by its name."""
    batches.write.mode("overwrite").partitionBy("batch_id").parquet(path)
