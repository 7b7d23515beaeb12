"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace, written

__all__ = ["Workspace", "connected_components", "slices", "stage_table"]


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a re-run,
    and the rows (with any generated ids) no longer change.
    """
    return written(df, name)


def slices(batches, rows: int = 512):
    """Arrow batches in short slices, so that few texts at once become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``(u, v)`` long pairs.

    Alternates large-star and small-star rounds on DataFrames until the edge table stops
    changing; then every node points straight at its component's smallest node. Nothing
    but two numbers a round reaches the driver. The least neighbours are joined under a
    new key (``_anew``), so that the rows of a node with very many neighbours can be split.
    A finished round's table is dropped.

    Self loops, repeated and reversed edges are fine; null ends are ignored; no edges give
    an empty result. Returns ``(node, component)`` for every node that has an edge.
    """
    work, n = Workspace(edges.sparkSession, "components"), 0
    pairs = (
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    pairs = work.table(pairs, "pairs0")
    state = _digest(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(_anew(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(_anew(low), "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs = work.table(small, f"pairs{n + 1}")
        before, state = state, _digest(pairs)
        work.drop(f"pairs{n}")
        n += 1
        if state == before:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _anew(rows: DataFrame) -> DataFrame:
    """``rows`` with ``u`` as an expression. A join would take an aggregate by ``u`` as it
    is dealt, and could then split nothing; it deals the new key, and both sides, anew."""
    return rows.withColumn("u", F.col("u").bitwiseXOR(F.lit(0).cast("long")))


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
