"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

K = 20
FIT_ROWS = 8192
SCAN_SHARE = 0.45
SCAN_LEAST = 6000
SHARD_ROWS = 2048
ROUTE_ROWS = 128
SPAN_ROWS, SPAN_QUERIES = 16384, 1024
QUERY_EVERY = 20


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the rows that can be searched: an id, and a vector of the usual
    length that is neither null nor zero and has finite components only."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual.d if usual else 0))


def _collapse(keep: int, encode):
    """Per batch: each distinct key with its ``keep`` smallest ids and its query ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) + 0.0
            groups: dict = {}
            for i, key in zip(ids.tolist(), encode(flat)):
                groups.setdefault(key, []).append(i)
            kind = pa.int64() if isinstance(next(iter(groups)), int) else pa.binary()
            small = [sorted(set(g))[:keep] for g in groups.values()]
            yield pa.RecordBatch.from_arrays([pa.array(groups.keys(), kind), pa.array(small, pa.list_(pa.int64()))], names=["key", "ids"])

    return run


def distinct_keys(rows: DataFrame, encode, kind: str, keep: int) -> DataFrame:
    """``(key, ids)``: equal vectors are one entry that names its ``keep`` smallest ids.

    More ids of one key can never be among the nearest, as ties go to the smaller id.
    Copies are cut to ``keep`` in each batch already, so a vector in a third of all rows
    reaches its task as a few short lists."""
    each = rows.mapInArrow(_collapse(keep, encode), f"key {kind}, ids array<long>")
    return each.groupBy("key").agg(F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def _as_bytes(flat: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(flat)]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


def traverse(near1: np.ndarray, near2: np.ndarray, sizes: np.ndarray, want: int) -> list[int]:
    """Cells in order of summed distance (multi-sequence) until ``want`` entries are met."""
    o1, o2, k = np.argsort(near1, kind="stable"), np.argsort(near2, kind="stable"), len(near1)
    d1, d2 = near1[o1].tolist(), near2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, out, got = [(d1[0] + d2[0], 0, 0)], [], 0
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * k + o2[j]
        if sizes[cell]:
            out.append(cell)
            got += sizes[cell]
        if j + 1 < k:
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < k:
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return out


def _rerank(keep: int):
    def run(key: tuple, queries: pa.Table, entries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if queries.num_rows and entries.num_rows:
            x = np.frombuffer(b"".join(entries["key"].to_pylist()), np.float64).reshape(entries.num_rows, -1)
            ids, cells = entries["ids"].to_pylist(), entries["cell"].to_numpy()
            low = np.array([i[0] for i in ids])
            order = np.argsort(cells, kind="stable")
            cuts = np.searchsorted(cells[order], np.arange(cells.max() + 2))
            for q, v, seen in zip(queries["q"].to_pylist(), queries["key"].to_pylist(), queries["cells"].to_pylist()):
                at = np.concatenate([order[cuts[c] : cuts[c + 1]] for c in seen if c < len(cuts) - 1] or [order[:0]])
                score = x[at] @ np.frombuffer(v, np.float64)
                best = np.lexsort((low[at], -score))[:keep]
                pairs = sorted((-score[b], i) for b in best for i in ids[at[b]])[:keep]
                out_q.append(q)
                out_id.append([p[1] for p in pairs])
                out_s.append([-p[0] for p in pairs])
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_id, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64()))], names=["q", "ids", "scores"])

    return run


def _rerank_all(keep: int):
    """``_rerank`` of queries that see every entry: products of many at once find those that
    rounding may put among the best, which are then scored as one by one."""

    def run(key: tuple, queries: pa.Table, entries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if queries.num_rows and entries.num_rows:
            x, asked = (np.frombuffer(b"".join(t["key"].to_pylist()), np.float64).reshape(t.num_rows, -1) for t in (entries, queries))
            ids, names = entries["ids"].to_pylist(), queries["q"].to_pylist()
            low, size = np.array([i[0] for i in ids]), np.abs(x).max(0)
            for begin in range(0, len(asked), 256):
                part = asked[begin : begin + 256]
                near = part @ x.T
                least = np.partition(near, -min(keep, len(x)), axis=1)[:, -min(keep, len(x))]
                slack = 1e-12 * (np.abs(part) @ size)  # far above the rounding of a product
                for i, v in enumerate(part):
                    at = np.flatnonzero(near[i] >= least[i] - slack[i])
                    score = x[at] @ v
                    best = np.lexsort((low[at], -score))[:keep]
                    pairs = sorted((-score[b], j) for b in best for j in ids[at[b]])[:keep]
                    out_q.append(names[begin + i])
                    out_id.append([p[1] for p in pairs])
                    out_s.append([-p[0] for p in pairs])
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_id, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64()))], names=["q", "ids", "scores"])

    return run


def top_of(parts: DataFrame, keep: int, largest: bool) -> DataFrame:
    """Merges the partial lists ``(q, ids, scores)`` into ``(q, top)``, best first."""
    sign = -1 if largest else 1
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((x.scores * sign).alias("s"), x.ids.alias("id")))
    return parts.select("q", pairs.alias("p")).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, keep).alias("top"))


def answers(asked: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, s`` for each ``(query_id, q)``, itself left out."""
    got = asked.join(top, "q")
    rest = F.slice(F.filter("top", lambda x: x.id != F.col("query_id")), 1, k)
    return got.select("query_id", F.posexplode(rest).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.s").alias("s"))


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY, scan_share: float = SCAN_SHARE, scan_least: int = SCAN_LEAST, fit_rows: int = FIT_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all
    other rows. Two codebooks, one for each half of the vectors, are fitted on at most
    ``fit_rows`` distinct vectors (those with the least hashes); every vector is indexed
    in the cell of its two centroids. A query walks the centroid pairs by summed distance
    (the negative inner product with the centroids) until a share of the entries is met, and
    all of them are reranked in double precision. Equal vectors are one entry. The share
    (``scan_share``, at least ``scan_least``) is what recall 0.9 needs on vectors without
    clusters; on clustered ones a far smaller share does.

    Rows that ``usable`` leaves out neither ask nor answer. A repeated id counts once for
    each different vector it has. An empty table gives an empty result.
    """
    keep = k + 1
    rows = usable(table, id_col, vector_col)
    entries = stage_table(distinct_keys(rows, _as_bytes, "binary", keep), "ann-vectors")
    total = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return table.sparkSession.createDataFrame([], schema)
    sample = entries.select("key").orderBy(F.xxhash64("key"), "key").limit(fit_rows).toArrow()["key"].to_pylist()
    x = np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), -1)
    half, size = max(1, x.shape[1] // 2), min(128, max(1, len(sample) // 16))
    books = kmeans(x[:, :half], size), kmeans(x[:, half:], size) if x.shape[1] > 1 else np.zeros((size, 0))

    def assign(batches):
        for b in batches:
            v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(b.num_rows, -1)
            cell = nearest(v[:, :half], books[0]) * size + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], names=["key", "ids", "cell"])

    entries = stage_table(entries.mapInArrow(assign, "key binary, ids array<long>, cell int"), "ann-cells")
    sizes = np.zeros(size * size, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most 128 x 128 rows
        sizes[r["cell"]] = r["count"]
    scan = max(keep, scan_least, math.ceil(scan_share * total))
    shards = max(1, math.ceil(total / shard_rows))
    blocks = -(-sizes // shard_rows)  # a large cell is dealt to several shards

    def shard_of(cell, block):
        return (cell * 7919 + block) % shards

    # a query row stands for all queries with its vector; q is the least of their ids
    asked = rows.where(F.col("id") % query_every == 0)
    asked = stage_table(asked.mapInArrow(_name_queries, "key binary, query_id long"), "ann-queries")
    lead = asked.groupBy("key").agg(F.min("query_id").alias("q"))

    def route(batches):
        for b in batches:
            out = ([], [], [], [])
            v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(b.num_rows, -1)
            n1, n2 = -(v[:, :half] @ books[0].T), -(v[:, half:] @ books[1].T)
            for i, (key, q) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                by: dict[int, list[int]] = {}
                for cell in traverse(n1[i], n2[i], sizes, scan):
                    for block in range(int(blocks[cell])):
                        seen = by.setdefault(shard_of(cell, block), [])
                        if not seen or seen[-1] != cell:
                            seen.append(cell)
                for shard, cells in by.items():
                    for c, y in zip(out, (shard, q, key, cells)):
                        c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())))], names=["shard", "q", "key", "cells"])

    def place(batches):
        for b in batches:
            cell = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            low = np.array([i[0] for i in b.column(1).to_pylist()], np.int64)
            block = (low * 2654435761 % (1 << 31)) % np.maximum(blocks[cell], 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(cell, block).astype(np.int32)), *b.columns], names=["shard", "key", "ids", "cell"])

    lead = stage_table(lead, "ann-leads")
    placed = entries.mapInArrow(place, "shard int, key binary, ids array<long>, cell int")
    named = asked.join(lead, "key").select("query_id", "q")
    if scan_share >= 1:
        # a walk to the end meets all cells, whatever their order: shards are visited by
        # spans of them, each by many queries at once, and a query has one list a span
        span = F.floor(F.col("shard") / max(1, SPAN_ROWS // shard_rows)).cast("int")
        spans, crowds = math.ceil(shards / max(1, SPAN_ROWS // shard_rows)), max(1, math.ceil(lead.count() / SPAN_QUERIES))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        visits = lead.select("key", "q", F.pmod(F.xxhash64("q"), F.lit(crowds)).cast("int").alias("crowd"), each(spans).alias("span"))
        placed = placed.select("key", "ids", span.alias("span"), each(crowds).alias("crowd"))
        parts = visits.groupBy("span", "crowd").cogroup(placed.groupBy("span", "crowd")).applyInArrow(_rerank_all(keep), "q long, ids array<long>, scores array<double>")
        return answers(named, top_of(parts, keep, True), k).select("query_id", "rank", "vec_id", (-F.col("s")).alias("score"))
    lead = lead.repartition(max(1, math.ceil(lead.count() / ROUTE_ROWS)), "q")  # walking the index is most of a query's work
    routed = lead.mapInArrow(route, "shard int, q long, key binary, cells array<int>")
    parts = routed.groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(_rerank(keep), "q long, ids array<long>, scores array<double>")
    return answers(named, top_of(parts, keep, True), k).select("query_id", "rank", "vec_id", (-F.col("s")).alias("score"))


def _name_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(_as_bytes(flat), pa.binary()), b.column(0)], names=["key", "query_id"])
