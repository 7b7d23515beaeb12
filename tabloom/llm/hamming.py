"""Exact top-k over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .multi_index import answers, distinct_keys, top_of, usable

K = 20
WIDTH = 16
BLOCK_ROWS = 65536
QUERY_ROWS, LEAST_QUERIES = 16384, 256
FEW_CODES, BATCH_CELLS = 4096, 1 << 20
QUERY_EVERY = 20


def sign_codes(flat: np.ndarray) -> list[bytes]:
    """The signs of all components as a code: bit 0 first, filled up to whole segments."""
    bits = np.zeros((len(flat), -(-flat.shape[1] // WIDTH) * WIDTH), np.uint8)
    bits[:, : flat.shape[1]] = flat > 0
    return [row.tobytes() for row in np.packbits(bits, axis=1, bitorder="little")]


def code_array(codes: list[bytes]) -> np.ndarray:
    """Codes as rows of segments of 16 bits."""
    return np.frombuffer(b"".join(codes), np.uint16).reshape(len(codes), -1)


class MultiIndex:
    """The codes of a block, findable by each of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m, self.width = codes, codes.shape[1], WIDTH
        self.order, self.cuts = [], []
        for s in range(self.m):
            order = np.argsort(codes[:, s], kind="stable")
            self.order.append(order)
            self.cuts.append(np.searchsorted(codes[order, s], np.arange((1 << self.width) + 1)))
        self.masks: list[np.ndarray] = []

    def ring(self, r: int) -> np.ndarray:
        """All segment values with ``r`` bits set."""
        while len(self.masks) <= r:
            n = len(self.masks)
            self.masks.append(np.array([sum(1 << b for b in c) for c in combinations(range(self.width), n)], np.int64))
        return self.masks[r]

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all codes no farther than the k-th nearest.

        With every segment searched to radius r, all codes within ``m (r + 1) - 1`` bits
        have been met; the radius grows until the k-th verified distance is within that.
        """
        seen = np.zeros(len(self.codes), bool)
        at, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(self.width + 1):
            new = []
            for s in range(self.m):
                keys = int(query[s]) ^ self.ring(r)
                lo, n = self.cuts[s][keys], self.cuts[s][keys + 1] - self.cuts[s][keys]
                lo, n = lo[n > 0], n[n > 0]
                if len(n):
                    hits = self.order[s][np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                    hits = hits[~seen[hits]]
                    seen[hits] = True
                    new.append(hits)
            got = np.concatenate(new) if new else at[:0]
            at, dist = np.r_[at, got], np.r_[dist, np.bitwise_count(self.codes[got] ^ query).sum(1, dtype=np.int64)]
            covered = self.m * (r + 1) - 1
            if len(at) == len(self.codes) or (dist <= covered).sum() >= k:
                break
        if len(dist) > k:
            last = np.partition(dist, k - 1)[k - 1]
            at, dist = at[dist <= last], dist[dist <= last]
        return at, dist


class SmallIndex:
    """The codes of a small block by their segments, for many queries at once. A ring of a
    segment has more values than such a block, so the values there are, not those of the
    ring, are looked through."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.segments = [np.unique(codes[:, s], return_inverse=True) for s in range(self.m)]

    def within(self, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, positions and distances of all codes within each query's limit: those
        have a segment within a share of it, and are verified."""
        radius = np.minimum(limits // self.m, WIDTH).astype(np.uint8)[:, None]
        met = np.zeros((len(queries), len(self.codes)), bool)
        for s, (values, place) in enumerate(self.segments):
            met |= (np.bitwise_count(queries[:, s, None] ^ values[None, :]) <= radius)[:, place.ravel()]
        q, at = np.nonzero(met)
        dist = np.bitwise_count(self.codes[at] ^ queries[q]).sum(1, dtype=np.int64)
        near = dist <= limits[q]
        return q[near], at[near], dist[near]


def _first(q: np.ndarray, dist: np.ndarray, low: np.ndarray, at: np.ndarray, n: int, keep: int):
    """The ``keep`` best of each of ``n`` queries, in order, and each query's limit: the
    distance that a later code must not pass."""
    order = np.lexsort((low, dist, q))
    q, dist, low, at = q[order], dist[order], low[order], at[order]
    start = np.searchsorted(q, np.arange(n))
    stay = np.arange(len(q)) - start[q] < keep
    q, dist, low, at = q[stay], dist[stay], low[stay], at[stay]
    limits, size = np.full(n, np.iinfo(np.int64).max), np.bincount(q, minlength=n)
    full = size >= keep
    limits[full] = dist[np.cumsum(size)[full] - 1]
    return q, dist, low, at, limits


def _scan_small(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, cuts: np.ndarray, keep: int):
    """Queries, distances and positions of the ``keep`` nearest codes of each query, over
    all blocks (from one cut to the next); what a block finds narrows the search of the next."""
    blocks = [SmallIndex(codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    step = max(1, BATCH_CELLS // max(len(b.codes) for b in blocks))
    for begin in range(0, len(queries), step):
        part = queries[begin : begin + step]
        none = np.zeros(0, np.int64)
        q, dist, at = none, none, none
        limits = np.full(len(part), np.iinfo(np.int64).max)
        for block, a in zip(blocks, cuts[:-1]):
            new_q, new_at, new_dist = block.within(part, limits)
            if len(new_q):
                q, dist, at = np.r_[q, new_q], np.r_[dist, new_dist], np.r_[at, new_at + a]
                q, dist, _, at, limits = _first(q, dist, low[at], at, len(part), keep)
        yield begin, len(part), q, dist, at


def _search_span(keep: int):
    """The nearest codes of a span for each query; a span is one large block, or small
    ones that are searched one after the other and hand on one list."""

    def run(key: tuple, queries: pa.Table, entries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []

        def answer(q: int, found: list[tuple[int, int]]) -> None:
            pairs = sorted((d, i) for d, at in found for i in ids[at])[:keep]
            out_q.append(q)
            out_id.append([p[1] for p in pairs])
            out_s.append([p[0] for p in pairs])

        if queries.num_rows and entries.num_rows:
            block = entries["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(block[order])) + 1, len(order)]
            entries = entries.take(pa.array(order))
            codes, ids = code_array(entries["key"].to_pylist()), entries["ids"].to_pylist()
            low, names, asked = np.array([i[0] for i in ids]), queries["q"].to_pylist(), code_array(queries["key"].to_pylist())
            if np.diff(cuts).max() <= FEW_CODES:
                for begin, n, q, dist, at in _scan_small(asked, codes, low, cuts, keep):
                    ends = np.searchsorted(q, np.arange(n + 1)).tolist()
                    found = list(zip(dist.tolist(), at.tolist()))
                    for k in range(n):
                        answer(names[begin + k], found[ends[k] : ends[k + 1]])
            else:
                for a, b in zip(cuts[:-1], cuts[1:]):
                    index = MultiIndex(codes[a:b])
                    for q, code in zip(names, asked):
                        at, dist = index.top(code, keep)
                        best = np.lexsort((low[a + at], dist))[:keep]
                        answer(q, [(int(dist[i]), int(a + at[i])) for i in best])
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_id, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.int64()))], names=["q", "ids", "scores"])

    return run


def _name_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(sign_codes(flat), pa.binary()), b.column(0)], names=["key", "query_id"])


def exact_top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the exact ``k`` nearest by Hamming distance
    between sign codes, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``, candidates all other
    rows. A code has a bit for every component, whatever their number. Equal codes are one
    entry with its ``k + 1`` smallest ids. The entries are dealt to blocks; in each, queries are answered by incremental multi-index hashing,
    and the blocks' lists are merged. Rows that cannot be used (see
    ``multi_index.usable``) take no part; an empty table gives an empty result.
    """
    keep = k + 1
    rows = usable(table, id_col, vector_col)
    entries = stage_table(distinct_keys(rows, sign_codes, "binary", keep), "hamming-codes")
    blocks = max(1, math.ceil(entries.count() / block_rows))
    asked = stage_table(rows.where(F.col("id") % query_every == 0).mapInArrow(_name_queries, "key binary, query_id long"), "hamming-queries")
    lead = asked.groupBy("key").agg(F.min("query_id").alias("q"))
    lead = stage_table(lead, "hamming-leads")
    asked_n, tasks = lead.count(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # large chunks of queries, but on few blocks enough of them that all cores have work
    spans = max(1, math.ceil(blocks / max(1, BLOCK_ROWS // block_rows)))
    chunks = max(1, math.ceil(asked_n / QUERY_ROWS), min(math.ceil(asked_n / LEAST_QUERIES), math.ceil(tasks / spans)))
    left = lead.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks))).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    right = entries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    right = right.withColumn("span", F.col("block") % spans).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    by = ["span", "chunk"]
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search_span(keep), "q long, ids array<long>, scores array<long>")
    named = asked.join(lead, "key").select("query_id", "q")
    return answers(named, top_of(parts, keep, False), k).withColumnRenamed("s", "distance")
