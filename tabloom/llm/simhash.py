"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components, stage_table

UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
RADIUS = 3
PART_ROWS = 1 << 20
TASKS_A_CORE = 256


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text; no words (or null) give zero."""
    words = (text or b"").translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row, whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def ball_blocks(blocks: int) -> list[tuple[np.uint64, np.uint64, np.ndarray]]:
    """For each erased block: the mask of kept bits, a tag, and what to flip for its ball.

    Two fingerprints at distance 3 differ in at most 2 kept bits once a block that holds
    a differing bit is erased, so their balls of radius 1 (half of 3) meet there; pairs
    at distance 2 or less meet under every erasure.
    """
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
    out = []
    for j, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        erased = ((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1)
        tag = xxhash.xxh64_intdigest(f"block {j} of {blocks}".encode()) & erased
        flips = [0] + [1 << b for b in range(64) if not lo <= b < hi]
        out.append((np.uint64((2**64 - 1) ^ erased), np.uint64(tag), np.array(flips, np.uint64)))
    return out


def _emit_balls(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = ball_blocks(blocks)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                fp = fps[at : at + 4096]
                for keep, tag, flips in plan:
                    key = (((fp & keep) | tag)[:, None] ^ flips[None, :]).ravel().view(np.int64)
                    own = np.repeat(fp, len(flips)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], names=["variant", "fp"])

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _bucket_edges(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links inside one bucket."""
    us, vs, left = [], [], np.arange(len(fp))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = _near(fp[left][:, None], fp[front][None, :])
            got = hit.any(1)
            us.append(fp[left[got]])
            vs.append(fp[front[hit[got].argmax(1)]])
            front, left = left[got], left[~got]
    return us, vs


def _verify(limit: int):
    """Streams rows sorted by variant; verifies each bucket of up to ``limit`` members and
    sends the members of larger ones on (``v`` null) to the exact way for dense places."""

    def close(keys, fps, dense_key):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[starts, len(keys)])
        us, vs, dense = [], [], []
        two = starts[size == 2]
        if dense_key is not None and len(starts) and keys[0] == dense_key:
            dense.append(fps[: size[0]])
            two = two[two != 0]
            size[0] = 1
        ok = two[_near(fps[two], fps[two + 1])]
        us.append(fps[ok])
        vs.append(fps[ok + 1])
        for s, n in zip(starts[size > 2], size[size > 2]):
            if n > limit:
                dense.append(fps[s : s + n])
            else:
                u, v = _bucket_edges(fps[s : s + n])
                us += u
                vs += v
        return us, vs, dense

    def out(us, vs, dense):
        u, v, d = np.concatenate(us), np.concatenate(vs), np.unique(np.concatenate(dense)) if dense else np.zeros(0, np.uint64)
        pair = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.uint64)
        left = np.r_[pair[:, 0], d].astype(np.uint64).view(np.int64)
        right = pa.array(np.r_[pair[:, 1], d].astype(np.uint64).view(np.int64), mask=np.r_[np.zeros(len(pair), bool), np.ones(len(d), bool)])
        return pa.RecordBatch.from_arrays([pa.array(left), right], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, dense_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            keys = np.r_[keys, b.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if cut:
                yield out(*close(keys[:cut], fps[:cut], dense_key))
                keys, fps, dense_key = keys[cut:], fps[cut:], None if keys[-1] != dense_key else dense_key
            if len(keys) > limit:
                dense_key = keys[0]
                yield out([fps[:0]], [fps[:0]], [fps])
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield out(*close(keys, fps, dense_key))

    return run


def _emit_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Balls of radius 1 and 2 on all 64 bits. Around a point, all members within 1 lie
    within 2 of each other, and each member at 2 lies within 3 of each member within 1."""
    one = np.array([0] + [1 << b for b in range(64)], np.uint64)
    two = np.array([(1 << a) | (1 << b) for a in range(64) for b in range(a)], np.uint64)
    flips, inner = np.r_[one, two], np.r_[np.ones(65, bool), np.zeros(len(two), bool)]
    for b in batches:
        for fp in b.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
            yield pa.RecordBatch.from_arrays(
                [pa.array((fp ^ flips).view(np.int64)), pa.array(np.full(len(flips), fp).view(np.int64)), pa.array(inner)], names=["point", "fp", "inner"]
            )


def links(fps: DataFrame, blocks: int = 3, bucket_limit: int = 512) -> DataFrame:
    """Edges ``(u, v)`` that join exactly the fingerprints reachable over distances <= 3.

    ``fps`` holds distinct longs ``fp``. Each emits its balls (about 131 variants with
    three blocks), rows are shuffled and sorted by variant, and colliding fingerprints are
    verified inside the sorted stream, which holds at most ``bucket_limit`` of them.
    Buckets beyond that are not cut: their members go through full balls of radius 1 and
    2 around common points, which link them exactly in linear space (2,081 rows of 17 bytes
    a member, dropped afterwards). Partitions are of about a million variants, but no more
    than some tasks a core.
    """
    work = Workspace(fps.sparkSession, "simhash")
    fps = work.table(fps.select("fp"), "fps")
    variants = sum(len(flips) for _, _, flips in ball_blocks(blocks))
    most = TASKS_A_CORE * fps.sparkSession.sparkContext.defaultParallelism  # rows are sorted and streamed, so a task may have any number
    parts = max(1, min(most, math.ceil(fps.count() * variants / PART_ROWS)))
    # dealt before the balls are emitted, so that the emission is spread as well
    balls = fps.repartition(parts, "fp").mapInArrow(_emit_balls(blocks), "variant long, fp long")
    found = balls.repartition(parts, "variant").sortWithinPartitions("variant").mapInArrow(_verify(bucket_limit), "u long, v long")
    found = work.table(found.distinct(), "links")
    work.drop("fps")
    edges = found.where("v IS NOT NULL")
    dense = found.where("v IS NULL").select(F.col("u").alias("fp"))
    if dense.isEmpty():
        return edges
    stars = dense.repartition(max(1, min(most, math.ceil(dense.count() * 2081 / PART_ROWS))), "fp").mapInArrow(_emit_stars, "point long, fp long, inner boolean")
    stars = work.table(stars, "stars")
    hub = work.table(stars.where("inner").groupBy("point").agg(F.min("fp").alias("hub")), "hubs")
    far = work.table(stars.join(hub, "point").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct(), "far")
    work.drop("stars", "hubs")
    return edges.unionByName(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, blocks: int = 3, bucket_limit: int = 512) -> DataFrame:
    """Classes of near-duplicate documents: ``(doc_id, fp, component_id)``, one per row.

    Equal fingerprints are collapsed before anything is compared, so copies never meet in
    pairs. ``component_id`` is the smallest ``doc_id`` reachable over links of at most 3
    differing bits. Null or wordless texts share the fingerprint zero. Rows with a null
    ``doc_id`` are returned with the id of their group (null if no member has one);
    repeated rows stay repeated. An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    return _classes(docs, id_col, text_col, shingle, blocks, bucket_limit).drop("root")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, blocks: int = 3, bucket_limit: int = 512) -> DataFrame:
    """The same with ``root``, which names a class even where classes share their smallest id."""
    work = Workspace(docs.sparkSession, "classes")
    rows = work.table(fingerprints(docs, id_col, text_col, shingle), "rows")
    each = work.table(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "each")
    comp = connected_components(links(each, blocks, bucket_limit))
    named = work.table(each.join(comp, each.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root")), "named")
    roots = work.table(named.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    # written sides let the joins split the rows of a large class or of many copies
    lookup = work.table(named.join(roots, "root").select("fp", "component_id", "root"), "lookup")
    work.drop("each", "named", "roots")
    return rows.join(lookup, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but the smallest id of each near-duplicate class.

    Of the rows of a repeated id one stays for each class that it stands for. Rows with a
    null id cannot stand for a class or be named as a copy; they stay. Null and empty texts
    are one class. An empty table gives an empty result.
    """
    found = stage_table(_classes(docs, id_col, text_col), "keep-one")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    once = docs.join(again, F.col(id_col) == F.col("__again"), "left_anti").join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    # the texts of a repeated id may be of several classes, so their fingerprints decide
    many = docs.join(again, F.col(id_col) == F.col("__again"), "left_semi").withColumn("__text", F.xxhash64(F.col(text_col).cast("binary")))
    prints = fingerprints(many.dropDuplicates(["__text"]), "__text", text_col).select(F.col("doc_id").alias("__text"), F.col("fp").alias("__fp"))
    lead = found.where("doc_id = component_id").select(F.col("doc_id").alias("__lead"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    many = many.join(prints, "__text").withColumn("__lead", F.col(id_col).cast("long")).join(lead, ["__lead", "__fp"])
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kept = many.groupBy("__root").agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("__row"))
    return once.unionByName(kept.select("__row.*"))
