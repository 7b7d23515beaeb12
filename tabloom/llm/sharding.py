"""Shards of near equal size that keep copies together: minimax contiguous partition."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SHARDS = 16
PART_ROWS = 1 << 20
SLICES = 512


@dataclass(frozen=True)
class Gap:
    """A stretch between two neighbouring known boundaries; ``inner`` boundaries in it are not yet known."""

    low: int
    high: int
    inner: int


class Boundaries:
    """What the driver knows of the places where a shard may begin: running sizes before an
    atomic group. Between known ones lie gaps with a number of unknown ones."""

    def __init__(self, total: int, groups: int):
        self.known = [0, total] if total else [0]
        self.inner = [max(0, groups - 1)] if total else []  # of the gap after each but the last

    def under(self, at: int) -> int:
        """The largest known boundary up to ``at``."""
        return self.known[bisect.bisect_right(self.known, at) - 1]

    def over(self, at: int) -> int:
        """The smallest known boundary from ``at`` on."""
        return self.known[bisect.bisect_left(self.known, at)]

    def gap(self, at: int) -> Gap | None:
        """The gap with unknown boundaries that ``at`` lies in."""
        i = bisect.bisect_right(self.known, at) - 1
        if i + 1 < len(self.known) and self.known[i] < at and self.inner[i]:
            return Gap(self.known[i], self.known[i + 1], self.inner[i])
        return None

    def learn(self, gap: Gap, slices: list[tuple[int, int, int]]) -> None:
        """Takes up a gap's slices: first and last boundary and number of boundaries of each."""
        i = self.known.index(gap.low)
        places, inner = [], []
        for low, high, n in sorted(slices):
            places += [low, high][: 1 + (high > low)]
            inner += [0, n - 2][: 1 + (high > low)]
        self.known[i + 1 : i + 1] = places
        self.inner[i : i + 1] = [*inner, 0]


def greedy(known: Boundaries, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
    """Cuts of shards filled one after the other up to ``capacity``, None if they do not hold
    all. Unknown boundaries: none may be used, or (``hopeful``) one stands wherever wanted."""
    total, at, cuts = known.known[-1], 0, []
    for _ in range(shards):
        if at >= total:
            break
        full = min(at + capacity, total)
        cut = full if hopeful and known.gap(full) else known.under(full)
        if cut <= at:
            return None
        cuts.append(cut)
        at = cut
    return cuts if at >= total else None


def smallest(known: Boundaries, shards: int, hopeful: bool) -> int:
    """The smallest capacity that is enough, by bisection."""
    low, high = 0, known.known[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(known, middle, shards, hopeful) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax(known: Boundaries, shards: int, refine) -> tuple[int, list[int]]:
    """The smallest capacity for which the groups, in order, fit into ``shards`` contiguous
    shards, and the places where they begin.

    The capacity is bisected twice: with known boundaries alone, which may ask too much,
    and as if one stood wherever wanted, which may ask too little. Gaps that a cut for a
    capacity between the two can fall into are refined (``refine``, one pass over the
    table), until both agree. Cuts within the capacity are then set where the rest divides
    best (``even``), once the boundaries around those places are known too.
    """
    total = known.known[-1]
    if not total:
        return 0, []
    while True:
        low, high = smallest(known, shards, True), smallest(known, shards, False)
        if low == high:
            break
        # boundaries move up with the capacity: a cut lies between those for low and high
        least, most = (_chain(known, c, shards, h) for c, h in ((low, False), (high, True)))
        refine([g for a, b in zip(least, most) for g in gaps(known, a, b)])
    while True:
        cuts, missing = even(known, low, shards)
        if not missing:
            return low, cuts
        refine(missing)


def _chain(known: Boundaries, capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Where shard after shard ends at latest; pessimistic chains may stall at a place."""
    at, out = 0, []
    for _ in range(shards):
        full = min(at + capacity, known.known[-1])
        at = full if hopeful and known.gap(full) else known.under(full)
        out.append(at)
    return out


def gaps(known: Boundaries, low: int, high: int) -> list[Gap]:
    """Gaps with unknown boundaries that overlap ``low .. high``."""
    i = max(0, bisect.bisect_right(known.known, low) - 1)
    out = []
    while i + 1 < len(known.known) and known.known[i] <= high:
        if known.inner[i]:
            out.append(Gap(known.known[i], known.known[i + 1], known.inner[i]))
        i += 1
    return out


def even(known: Boundaries, capacity: int, shards: int) -> tuple[list[int], list[Gap]]:
    """Where the shards begin, if each takes its even part of what is left, as near as
    groups allow, within ``capacity`` and so that the others can hold the rest; and the
    gaps that must be known first. Runs out of groups before shards if groups are few."""
    total = known.known[-1]
    latest, missing = [total], []  # latest[r]: the first place from which r shards can hold the rest
    for _ in range(shards - 1):
        at = max(0, latest[-1] - capacity)
        missing += [g] if (g := known.gap(at)) else []
        latest.append(known.over(at))
    cuts, at = [0], 0
    for left in range(shards - 1, 0, -1):
        if at >= total:
            break
        goal = at + math.ceil((total - at) / (left + 1))
        full = min(at + capacity, total)
        missing += [g for x in (goal, full) if (g := known.gap(x))]
        under, over = known.under(goal), known.over(goal)
        cut = over if under <= at or over - goal < goal - under else under
        cut = min(max(cut, latest[left]), known.under(full))
        cuts.append(cut)
        at = cut
    return [c for c in cuts if c < total], list(dict.fromkeys(missing))


def _ordered(rows: DataFrame, work: Workspace, heavy: list[bytes], parts: int) -> DataFrame:
    """The rows in the order of their groups, written once: ``part``, ``idx`` and ``before``
    (rows and sizes before the row in its part), ``start`` (whether its group begins here).

    The range sort goes by group and then by row, so a group of very many rows is dealt to
    several tasks; what crosses part borders is settled from one row a part (``_parts``)."""
    place = F.lit(len(heavy))
    for i, digest in enumerate(heavy):  # at most one for each shard
        place = F.when(F.col("digest") == F.lit(digest), i).otherwise(place)
    order = ["place", "digest", "doc_id", "row"]
    dealt = rows.withColumn("place", place).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = ["digest", "doc_id", "size", "text_crc32"]

    def run(batches):
        part, seen, before, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            size = b.column(2).to_numpy()
            upto, digest = before + np.cumsum(size), np.array(b.column(0).to_pylist(), object)
            if not len(size):
                continue
            start = np.r_[digest[0] != last, digest[1:] != digest[:-1]].astype(bool)
            n = len(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(upto - size), pa.array(start)], names=[*names, "part", "idx", "before", "start"])
            seen, before, last = seen + n, int(upto[-1]), digest[-1]

    kind = rows.schema["doc_id"].dataType.simpleString()
    return work.table(dealt.select(*names).mapInArrow(run, f"digest binary, doc_id {kind}, size long, text_crc32 long, part int, idx long, before long, start boolean"), "ordered")


def _parts(ordered: DataFrame) -> tuple[list[tuple], int, int]:
    """``(part, rows before, size before, whether its first row begins a group)`` of each
    part, the size of all, and the number of groups. A row a part comes to the driver."""
    ends = ordered.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"), F.count_if("start").alias("groups"),
        F.min(F.struct("idx", "digest")).alias("first"), F.max(F.struct("idx", "digest")).alias("last"),
    )
    out, rows, size, groups, last = [], 0, 0, 0, None
    for r in ends.orderBy("part").collect():
        fresh = r.first.digest != last
        out.append((r.part, rows, size, fresh))
        rows, size, groups, last = rows + r.rows, size + r.size, groups + r.groups - (not fresh), r.last.digest
    return out, size, groups


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is
    ``bytes``: shards of near equal size, in which equal texts stay together.

    Size is the text's UTF-8 bytes plus 1. Equal texts are an atomic group. Groups larger
    than an even share (fewer than ``shards`` of them) come first, by size, the others in
    the order of their digests, which is as good as random and the same in every run. The
    smallest feasible capacity of contiguous shards is bisected, with a greedy check, and
    is exact: the driver holds at most some ten thousand running sizes, and looks again
    between those that a cut may fall into. Cuts keep to that capacity and divide what is
    left evenly, so that shards beside a very large group do not stay empty.

    A null text has no bytes and is one group with empty texts. Repeated rows are rows of
    their own; null ids come first in their group. With fewer groups than shards the last
    shards have no rows. An empty table gives an empty result; other columns are not read.

    Slots are running numbers in the order of the groups. Texts are read once; one narrow
    range sort follows, on which a group of any number of rows is spread over tasks.
    """
    work = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", (F.octet_length("t").cast("long") + 1).alias("size"), F.crc32("t").alias("text_crc32"), F.unhex(F.sha2("t", 256)).alias("digest"), F.monotonically_increasing_id().alias("row")
    )
    rows = work.table(rows, "rows")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    large = rows.groupBy("digest").agg(F.sum("size").alias("size")).where(F.col("size") * shards > whole.size)
    heavy = [bytes(r.digest) for r in large.orderBy(F.desc("size"), "digest").collect()]  # fewer than shards: each is more than an even share
    ordered = _ordered(rows, work, heavy, max(1, math.ceil(whole.n / part_rows), docs.sparkSession.sparkContext.defaultParallelism))
    work.drop("rows")
    parts, total, groups = _parts(ordered)
    spark = docs.sparkSession
    offsets = spark.createDataFrame(parts, "part int, rows_before long, size_before long, fresh boolean")
    # one row a part of about a million rows
    placed = ordered.join(F.broadcast(offsets), "part").withColumns({"at": F.col("before") + F.col("size_before"), "no": F.col("idx") + F.col("rows_before")})
    starts = ordered.where("start").select("part", "idx", "before")
    known = Boundaries(total, groups)

    def refine(found: list[Gap]) -> None:
        """Looks between known boundaries: one pass, at most SLICES + 1 rows a gap."""
        found = sorted(set(found), key=lambda g: g.low)
        where = [p[0] for p, after in zip(parts, [*(q[2] for q in parts[1:]), total]) if any(g.low < after and p[2] < g.high for g in found)]
        read = starts.where(F.col("part").between(where[0], where[-1]))
        got = read.mapInArrow(_slices(found, parts), "gap int, slice int, a long, b long, n long")
        got = got.groupBy("gap", "slice").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).collect()
        for i, g in enumerate(found):
            known.learn(g, [(r.a, r.b, r.n) for r in got if r.gap == i])

    _, cuts = minimax(known, shards, refine)
    return assign(placed, cuts)


def _slices(found: list[Gap], parts: list[tuple]):
    """Sums up the boundaries inside the gaps by slices of equal width, a batch at a time."""
    low, high = (np.array([getattr(g, k) for g in found]) for k in ("low", "high"))
    number, _, before, fresh = (np.array(c) for c in zip(*parts))

    def run(batches):
        for b in batches:
            part, idx, own = (c.to_numpy() for c in b.columns)
            part = np.searchsorted(number, part)
            at = np.sort((own + before[part])[(idx > 0) | fresh[part]])  # a task may read several parts
            gap = np.searchsorted(low, at, side="right") - 1
            inside = (gap >= 0) & (at > low[gap]) & (at < high[gap])
            at, gap = at[inside], gap[inside]
            place = ((at - low[gap]) / (high[gap] - low[gap]) * SLICES).astype(np.int64)
            key, first, n = np.unique(gap * (SLICES + 2) + place, return_index=True, return_counts=True)
            a, z = (f.reduceat(at, first) if len(at) else at for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array((key // (SLICES + 2)).astype(np.int32)), pa.array((key % (SLICES + 2)).astype(np.int32)), pa.array(a), pa.array(z), pa.array(n)], names=["gap", "slice", "a", "b", "n"])

    return run


def assign(placed: DataFrame, cuts: list[int]) -> DataFrame:
    """The rows with their shard and slot, from where the shards begin."""
    number = F.lit(-1)
    for c in cuts:  # at most one for each shard
        number = number + (F.col("at") >= c).cast("int")
    rows = placed.withColumn("shard", number.cast("int"))
    first = rows.groupBy("shard").agg(F.min("no").alias("first"))
    out = rows.join(F.broadcast(first), "shard")  # a row a shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("no") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
