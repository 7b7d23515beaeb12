"""Nearest-neighbour joins over numbers and categories, by cells of k-d trees on several levels."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lenient_double, normalise_category
from ..sources.scratch import Workspace
from .metrics import percentiles

BLOCK = 16384
LEFT_ROWS, LEAST_LEFT, TASK_ROWS = 16384, 4096, 65536
#: rows read a short stretch of points sorted along one of few numbers, so their cells are larger
LONG_BLOCK, LONG_ROWS, LONG_WIDTH = 131072, 32768, 2
KINDS, STEP = 256, 64
RUN, RUNS = 64, 64
CELL_ROWS, FAN, SAMPLE = 4096, 1024, 16384
CODEBOOK = 4096
BOUND_ROWS = 1024
BOTH = "both"
CUTS = "top int, cuts array<struct<dim:int,cut:double,under:int,over:int>>"
NEAR = "array<struct<d:double,id:bigint,m:int>>"


def scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """Mean, population deviation (0 becomes 1) and median of each number."""
    if not columns:
        return {}
    x = {c: lenient_double(F.col(f"`{c}`")) for c in columns}
    got = df.agg(*(f(x[c]).alias(f"{n}:{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    middle = percentiles(df, x, [0.5])
    return {c: (got[f"m:{c}"] or 0.0, got[f"s:{c}"] or 1.0, middle[c][0] or 0.0) for c in columns}


def standardise(col: Column, fit: tuple[float, float, float]) -> Column:
    mean, sd, median = fit
    return (F.coalesce(lenient_double(col), F.lit(median)) - mean) / sd


def _raw(df: DataFrame, numeric: list[str], categorical: list[str], by: str | None, *keep: Column) -> DataFrame:
    """The group, the numbers as they are, and the hashed categories of each row."""
    tokens = [F.xxhash64(normalise_category(F.col(f"`{c}`"), df.schema[c].dataType)) for c in categorical]
    group = F.lit("0") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("null"))
    return df.select(*keep, group.alias("cell"), F.array(*(lenient_double(F.col(f"`{c}`")) for c in numeric)).cast("array<double>").alias("x"), F.array(*tokens).cast("array<bigint>").alias("cat"))


def _fits(left: DataFrame, right: DataFrame, base: DataFrame, d: int) -> DataFrame:
    """``(cell, mean, sd, middle)``, a row a group: of the base's numbers. Medians, which
    only stand in for nulls, are looked for where either side has nulls."""
    sides = left.select("cell", "x", F.lit(0).alias("side")).unionByName(right.select("cell", "x", F.lit(0).alias("side"))).unionByName(base.select("cell", "x", F.lit(1).alias("side")))
    own = lambda j: F.when(F.col("side") == 1, F.col("x")[j])
    aggs = [f(own(j)).alias(f"{n}{j}") for j in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    aggs += [F.count_if((F.col("side") == 0) & F.col("x")[j].isNull()).alias(f"n{j}") for j in range(d)]
    got = sides.groupBy("cell").agg(F.lit(1).alias("one"), *aggs).collect()
    holes = {(r["cell"], j): F.when(F.col("cell") == r["cell"], F.col("x")[j]) for r in got for j in range(d) if r[f"n{j}"]}
    middle = percentiles(base, {f"{c}/{j}": x for (c, j), x in holes.items()}, [0.5]) if holes else {}
    rows = [(r["cell"], [r[f"m{j}"] or 0.0 for j in range(d)], [r[f"s{j}"] or 1.0 for j in range(d)], [(middle.get(f"{r['cell']}/{j}") or [0.0])[0] or 0.0 for j in range(d)]) for r in got]
    return left.sparkSession.createDataFrame(rows, "cell string, mean array<double>, sd array<double>, middle array<double>")


def _scaled(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """``rows`` with ``z``, their scaled numbers; ``fits`` has a row a group."""
    rows = rows.join(F.broadcast(fits), "cell")
    full = F.zip_with("x", "middle", lambda x, m: F.coalesce(x, m))
    z = F.zip_with(F.zip_with(full, "mean", lambda x, m: x - m), "sd", lambda x, s: x / s)
    return rows.withColumn("z", z).drop("x", "mean", "sd", "middle")


def _priced(rows: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``cost``, the squared price of another token for each category: 2 where
    the row's own occurs in the base (both one-hot places differ), else 1."""
    seen = base.select("cell", F.posexplode("cat").alias("j", "t")).distinct()
    for j in range(n):
        met = seen.where(F.col("j") == j).select("cell", F.col("t").alias(f"__t{j}"), F.lit(2.0).alias(f"__s{j}"))
        rows = rows.withColumn(f"__t{j}", F.col("cat")[j]).join(met, ["cell", f"__t{j}"], "left")
    cost = F.array(*(F.coalesce(f"__s{j}", F.lit(1.0)) for j in range(n))).cast("array<double>")
    return rows.withColumn("cost", cost).drop(*(f"__{a}{j}" for a in "ts" for j in range(n)))


class Tree:
    """A k-d tree of at most ``FAN`` leaves over one cell, cut on a sample of its points."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # dimension, cut, and two nodes; a leaf is -1 - number
        self.leaves = 0
        self.top = self._grow(sample, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(x) > 1 and x.shape[1]:
            j = int(np.argmax(x.max(0) - x.min(0)))
            cut = float(np.median(x[:, j]))
            cut = cut if (x[:, j] > cut).any() else float(np.nextafter(cut, -np.inf))
            over = x[:, j] > cut
            if over.any() and not over.all():
                at = len(self.cuts)
                self.cuts.append((j, cut, 0, 0))
                self.cuts[at] = (j, cut, self._grow(x[~over], leaves // 2), self._grow(x[over], leaves - leaves // 2))
                return at
        self.leaves += 1
        return -self.leaves


def _leaf(x: np.ndarray, top: int, cuts: list[dict]) -> np.ndarray:
    """The number of the leaf that each point falls into."""
    at = np.full(len(x), top)
    while (inner := np.flatnonzero(at >= 0)).size:
        for k in np.unique(at[inner]):
            rows, c = inner[at[inner] == k], cuts[k]
            at[rows] = np.where(x[rows, c["dim"]] > c["cut"], c["over"], c["under"])
    return -1 - at


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each point to each box; no member of the box is nearer."""
    d = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        d += np.maximum(np.maximum(low[None, :, j] - x[:, j : j + 1], x[:, j : j + 1] - high[None, :, j]), 0.0) ** 2
    return np.sqrt(d)


def _matrix(column, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _meet(rows: DataFrame, other: DataFrame, on: list[str], run, schema: str, work: Workspace, name: str) -> DataFrame:
    """Each group of ``rows``, which are read twice, with the same group of ``other``, by an
    Arrow function. Groups of many ``rows`` are dealt to several tasks, each with the other
    side. The number of tasks goes by rows and cores: these have few bytes for the work
    that they make."""
    cores = work.spark.sparkContext.defaultParallelism
    sizes = work.table(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), f"{name}-crowd")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    crowd = sizes.select(*on, F.ceil(F.col("n") / min(LEFT_ROWS, max(LEAST_LEFT, n // (2 * cores)))).cast("int").alias("crowd"))
    one = rows.join(crowd, on).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("crowd")).cast("int")).drop("crowd")
    two = other.join(crowd, on).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("crowd") - 1))).drop("crowd")
    by, tasks = [*on, "salt"], max(4 * cores, -(-n // TASK_ROWS))
    one, two = (side.repartition(tasks, *by) for side in (one, two))
    return one.groupBy(*by).cogroup(two.groupBy(*by)).applyInArrow(run, schema)


class Cells:
    """Points ``(cell, id, z, cat, m)`` in cells that are split again, level by level, while
    they hold too many; ``levels`` are the tables of trees and of their leaves' boxes. A box
    also names the combinations of categories in it, where all points together have few, so
    a row with a token that no point has does not visit all cells within that token's price.

    Counts decide what is split, in Spark; a cell's cuts come from a bounded sample of its
    points, its boxes, which decide what may be left out, from all of them. Nothing but
    whether there is more to split reaches the driver, so any number of cells will do."""

    def __init__(self, points: DataFrame, d: int, cell_rows: int, work: Workspace):
        self.levels: list[DataFrame] = []
        self.points, self.work, self.d = points, work, d
        #: few combinations of categories are told apart in the boxes, and split first
        found = points.select("cat").distinct().limit(KINDS + 1).count()
        few = found <= KINDS
        kinds = F.collect_set("cat") if few else F.array().cast("array<array<bigint>>")
        self.sizes = sizes = work.table(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
        active, rest = points, None
        while d:
            level, big = len(self.levels), sizes.where(F.col("n") > 4 * cell_rows)
            if big.isEmpty():
                break
            kind_first = not level and 1 < found <= KINDS
            if kind_first:
                plans = big.select("cell")
            else:
                share = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / float(1 << 30) < SAMPLE / F.col("n")
                plans = active.join(big, "cell").where(share).select("cell", "n", "z").groupBy("cell").applyInArrow(self._plan(cell_rows), f"cell string, {CUTS}")
                plans = work.table(plans, f"plans{level}")
            if plans.isEmpty():  # nothing but copies along the numbers
                break
            stay = active.join(plans.select("cell"), "cell", "left_anti")
            rest = stay if rest is None else rest.unionByName(stay)
            inside = active.join(plans.select("cell"), "cell", "left_semi")
            if kind_first:
                split = inside.withColumn("cell", F.concat("cell", F.lit("/"), F.array_join(F.col("cat").cast("array<string>"), "_")))
            else:
                split = _meet(inside, plans, ["cell"], self._place, "cell string, id long, z array<double>, cat array<bigint>, m int", work, f"split{level}")
            active = work.table(split.select("cell", "id", "z", "cat", "m"), f"cells{level}")
            edges = [F.array(*(f(F.col("z")[j]) for j in range(d))).alias(n) for n, f in (("low", F.min), ("high", F.max))]
            sizes = work.table(active.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges, (kinds if few else F.first(kinds)).alias("kinds")), f"sizes{level}")
            parent = F.regexp_replace("cell", "/[^/]*$", "")  # a group's name may hold a slash
            boxes = sizes.groupBy(parent.alias("cell")).agg(F.collect_list(F.struct(F.col("cell").alias("leaf"), "low", "high", "kinds")).alias("boxes"))  # FAN at most
            self.levels.append(work.table(boxes, f"level{level}"))
        if self.levels:
            self.levels = self._flat() or self.levels
            self.points = active.unionByName(rest)
            self.sizes = work.table(self.points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "leaves")

    def _flat(self) -> list[DataFrame]:
        """The last cells of all levels as one level, if they are not too many for it."""
        if len(self.levels) < 2:
            return []
        ends = None
        for i, level in enumerate(self.levels):
            below = level.select("cell", F.explode("boxes").alias("box"))
            if i + 1 < len(self.levels):
                below = below.join(self.levels[i + 1].select(F.col("cell").alias("split")), F.col("box.leaf") == F.col("split"), "left_anti")
            below = below.select(F.regexp_replace("cell", f"(/[^/]*){{{i}}}$", "").alias("cell"), "box")
            ends = below if ends is None else ends.unionByName(below)
        if not ends.groupBy("cell").count().where(F.col("count") > FAN).isEmpty():
            return []
        return [self.work.table(ends.groupBy("cell").agg(F.collect_list("box").alias("boxes")), "ends")]

    def _plan(self, cell_rows: int):
        def run(table: pa.Table) -> pa.Table:
            x, n = _matrix(table["z"], np.float64), table["n"][0].as_py()
            tree = Tree(x, min(FAN, -(-n // cell_rows)))
            cuts = [[dict(zip(("dim", "cut", "under", "over"), c)) for c in tree.cuts]]
            kind = pa.list_(pa.struct([("dim", pa.int32()), ("cut", pa.float64()), ("under", pa.int32()), ("over", pa.int32())]))
            return pa.table({"cell": table["cell"].slice(0, 1), "top": pa.array([tree.top], pa.int32()), "cuts": pa.array(cuts, kind)}).slice(0, int(tree.leaves > 1))

        return run

    @staticmethod
    def _place(key: tuple, rows: pa.Table, tree: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["cell", "id", "z", "cat", "m"])
        leaf = _leaf(_matrix(rows["z"], np.float64), tree["top"][0].as_py(), tree["cuts"][0].as_py())
        return pa.table([pa.array([f"{key[0].as_py()}/{n}" for n in leaf]), *(rows[c] for c in ("id", "z", "cat", "m"))], names=["cell", "id", "z", "cat", "m"])

    def visits(self, rows: DataFrame, name: str, bounded: bool, work: Workspace) -> DataFrame:
        """``rows`` with the cells of the last level that each must be compared with: the
        nearest, or all whose box is within its ``bound``."""

        def run(key: tuple, rows: pa.Table, level: pa.Table) -> pa.Table:
            fields = [c for c in rows.column_names if c not in ("cell", "salt")]
            if not rows.num_rows or not level.num_rows:
                return pa.table([pa.array([], pa.string()), *(rows[c].slice(0, 0) for c in fields)], names=["cell", *fields])
            boxes = level["boxes"][0].as_py()
            low, high = (np.array([b[k] for b in boxes], np.float64) for k in ("low", "high"))
            leaf, out = np.array([b["leaf"] for b in boxes], object), []
            names = {kind: n for n, kind in enumerate(sorted({tuple(c) for b in boxes for c in b["kinds"]}))}
            lack = np.full((len(boxes), len(names)), np.inf)
            for n, b in enumerate(boxes):
                lack[n, [names[tuple(c)] for c in b["kinds"]]] = 0.0
            kinds = np.array(list(names), np.int64).reshape(len(names), -1)
            told = names and kinds.shape[1]
            if told:  # no member has a category at a lower price
                ca, cost = _matrix(rows["cat"], np.int64), _matrix(rows["cost"], np.float64)
                _, place = _kinds(np.c_[ca, cost.view(np.int64)])
                _, one = np.unique(place, return_index=True)
                least = np.array([(p[None, :] + lack).min(1) for p in _prices(ca[one], cost[one], kinds)])
            for at in range(0, rows.num_rows, 1024):
                part = rows.slice(at, 1024)
                gap = _gaps(_matrix(part["z"], np.float64), low, high)
                if told:
                    gap = np.sqrt(gap * gap + least[place[at : at + 1024]])
                if bounded:
                    bound = part["bound"].to_numpy()
                    row, to = np.nonzero(gap <= bound[:, None] * (1 + 1e-9) + 1e-12)
                else:
                    row, to = np.arange(len(gap)), gap.argmin(1)
                take = pa.array(row)
                out.append(pa.table([pa.array(leaf[to], pa.string()), *(part[c].take(take) for c in fields)], names=["cell", *fields]))
            return pa.concat_tables(out)

        there = None
        for i, level in enumerate(self.levels):
            names = [c for c in rows.columns if c != "cell"]
            schema = "cell string, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
            stay = rows.join(level.select("cell"), "cell", "left_anti")
            there = stay if there is None else there.unionByName(stay)
            rows = rows.join(level.select("cell"), "cell", "left_semi")
            rows = work.table(_meet(rows, level, ["cell"], run, schema, work, f"{name}{i}"), f"{name}{i}-next")
        return rows.unionByName(there)


def _kinds(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix, and which of them each row is."""
    if not tokens.shape[1]:
        return tokens[:1], np.zeros(len(tokens), np.int64)
    found, place = np.unique(tokens, axis=0, return_inverse=True)
    return found, place.ravel()


def _runs(x: np.ndarray, size: int) -> tuple[np.ndarray, list[int]]:
    """An order of points in which each stretch between two of the places, of ``size`` at
    most, is a cell of a k-d tree."""
    order, ends, todo = np.arange(len(x)), [0], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            ends.append(hi)
            continue
        own, middle = order[lo:hi], (lo + hi) // 2
        if x.shape[1]:
            part = x[own]
            order[lo:hi] = own[np.argpartition(part[:, np.argmax(part.max(0) - part.min(0))], middle - lo)]
        todo += [(middle, hi), (lo, middle)]
    return order, ends


def _prices(own: np.ndarray, cost: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What the categories add to the squared distance of each row to each of ``kinds``."""
    out = np.zeros((len(own), len(kinds)))
    for j in range(own.shape[1]):
        out += (own[:, j, None] != kinds[None, :, j]) * cost[:, j, None]
    return out


def _nearest(k: int, exclude_self: bool):
    """Rows and points of one combination of categories differ by a fixed price. Its points
    lie in runs of some ``RUN``, whose boxes tell a batch of rows close together which runs
    are within its bound. Many combinations are compared as one."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("m", pa.int32())]))
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], kind)})
        a, b, ca, cb, cost = (_matrix(t[c], x) for t, c, x in ((left, "z", np.float64), (right, "z", np.float64), (left, "cat", np.int64), (right, "cat", np.int64), (left, "cost", np.float64)))
        copies, ids = right["m"].to_numpy(), right["id"].to_numpy()
        k_here = min(k + exclude_self, len(copies))
        kinds, of = _kinds(cb)
        asks, own = _kinds(np.c_[ca, cost.view(np.int64)])
        mixed = max(len(kinds), len(asks)) > KINDS
        if mixed:
            kinds, of, asks, own = kinds[:1], np.zeros(len(cb), np.int64), asks[:1], np.zeros(len(ca), np.int64)
        order = np.argsort(of, kind="stable")
        runs = [(g, order[lo:hi], *_runs(b[order[lo:hi]], RUN)) for g, (lo, hi) in enumerate(pairwise(np.searchsorted(of[order], np.arange(len(kinds) + 1))))]
        order = np.concatenate([members[turn] for _, members, turn, _ in runs])
        b, cb, copies, ids = b[order], cb[order], copies[order], ids[order]
        sizes, of = np.concatenate([np.diff(ends) for *_, ends in runs]), np.repeat([g for g, *_ in runs], [len(ends) - 1 for *_, ends in runs])
        starts = np.cumsum(sizes) - sizes
        low, high = (f.reduceat(b, starts, axis=0) for f in (np.minimum, np.maximum))
        lines = list(np.ascontiguousarray(b.T))

        def distances(rows: np.ndarray, to: np.ndarray, price: np.ndarray) -> np.ndarray:
            d = np.repeat(price[None, :], len(rows), axis=0)
            for j, line in enumerate(lines):
                gap = a[rows, j, None] - line[None, to]
                d += gap * gap
            for j in range(ca.shape[1] if mixed else 0):
                d += (ca[rows, j, None] != cb[None, to, j]) * cost[rows, j, None]
            return d

        def best(d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if d.shape[1] <= k_here and k_here > 1:
                return d, at
            if k_here == 1:
                take = d.argmin(1)[:, None]
                if np.count_nonzero(equal := d == np.take_along_axis(d, take, 1)) > len(d):  # of equal ones the least id
                    take = np.where(equal, ids[at], np.iinfo(np.int64).max).argmin(1)[:, None]
            else:
                take = np.argpartition(d, k_here - 1, axis=1)[:, :k_here]
            return np.take_along_axis(d, take, 1), np.take_along_axis(at, take, 1)

        def gaps(under: np.ndarray, over: np.ndarray) -> np.ndarray:
            gap = np.maximum(np.maximum(low - over, under - high), 0.0)
            return (gap * gap).sum(1)

        ds, ns, ms = (np.empty((len(ca), k_here), x) for x in (np.float64, np.int64, np.int64))
        for ask in range(len(asks)):
            mine = np.flatnonzero(own == ask)
            turn, ends = _runs(a[mine], STEP)
            price = (np.zeros(1) if mixed else _prices(ca[mine[:1]], cost[mine[:1]], kinds)[0])[of]
            for begin, end in pairwise(ends):
                rows = mine[turn[begin:end]]
                under, over = a[rows].min(0), a[rows].max(0)
                gap, middle = gaps(under, over) + price, (under + over) / 2
                way = np.lexsort((gaps(middle, middle), gap))
                # first the runs that the batch lies in, or some beside it
                first = min(RUNS, max(2 + 2 * k_here // RUN, np.count_nonzero(gap == gap[way[0]])))
                d, at, bound = np.empty((len(rows), 0)), np.empty((len(rows), 0), np.int64), np.inf
                for part in (way[:first], *(way[n : n + RUNS] for n in range(first, len(way), RUNS))):
                    part = part[~(gap[part] > bound)]  # NaN tells nothing
                    if not len(part):
                        break
                    size = sizes[part]
                    to = np.repeat(starts[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    more = distances(rows, to, np.repeat(price[part], size))
                    d, at = best(np.c_[d, more], np.c_[at, np.broadcast_to(to, more.shape)])
                    if d.shape[1] == k_here:
                        bound = d.max() * (1 + 1e-9) + 1e-12
                m = copies[at] - (d == 0) * exclude_self  # the point of the row itself has a copy less
                ds[rows], ns[rows], ms[rows] = np.where(m > 0, np.sqrt(d), np.inf), ids[at], np.minimum(m, k)
        d, n, m = (x.ravel() for x in (ds, ns, ms))
        finite = np.isfinite(d)
        size = np.add.reduceat(finite, np.arange(0, len(d), k_here)).astype(np.int64)
        near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(d[finite]), pa.array(n[finite]), pa.array(m[finite].astype(np.int32))], ["d", "id", "m"]))
        return pa.table({"id": left["id"], "near": near})

    return run


def _bound(k: int, exclude_self: bool):
    """The rows with the distance of their ``k``-th nearest point of those met as ``bound``
    (infinite, if there are fewer)."""
    nearest = _nearest(k, exclude_self)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [c for c in left.column_names if c not in ("cell", "salt")]
        bound, near = np.full(left.num_rows, np.inf), nearest(key, left, right)["near"].combine_chunks()
        if len(near):
            row = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy(zero_copy_only=False))
            d, m = (near.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            order = np.lexsort((d, row))
            row, d, upto = row[order], d[order], np.cumsum(m[order])
            starts = np.searchsorted(row, np.arange(len(near)))
            enough = upto - np.r_[0, upto][starts][row] >= k
            rows, first = np.unique(row[enough], return_index=True)
            bound[rows] = d[enough][first]
        return pa.table([*(left[c] for c in fields), pa.array(bound)], names=[*fields, "bound"])

    return run


def _bounded(rows: DataFrame, cells: Cells, k: int, exclude_self: bool, block: int, work: Workspace) -> DataFrame:
    """``rows`` with a ``bound`` from some ``BOUND_ROWS`` points of the nearest cell of each."""
    near = cells.visits(rows.withColumn("home", F.col("cell")), "first", False, work)
    parts = cells.sizes.select("cell", F.ceil(F.col("n") / min(block, max(BOUND_ROWS, 8 * k))).alias("parts"))
    some = cells.points.join(parts, "cell").where(F.pmod(F.xxhash64("id"), F.col("parts")) == 0).select("cell", "id", "z", "cat", "m")
    names = [c for c in near.columns if c != "cell"]
    schema = ", ".join(f"{c} {near.schema[c].dataType.simpleString()}" for c in names) + ", bound double"
    got = work.table(_meet(near, some, ["cell"], _bound(k, exclude_self), schema, work, "bounds"), "bound")
    return got.withColumnRenamed("home", "cell")


def _compare(rows: DataFrame, points: DataFrame, sizes: DataFrame, k: int, exclude_self: bool, block: int, work: Workspace, name: str) -> DataFrame:
    """``(id, near)``: the ``k`` nearest points of each row in the cells it visits. Points are
    compared by blocks, as arrays, and each hands on ``k`` numbers a row; a point met in
    several cells counts once."""
    parts = sizes.select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    blocks = points.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    sent = rows.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    near = _meet(sent.select("cell", "part", "id", "z", "cat", "cost"), blocks.select("cell", "part", "id", "z", "cat", "m"), ["cell", "part"], _nearest(k, exclude_self), f"id long, near {NEAR}", work, name)
    return near.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + exclude_self).alias("near"))


def _expanded(found: DataFrame, k: int) -> DataFrame:
    """Distances alone, those of points as often as they have copies."""
    return found.select("id", F.slice(F.flatten(F.transform("near", lambda x: F.array_repeat(x["d"], x["m"]))), 1, k).alias("near"))


def _search(rows: DataFrame, cells: Cells, k: int, exclude_self: bool, block: int, work: Workspace) -> DataFrame:
    """The nearest points of ``rows``, exactly: bounds from the nearest cells first, where
    there are several."""
    rows = work.table(rows, "search")
    if cells.levels:
        rows = cells.visits(_bounded(rows, cells, k, exclude_self, block, work), "second", True, work)
    return _compare(rows, cells.points, cells.sizes, k, exclude_self, block, work, "near")


def _sides(left: DataFrame, right: DataFrame, key: str, numeric: list[str], categorical: list[str], exclude_self: bool, fit, by: str | None, work: Workspace):
    """The left rows with an id of their own, their points, and the right side's points,
    equal ones as one with the number of its copies."""
    a = _kept(left, key, numeric, categorical, by, work, "left")
    spots = _spots(a, work)
    b = a.select("cell", "x", "cat") if exclude_self else work.table(_raw(right, numeric, categorical, by), "right")
    base = b if fit is None else a.select("cell", "x", "cat").unionByName(b) if isinstance(fit, str) else work.table(_raw(fit, numeric, categorical, by), "base")
    fits = _fits(a, b, base, len(numeric))
    copied, rows = _asked(a, spots, base, fits, len(categorical))
    return a, copied, rows, _points(spots if exclude_self else b.withColumn("m", F.lit(1)), fits, work)


def _kept(df: DataFrame, key: str, numeric: list[str], categorical: list[str], by: str | None, work: Workspace, name: str) -> DataFrame:
    """Rows with an id, their key and their group, written."""
    return work.table(_raw(df, numeric, categorical, by, F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), *([F.col(by).alias("by")] if by else [])), name)


def _spots(a: DataFrame, work: Workspace) -> DataFrame:
    """Equal rows as one, with an id and the number of copies."""
    return work.table(a.groupBy("cell", "x", "cat").agg(F.count(F.lit(1)).alias("m")).select(F.monotonically_increasing_id().alias("id"), "cell", "x", "cat", "m"), "spots")


def _asked(a: DataFrame, spots: DataFrame, base: DataFrame, fits: DataFrame, categories: int) -> tuple[DataFrame | None, DataFrame]:
    """The spots, if these are asked for, and what is asked for: spots or rows."""
    copied = 2 * spots.count() <= a.count()  # else the way back to the rows costs more than it saves
    asked = spots if copied else a
    return spots if copied else None, _priced(_scaled(asked.select("id", "cell", "x", "cat"), fits), base, categories)


def _points(rows: DataFrame, fits: DataFrame, work: Workspace) -> DataFrame:
    points = _scaled(rows, fits).groupBy("cell", "z", "cat").agg(F.sum("m").cast("int").alias("m"))
    return work.table(points.select("cell", F.monotonically_increasing_id().alias("id"), "z", "cat", "m"), "points")


def _keyed(a: DataFrame, spots: DataFrame | None, near: DataFrame, key: str, by: str | None, work: Workspace) -> DataFrame:
    """Each left row once, with what was found for it (or for its copies), if anything."""
    none = F.array().cast("array<double>")
    if spots is not None:
        near = spots.select("id", "cell", "x", "cat").join(near, "id").drop("id")
    near = work.table(near, "found")  # compared once, however often it is read; and a join may split a large group of copies
    on = ["id"] if spots is None else ["cell", "x", "cat"]
    out = a.select(*on, F.col("key").alias(key), *([F.col("by").alias(by)] if by else []))
    return out.join(near, on, "left").withColumn("near", F.coalesce("near", none)).drop(*on)


def knn(left: DataFrame, right: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int = 1, exclude_self: bool = False, fit: DataFrame | str | None = None, block: int | None = None, cell_rows: int | None = None, by: str | None = None) -> DataFrame:
    """``(key, near)``, one row per row of ``left`` whatever its key: ascending distances to
    its ``k`` nearest right rows (all, if fewer; none of an empty table).

    Numbers are scaled by ``fit`` (the right table by default, ``BOTH`` for the two
    together), nulls are its medians; a category costs nothing if equal. ``exclude_self``
    takes the left table as the right one too and compares each row with all others; a
    copy of a row, also one with the same key, is another row. ``by`` names a column that
    both sides (and ``fit``) have: rows meet within a group only, and each group is scaled
    by itself. A null group is one; a few numbers of each group come to the driver.

    Equal right rows are one point with a number of copies. Points lie in cells of k-d
    trees over the numbers, each split again while it holds more than ``4 * cell_rows``
    (``Cells``). A left row is compared with a block of its nearest cell, which bounds its
    distances, and then with all cells whose box is within the bound, so the result is
    exact and far cells are never read. Where no cell had to be split, that is skipped.
    Cells that many rows visit are dealt to several tasks. Up to two numbers have larger
    cells by default, as sorted points then leave a row little to read.
    """
    block, cell_rows = _limits(numeric, block, cell_rows)
    work = Workspace(left.sparkSession, "knn")
    a, spots, rows, points = _sides(left, right, key, numeric, categorical, exclude_self, fit, by, work)
    cells = Cells(points, len(numeric), cell_rows, work)
    return _keyed(a, spots, _expanded(_search(rows, cells, k, exclude_self, block, work), k), key, by, work)


def _limits(numeric: list[str], block: int | None, cell_rows: int | None) -> tuple[int, int]:
    long = len(numeric) <= LONG_WIDTH
    return block or (LONG_BLOCK if long else BLOCK), cell_rows or (LONG_ROWS if long else CELL_ROWS)


def knn_and_own(left: DataFrame, right: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int = 1, block: int | None = None, cell_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``knn`` of the left rows, and of the right rows among themselves (``exclude_self``):
    the right side is read, scaled and put into cells once for both."""
    block, cell_rows = _limits(numeric, block, cell_rows)
    work, again = (Workspace(left.sparkSession, "knn") for _ in range(2))
    a, b = _kept(left, key, numeric, categorical, None, work, "left"), _kept(right, key, numeric, categorical, None, again, "left")
    base, spots = b.select("cell", "x", "cat"), _spots(b, again)
    fits = _fits(a, b, base, len(numeric))
    cells = Cells(_points(spots, fits, again), len(numeric), cell_rows, again)
    out = []
    for side, its_spots, own, place in ((a, _spots(a, work), False, work), (b, spots, True, again)):
        copied, rows = _asked(side, its_spots, base, fits, len(categorical))
        out.append(_keyed(side, copied, _expanded(_search(rows, cells, k, own, block, place), k), key, None, place))
    return tuple(out)


def knn_approximate(left: DataFrame, right: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int = 1, exclude_self: bool = False, fit: DataFrame | str | None = None, block: int = BLOCK, by: str | None = None, tables: int = 4, projections: int = 2, bucket_rows: int = 512, seed: int = 42) -> DataFrame:
    """``knn`` by bucketed random projections: each row meets only the points of its own
    buckets and of those beside them, in ``tables`` tables of ``projections`` directions,
    and the distances to these are exact. Rows with no point there have an empty list.

    A category counts as its one-hot place, whose weight in a direction is a normal number
    drawn from its hash. Buckets of a direction are as wide as holds ``bucket_rows`` points
    a bucket on average, measured from the spread of all points; a bucket with more is
    compared by blocks, and equal points are one. Work is in proportion to rows, tables and
    ``3 ** projections`` buckets; recall rises with tables and bucket rows.
    """
    work = Workspace(left.sparkSession, "lsh")
    a, spots, rows, points = _sides(left, right, key, numeric, categorical, exclude_self, fit, by, work)
    d, c = len(numeric), len(categorical)
    drawn = np.random.default_rng(seed)
    ways = drawn.normal(size=(tables * projections, d))
    shift = drawn.random(tables * projections)

    def project(z, cat):
        x = _matrix(z, np.float64) @ ways.T if d else np.zeros((len(z), len(ways)))
        h = _matrix(cat, np.int64).view(np.uint64) if c else np.zeros((len(z), 0), np.uint64)
        for j in range(c):
            for i in range(len(ways)):
                u = (h[:, j] ^ np.uint64(0x9E3779B97F4A7C15 * (i * 64 + j + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                u = (u ^ (u >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                u1, u2 = ((u >> np.uint64(33)).astype(float) + 1) / 2**31, (u & np.uint64(0x7FFFFFFF)).astype(float) / 2**31
                x[:, i] += np.sqrt(-2 * np.log(np.minimum(u1, 1.0))) * np.cos(2 * np.pi * u2)
        return x

    def places(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(project(b.column(1), b.column(2))), pa.list_(pa.float64()))], names=["cell", "p"])

    spread = points.select("cell", "z", "cat").mapInArrow(places, "cell string, p array<double>").groupBy("cell")
    spread = spread.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.stddev_pop(F.col("p")[i]) for i in range(len(ways)))).alias("sd")).collect()  # a row a group
    # a normal spread has most of its points within four deviations
    width = {r["cell"]: np.maximum(np.array(r["sd"]) * 4 * min(1.0, (bucket_rows / r["n"]) ** (1 / projections)), 1e-12) for r in spread}

    def buckets(around: tuple[int, ...], fields: list[str]):
        steps = np.array(np.meshgrid(*[around] * projections)).reshape(projections, -1).T

        def run(batches):
            for b in (t.slice(at, 2048) for t in batches for at in range(0, t.num_rows, 2048)):
                cell = b.column("cell").to_pylist()
                wide = np.array([width.get(x, np.ones(len(ways))) for x in cell]).reshape(len(cell), len(ways))
                at = np.floor(project(b.column("z"), b.column("cat")) / wide + shift).astype(np.int64)
                for t in range(tables):
                    own = at[:, t * projections : (t + 1) * projections]
                    for step in steps:
                        name = [f"{x}/{t}/{'/'.join(map(str, y))}" for x, y in zip(cell, (own + step).tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *(b.column(f) for f in fields)], names=["cell", *fields])

        return run

    # the smaller side goes to the buckets beside its own too: the same pairs meet
    beside, own = (-1, 0, 1), (0,)
    around, asked = (beside, own) if sum(r["n"] for r in spread) <= (a if spots is None else spots).count() else (own, beside)
    put = points.mapInArrow(buckets(around, ["id", "z", "cat", "m"]), "cell string, id long, z array<double>, cat array<bigint>, m int")
    ask = rows.select("cell", "id", "z", "cat", "cost").mapInArrow(buckets(asked, ["id", "z", "cat", "cost"]), "cell string, id long, z array<double>, cat array<bigint>, cost array<double>")
    put, ask = work.table(put, "put"), work.table(ask, "ask")
    sizes = work.table(put.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return _keyed(a, spots, _expanded(_compare(ask, put, sizes, k, exclude_self, block, work, "near"), k), key, by, work)


def knn_features(left: DataFrame, generated: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int, by: str | None = None) -> DataFrame:
    """Least, mean and deviation of the k nearest distances, and least over mean; nulls where
    nothing is near. Scaling is fitted on both sides together, in each group of ``by``."""
    near = knn(left, generated, key, numeric, categorical, k, fit=BOTH, by=by).withColumn("near", F.when(F.size("near") > 0, F.col("near")))
    mean = F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")
    out = near.withColumn("d_min", F.get("near", 0)).withColumn("d_mean", mean)
    sd = F.sqrt(F.aggregate("near", F.lit(0.0), lambda s, x: s + (x - F.col("d_mean")) * (x - F.col("d_mean"))) / F.size("near"))
    return out.withColumn("d_std", sd).withColumn("d_ratio", F.col("d_min") / F.greatest(F.col("d_mean"), F.lit(1e-8))).drop("near")


def nearest_code(df: DataFrame, vector: str, codebook: DataFrame, offset: int = 0, width: int | None = None, most: int = CODEBOOK, block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``code`` and ``code_distance``: the nearest vector of a codebook (``idx, vector``) to
    a slice of each row's vector; the lowest index wins ties. A null vector has neither.

    A codebook of up to ``most`` vectors goes along as one matrix. A longer one of any
    size is joined by cells of k-d trees, as in ``knn``; both are exact. An empty one is
    an error."""
    rows = codebook.orderBy("idx").limit(most + 1).collect()
    if not rows:
        raise ValueError("a codebook has at least one vector")
    d = width or len(rows[0]["vector"])
    own = F.slice(F.col(vector).cast("array<double>"), offset + 1, d)
    if len(rows) <= most:
        found = F.arrow_udf(_codes(np.array([r["idx"] for r in rows]), np.array([r["vector"] for r in rows], np.float64)), "struct<code:bigint,d:double>")
        return df.withColumn("__best", found(own)).withColumn("code", F.col("__best.code")).withColumn("code_distance", F.col("__best.d")).drop("__best")
    work = Workspace(df.sparkSession, "codes")
    none, left = F.array().cast("array<bigint>"), work.table(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    points = work.table(codebook.select(F.lit("0").alias("cell"), F.col("idx").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("z"), none.alias("cat"), F.lit(1).alias("m")), "codes")
    asked = left.where(own.isNotNull()).select(F.lit("0").alias("cell"), F.col("__row").alias("id"), own.alias("z"), none.alias("cat"), F.array().cast("array<double>").alias("cost"))
    best = work.table(_search(work.table(asked, "asked"), Cells(points, d, cell_rows, work), 1, False, block, work).select(F.col("id").alias("__row"), F.get("near", 0).alias("__best")), "best")
    return left.join(best, "__row", "left").withColumn("code", F.col("__best.id")).withColumn("code_distance", F.col("__best.d")).drop("__row", "__best")


def _codes(idx: np.ndarray, book: np.ndarray):
    """The nearest row of a matrix: by products first, then exactly among those that
    rounding cannot tell apart; the matrix is in the order of its indexes."""
    square = (book**2).sum(1)

    def run(own: pa.Array) -> pa.Array:
        known = own.is_valid().to_numpy(zero_copy_only=False)
        x = _matrix(own.filter(pa.array(known)), np.float64)
        code, dist = np.zeros(len(own), np.int64), np.zeros(len(own))
        at_known = np.flatnonzero(known)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            near = square[None, :] - 2 * part @ book.T
            slack = 1e-9 * (1 + (part**2).sum(1) + square.max())
            row, col = np.nonzero(near <= (near.min(1) + slack)[:, None])
            d = np.sqrt(((part[row] - book[col]) ** 2).sum(1))
            order = np.lexsort((col, d, row))
            first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
            code[at_known[at : at + 1024]], dist[at_known[at : at + 1024]] = idx[col[first]], d[first]
        gone = pa.array(~known)
        return pa.StructArray.from_arrays([pa.array(code, mask=~known), pa.array(dist, mask=~known)], ["code", "d"], mask=gone)

    return run


def parity_report(a: DataFrame, b: DataFrame, key: str, vector: str, rtol: float = 1e-5, atol: float = 1e-5, scale: float = 1.0) -> DataFrame:
    """Reconciles two keyed tables of vectors in one row."""
    pairs = a.select(key, F.col(vector).cast("array<double>").alias("x")).join(b.select(key, F.col(vector).cast("array<double>").alias("y")), key)
    gap = F.zip_with("x", "y", lambda x, y: F.abs(x - y))
    close = F.forall(F.zip_with("x", "y", lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)
    arg = lambda c: F.array_position(c, F.array_max(c))
    each = pairs.select(F.array_max(gap).alias("gap"), close.alias("close"), (arg("x") == arg("y")).alias("same"))
    return each.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("gap").alias("max_abs_diff"), F.every("close").alias("all_close"), (F.max("gap") * scale).alias("amplified_max_abs_diff"),
        (F.max("gap") * scale <= atol).alias("amplified_within"), F.avg(F.col("same").cast("double")).alias("argmax_agreement"), F.lit(scale).alias("cfg_scale"),
    )
