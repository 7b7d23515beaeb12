"""Leaf-wise boosted trees on histograms: a classifier for tables of numbers and categories."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..sources.scratch import Workspace, written
from .encode import exact_quantiles
from .metrics import value_places
from .sampling import rank_within

#: The usual settings of such a classifier.
ROUNDS, LEAVES, RATE, MIN_ROWS, MIN_HESSIAN, BINS = 200, 31, 0.05, 20, 1e-3, 255
#: As many numbers of bins (cells times columns) a task holds at most.
TASK_BINS = 4_000_000
NODES = "m int, tree int, node int, feature int, cut double, under int, over int, value double"
_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
SUMS = "m int, node int, feature int, part int, g array<double>, h array<double>, n array<double>"
SPLITS = "m int, node int, feature int, gain double, bin int, under_g double, under_h double, g double, h double"


@dataclass(frozen=True)
class Trees:
    """A start value and trees as arrays: a node's feature (-1 in a leaf), cut, children, value."""

    base: float
    trees: list[tuple[np.ndarray, ...]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        for *tree, value in self.trees:
            total += value[_leaves(x, *tree)]
        return 1 / (1 + np.exp(-total))


@dataclass(frozen=True)
class Tokens:
    """The numbers of categories: ``(column, token, nos)`` with a number a model, and by
    column those of all other tokens."""

    table: DataFrame
    others: list[list[float]]


def _leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, under: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        k = at[inner]
        at[inner] = np.where(x[inner, feature[k]] > cut[k], over[k], under[k])
    return at


def edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between the bins of a column: midpoints of its numbers, or of its quantiles."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins)))
    return _between(values)


def _between(values: np.ndarray) -> np.ndarray:
    return (values[:-1] + values[1:]) / 2


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, sizes: list[int], min_rows: int) -> tuple[float, int, int]:
    """``(gain, feature, bin)`` of the best cut of a leaf, from its sums by feature and bin;
    ties go to the first feature and bin. A gain of 0 is none."""
    best = (0.0, -1, -1)
    whole = g[0].sum(), h[0].sum(), n[0].sum()
    for j, size in enumerate(sizes):
        if size < 2:
            continue
        lg, lh, ln = (np.cumsum(a[j, : size - 1]) for a in (g, h, n))
        rg, rh, rn = whole[0] - lg, whole[1] - lh, whole[2] - ln
        ok = (ln >= min_rows) & (rn >= min_rows) & (lh >= MIN_HESSIAN) & (rh >= MIN_HESSIAN)
        if not ok.any():
            continue
        gain = np.where(ok, lg**2 / np.where(ok, lh, 1) + rg**2 / np.where(ok, rh, 1) - whole[0] ** 2 / whole[1], -np.inf)
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-10:
            best = (float(gain[k]), j, k)
    return best


def _start(share: float) -> float:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def _steps(y: np.ndarray, score: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the loss, of all rows of a cell together."""
    p = 1 / (1 + np.exp(-score))
    return weights * (y - p), weights * np.maximum(p * (1 - p), 1e-16)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE, min_rows: int = MIN_ROWS, bins: int = BINS, weights: np.ndarray | None = None, cuts: list[np.ndarray] | None = None) -> Trees:
    """Trees grown best leaf first on binned columns, by Newton steps on the logistic loss.

    A leaf's sums by feature and bin are counted for the smaller of two children and
    subtracted from the parent's for the other. A row may stand for several (``weights``);
    with given ``cuts`` the columns are numbers of bins."""
    weights = np.ones(len(y)) if weights is None else weights
    if cuts is None:
        cuts = [edges(x[:, j], bins) for j in range(x.shape[1])]
        x = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1) if cuts else np.zeros((len(x), 0), np.int64)
    sizes, width = [len(c) + 1 for c in cuts], max([len(c) + 1 for c in cuts], default=1)
    places = x.astype(np.int64) + np.arange(len(cuts)) * width
    base = _start(np.average(y, weights=weights))
    score, trees = np.full(len(y), base), []

    def sums(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        at, d = places[rows].ravel(), places.shape[1]
        return tuple(np.bincount(at, np.repeat(w[rows], d), d * width).reshape(d, width) for w in (g, h, weights))

    for _ in range(rounds):
        g, h = _steps(y, score, weights)
        nodes = [[-1, 0.0, -1, -1]]  # feature, cut, under, over
        rows, held = {0: np.arange(len(y))}, {0: sums(np.arange(len(y)))} if cuts else {}
        found = {0: best_split(*held[0], sizes, min_rows)} if cuts else {}
        while len(rows) < leaves and found:
            leaf = max(found, key=lambda k: (found[k][0], -k))
            gain, j, k = found.pop(leaf)
            if gain <= 0:
                break
            own, whole = rows.pop(leaf), held.pop(leaf)
            over = places[own, j] - j * width > k
            under_at, over_at = len(nodes), len(nodes) + 1
            nodes[leaf] = [j, float(cuts[j][k]), under_at, over_at]
            nodes += [[-1, 0.0, -1, -1], [-1, 0.0, -1, -1]]
            rows[under_at], rows[over_at] = own[~over], own[over]
            small, large = (under_at, over_at) if len(rows[under_at]) <= len(rows[over_at]) else (over_at, under_at)
            held[small] = sums(rows[small])
            held[large] = tuple(a - b for a, b in zip(whole, held[small]))
            for child in (under_at, over_at):
                found[child] = best_split(*held[child], sizes, min_rows)
        value = np.zeros(len(nodes))
        for leaf, own in rows.items():
            value[leaf] = rate * g[own].sum() / h[own].sum() if len(nodes) > 1 else 0.0
            score[own] += value[leaf]
        feature, cut, under, over = (np.array(c) for c in zip(*nodes))
        trees.append((feature.astype(np.int64), cut.astype(np.float64), under.astype(np.int64), over.astype(np.int64), value))
        if len(nodes) == 1:
            break
    return Trees(base, trees)


@dataclass
class _Growing:
    """A tree while its nodes are counted by Spark: of each node the best split with the sums
    under it and its own (feature -1: none), and of nodes looked into the children."""

    splits: dict[int, tuple] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    wanted: list[int] = field(default_factory=lambda: [0])

    def picks(self, leaves: int) -> list[tuple[int, int]]:
        """The splits in their order, best leaf first, as ``(number in the tree, node)``. A
        node not looked into ends there; what it hides can only push later ones out."""
        order, ends = [], {0: 0}
        while len(order) < leaves - 1 and ends:
            at = max(ends, key=lambda k: (self.splits[ends[k]][0], -k))
            node, n = ends.pop(at), 1 + 2 * len(order)
            if self.splits[node][0] <= 0:
                break
            order.append((at, node))
            ends |= dict(zip((n, n + 1), self.children.get(node, ())))
        return order

    def look(self, leaves: int) -> None:
        """Asks for the children of all splits that others could follow."""
        self.wanted = []
        for _, node in self.picks(leaves)[: leaves - 2]:
            if node not in self.children:
                n = 1 + 2 * len(self.children)
                self.children[node] = n, n + 1
                self.wanted += [n, n + 1]

    def known(self) -> tuple[np.ndarray, ...]:
        """The nodes looked into, with bins for cuts."""
        out = np.full((4, 1 + 2 * len(self.children)), -1, np.int64)
        for node, (under, over) in self.children.items():
            out[:, node] = *self.splits[node][1:3], under, over
        return tuple(out)

    def tree(self, leaves: int, rate: float) -> tuple[np.ndarray, ...]:
        """The tree, with bins for cuts."""
        order = self.picks(leaves)
        out, value = np.full((4, 1 + 2 * len(order)), -1, np.int64), np.zeros(1 + 2 * len(order))
        for i, (at, node) in enumerate(order):
            _, j, k, under_g, under_h, g, h = self.splits[node]
            out[:, at], value[at] = (j, k, 1 + 2 * i, 2 + 2 * i), 0.0
            value[1 + 2 * i : 3 + 2 * i] = rate * under_g / under_h, rate * (g - under_g) / (h - under_h)
        return *out, value


def fit_cells(cells: DataFrame, cuts: dict[int, list[np.ndarray]], shares: dict[int, float], rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE, min_rows: int = MIN_ROWS) -> dict[int, Trees]:
    """The trees of ``fit`` for cells that no task should hold: ``(m, y, w, b0, b1, ...)``,
    ``m`` the model and the rest its label, weight and bins.

    All models take a pass together. A pass sums by leaf, column and bin, and one row a leaf
    and column reaches the driver; it looks into all leaves that may be split, so a tree takes
    about as many passes as it is deep. Scores are written again after each tree."""
    bins = [c for c in cells.columns if c not in ("m", "y", "w")]
    sizes, width = {m: [len(c) + 1 for c in own] for m, own in cuts.items()}, max(len(c) + 1 for own in cuts.values() for c in own)
    spark, trees = cells.sparkSession, {m: [] for m in cuts}
    ws = Workspace(spark, "boosting")
    score = reduce(lambda c, m: F.when(F.col("m") == m, _start(shares[m])).otherwise(c), cuts, F.lit(0.0))
    table = ws.table(cells.withColumn("score", score).repartition(4 * spark.sparkContext.defaultParallelism), "0")

    def split(key: tuple, sums: pa.Table) -> pa.Table:
        m, node, j = (k.as_py() for k in key)
        sums = sums.sort_by("part")
        g, h, n = (sums[c].combine_chunks().flatten().to_numpy().reshape(-1, width).sum(0) for c in "ghn")
        gain, _, k = best_split(g[None], h[None], n[None], [sizes[m][j]], min_rows)
        row = m, node, j, gain, k, g[: k + 1].sum(), h[: k + 1].sum(), g.sum(), h.sum()
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int32(),) * 3 + (pa.float64(), pa.int32()) + (pa.float64(),) * 4)], names=[f.split()[0] for f in SPLITS.split(", ")])

    live = sorted(cuts)
    for done in range(rounds):
        growing = {m: _Growing() for m in live}
        while any(t.wanted for t in growing.values()):
            summed = table.mapInArrow(_summed({m: (t.known(), t.wanted) for m, t in growing.items() if t.wanted}, bins, width), SUMS)
            best: dict[tuple, tuple] = {}
            for r in sorted(summed.groupBy("m", "node", "feature").applyInArrow(split, SPLITS).collect()):  # a row a leaf and column
                if (r.m, r.node) not in best or r.gain > best[r.m, r.node][0] + 1e-10:
                    best[r.m, r.node] = r.gain, r.feature if r.gain > 0 else -1, *r[4:]
            for (m, node), x in best.items():
                growing[m].splits[node] = x
            for t in growing.values():
                t.look(leaves)
        new = {m: t.tree(leaves, rate) for m, t in growing.items()}
        for m, (feature, cut, under, over, value) in new.items():
            cut = np.array([cuts[m][j][k] if j >= 0 else 0.0 for j, k in zip(feature, cut)], np.float64)
            trees[m].append((feature, cut, under, over, value))
        live = [m for m in live if len(new[m][0]) > 1]
        if not live or done == rounds - 1:
            break
        table = ws.table(table.where(F.col("m").isin(live)).mapInArrow(_rescored(new, bins), table.schema), str(done + 1))
        ws.drop(str(done))
    ws.drop("")
    return {m: Trees(_start(shares[m]), own) for m, own in trees.items()}


def _by_model(b: pa.RecordBatch, bins: list[str], models) -> list[tuple]:
    """``(m, rows, bins, label, weight, score)`` of each model in a batch."""
    m, out = b["m"].to_numpy(), []
    for k in models:
        if (rows := np.flatnonzero(m == k)).size:
            out.append((k, rows, np.stack([b[c].to_numpy()[rows] for c in bins], 1), *(b[c].to_numpy()[rows] for c in ("y", "w", "score"))))
    return out


def _summed(looked: dict[int, tuple], bins: list[str], width: int):
    """Sums by leaf, column and bin of the wanted leaves, one row a leaf and column."""

    def run(batches):
        d = len(bins)
        held = {m: np.zeros((3, len(wanted) * d * width)) for m, (_, wanted) in looked.items()}
        for b in batches:
            for m, _, x, y, w, score in _by_model(b, bins, looked):
                known, wanted = looked[m]
                slots = np.full(len(known[0]), -1)
                slots[wanted] = np.arange(len(wanted))
                slot = slots[_leaves(x, *known)]
                use = slot >= 0
                at = ((slot[use, None] * d + np.arange(d)) * width + x[use]).ravel()
                for k, v in enumerate((*_steps(y[use], score[use], w[use]), w[use])):
                    held[m][k] += np.bincount(at, np.repeat(v, d), held[m].shape[1])
        part = TaskContext.get().partitionId()
        for m, (_, wanted) in looked.items():
            rows = len(wanted) * d
            if held[m][2].any():
                own = [pa.FixedSizeListArray.from_arrays(pa.array(v), width).cast(pa.list_(pa.float64())) for v in held[m]]
                ids = np.full(rows, m), np.repeat(wanted, d), np.tile(np.arange(d), len(wanted)), np.full(rows, part)
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in ids), *own], names=["m", "node", "feature", "part", "g", "h", "n"])

    return run


def _rescored(new: dict[int, tuple], bins: list[str]):
    """Adds a tree's values to the scores."""

    def run(batches):
        for b in batches:
            score = b["score"].to_numpy().copy()
            for m, rows, x, *_ in _by_model(b, bins, new):
                *tree, value = new[m]
                score[rows] += value[_leaves(x, *tree)]
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(score))

    return run


def _fit_tokens(rows: DataFrame, models: int, categorical: list[str]) -> Tokens | None:
    """Categories of each model numbered by falling frequency, then by name."""
    if not categorical:
        return None
    each = rows.select(F.explode(F.array(*(F.struct((F.col("m") + i * models).alias("g"), F.col(c).alias("token")) for i, c in enumerate(categorical)))).alias("x")).select("x.*")
    counts = written(each.groupBy("g", "token").agg(F.count(F.lit(1)).alias("n")), "tokens")
    size = {r.g: float(r["count"]) for r in counts.groupBy("g").count().collect()}
    others = [[size.get(i * models + m, 0.0) for m in range(models)] for i in range(len(categorical))]
    ranked = rank_within(counts, "g", [F.col("n").desc(), F.col("token").asc_nulls_first()], "no")
    ranked = ranked.withColumns({"column": F.floor(F.col("g") / models).cast("int"), "m": F.col("g") % models})
    unseen = F.get(F.array(*(F.array(*map(F.lit, own)) for own in others)), F.col("column"))
    nos = F.array(*(F.coalesce(F.max(F.when(F.col("m") == m, F.col("no") - 1.0)), F.get(unseen, F.lit(m))) for m in range(models)))
    return Tokens(written(ranked.groupBy("column", "token").agg(nos.alias("nos")), "numbers"), others)


def _with_numbers(rows: DataFrame, tokens: Tokens | None, categorical: list[str]) -> DataFrame:
    """``rows`` with an array ``__c0``, ``__c1``, ... a category: its numbers by model."""
    for i, c in enumerate(categorical):
        own = tokens.table.where(F.col("column") == i).select(F.col("token").alias("__token"), F.col("nos").alias(f"__c{i}"))
        rows = rows.join(own, F.col(c).cast("string").eqNullSafe(F.col("__token")), "left").drop("__token")
        rows = rows.withColumn(f"__c{i}", F.coalesce(f"__c{i}", F.array(*map(F.lit, tokens.others[i]))))
    return rows


def _fit_cuts(rows: DataFrame, models: int, columns: list[str]) -> dict[int, list[np.ndarray]]:
    """``edges`` of all rows, for each model and column. At most 255 numbers of each reach the driver."""
    if not columns:
        return {m: [] for m in range(models)}
    names = {f"{m}:{j}": F.when(F.col("m") == m, F.col(c)) for m in range(models) for j, c in enumerate(columns)}
    places, counts = value_places(rows, names)
    places = written(places, "places")
    distinct = {r.column_name: r["count"] for r in places.groupBy("column_name").count().collect()}
    many = [c for c in names if distinct.get(c, 0) > BINS]
    values = {c: [] for c in names}
    for r in places.where(~F.col("column_name").isin(many)).select("column_name", "v").collect():
        values[r.column_name].append(r.v)
    if many:
        facts = rows.sparkSession.createDataFrame([(c, counts[c], BINS - 1) for c in many], "column_name string, n long, steps long")
        values |= {r.column_name: r.quantiles for r in exact_quantiles(places.join(F.broadcast(facts), "column_name")).collect()}
    return {m: [_between(np.unique(np.array(values[f"{m}:{j}"], np.float64))) for j in range(len(columns))] for m in range(models)}


def fit_models(rows: DataFrame, model: str, label: str, key: str, numeric: list[str], categorical: list[str], seed: int, rounds: int = ROUNDS, train_rows: int | None = None, task_bins: int = TASK_BINS) -> tuple[dict[str, Trees], Tokens | None]:
    """Trees of each value of ``model`` (a few), fitted side by side, and numbers of the
    categories, by falling frequency; those not seen share the number after the last.

    A model learns from all of its rows, or from the ``train_rows`` with the least keyed
    numbers where a caller says so. Cuts come from all of them, and rows of a label that no
    cut tells apart are a cell with a weight, which gives the same trees. One task grows a
    model whose cells have at most ``task_bins`` numbers; others go by ``fit_cells``."""
    xs, cs = [f"x{j}" for j in range(len(numeric) + len(categorical))], [f"c{i}" for i in range(len(categorical))]
    keep = rows.select(F.col(model).cast("string").alias("model"), F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(x) for c, x in zip(numeric, xs)), *(F.col(c).cast("string").alias(x) for c, x in zip(categorical, cs)), uniform(key, seed, "train").alias("u"), F.col(key).alias("k"))
    names = sorted(r.model for r in keep.select("model").distinct().collect())
    if not names:
        return {}, None
    if train_rows is not None:
        keep = reduce(DataFrame.unionByName, [keep.where(F.col("model") == name).orderBy("u", "k").limit(train_rows) for name in names])
    m = reduce(lambda c, i: F.when(F.col("model") == names[i], i).otherwise(c), range(len(names)), F.lit(None))
    table = written(keep.select(m.cast("int").alias("m"), "y", *xs[: len(numeric)], *cs), "boosting")
    tokens = _fit_tokens(table, len(names), cs)
    if categorical:
        table = _with_numbers(table, tokens, cs).select("m", "y", *xs[: len(numeric)], *(F.get(f"__c{i}", F.col("m")).alias(x) for i, x in enumerate(xs[len(numeric) :])))
        table = written(table, "boosting")
    cuts, bins = _fit_cuts(table, len(names), xs), [f"b{j}" for j in range(len(xs))]

    def binned(batches):
        for b in batches:
            m = b["m"].to_numpy()
            out = np.zeros((len(xs), len(m)), np.int16)
            for i, own in cuts.items():
                at = np.flatnonzero(m == i)
                for j, cut in enumerate(own):
                    out[j, at] = np.searchsorted(cut, b[xs[j]].to_numpy(zero_copy_only=False)[at])
            yield pa.RecordBatch.from_arrays([b["m"], b["y"], *map(pa.array, out)], names=["m", "y", *bins])

    cells = table.mapInArrow(binned, ", ".join(["m int", "y double", *(f"{c} smallint" for c in bins)]))
    cells = written(cells.groupBy("m", "y", *bins).agg(F.count(F.lit(1)).cast("double").alias("w")), "cells")
    known = {r.m: r for r in cells.groupBy("m").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("share")).collect()}
    large = [i for i in known if known[i].n * len(xs) > task_bins]

    def run(key: tuple, own: pa.Table) -> pa.Table:
        i = key[0].as_py()
        own = own.sort_by([(c, "ascending") for c in ("y", *bins)])
        x = np.stack([own[c].to_numpy() for c in bins], 1) if bins else np.zeros((own.num_rows, 0))
        got = fit(x, own["y"].to_numpy(), rounds, LEAVES, RATE, MIN_ROWS, BINS, own["w"].to_numpy(), cuts[i])
        out = [(i, -1, 0, -1, 0.0, -1, -1, got.base)]
        out += [(i, t, n, *map(float, x)) for t, tree in enumerate(got.trees) for n, x in enumerate(zip(*tree))]
        return pa.table([pa.array([k.to_pandas_dtype()(v) for v in c], k) for c, k in zip(zip(*out), _KINDS)], names=[f.split()[0] for f in NODES.split(", ")])

    # a branch a model, so none waits for another in one task; sorted here, as a sort in Spark would first grow all trees for its ranges
    grown = [cells.where(F.col("m") == i).groupBy("m").applyInArrow(run, NODES) for i in known if i not in large]
    found = reduce(DataFrame.unionByName, grown).collect() if grown else []  # at most 2 * LEAVES rows a tree
    found.sort(key=lambda r: (r.m, r.tree, r.node))
    models = fit_cells(cells.where(F.col("m").isin(large)), {i: cuts[i] for i in large}, {i: known[i].share for i in large}, rounds) if large else {}
    for i in set(known) - set(large):
        own = [r for r in found if r.m == i]
        trees: dict[int, list] = {}
        for r in own[1:]:
            trees.setdefault(r.tree, []).append(r)
        models[i] = Trees(own[0].value, [tuple(np.array([r[f] for r in t]) for f in ("feature", "cut", "under", "over", "value")) for t in trees.values()])
    return {name: models[i] for i, name in enumerate(names)}, tokens


def score_models(rows: DataFrame, models: dict[str, Trees], tokens: Tokens | None, label: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``(source, label, score)``: every row scored by every model."""
    categorical = categorical if models else []  # nothing to score by

    def run(batches):
        for b in batches:
            numbers = [b[f"__x{j}"].to_numpy(zero_copy_only=False) for j in range(len(numeric))]
            nos = [b[f"__c{i}"].flatten().to_numpy().reshape(-1, len(models)) for i in range(len(categorical))]
            for k, (name, trees) in enumerate(models.items()):
                x = np.stack([*numbers, *(c[:, k] for c in nos)], 1) if numbers or nos else np.zeros((b.num_rows, 0))
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), b["__y"], pa.array(trees(x))], names=["source", "label", "score"])

    rows = _with_numbers(rows, tokens, categorical)
    rows = rows.select(F.col(label).cast("int").alias("__y"), *(F.col(c).cast("double").alias(f"__x{j}") for j, c in enumerate(numeric)), *(f"__c{i}" for i in range(len(categorical))))
    return rows.mapInArrow(run, "source string, label int, score double")
