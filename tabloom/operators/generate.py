"""A Gaussian copula, or a mixture, fitted by Spark: sampling, augmenting, balancing, filling, what-if."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import normal, uniform
from ..functions.scalars import NULL_TOKEN, normal_cdf, normal_quantile, normalise_category
from ..sources.scratch import written
from .encode import Quantiles, fit_quantiles, intervene, lookup
from .sets import class_deficit, union_relaxed

INTEGERS = ("tinyint", "smallint", "int", "bigint")
TIMES = ("date", "timestamp", "timestamp_ntz")
CATEGORIES = 10_000
RIDGE = 1e-6
PATTERNS = 1024
WIDE = 16


@dataclass(frozen=True)
class Generator:
    """Marginals of each column, and the normal scores' distribution: one Gaussian, or a
    mixture of several (a weight, a mean and a covariance each)."""

    columns: tuple[str, ...]
    types: dict[str, str]
    quantiles: dict[str, Quantiles]
    tokens: dict[str, tuple[tuple[str, ...], tuple[float, ...]]]
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray


def _number(c: str, kind: str) -> Column:
    return F.unix_timestamp(F.col(f"`{c}`").cast("timestamp")).cast("double") if kind in TIMES else F.col(f"`{c}`").cast("double")


def with_scores(df: DataFrame, model: Generator, key: str, seed: int, out: str = "z") -> DataFrame:
    """``out``: the normal scores of the model's columns, null where a cell is null.

    Each step is a projection of its own, so the expressions stay small."""
    numeric, tokens = list(model.quantiles), list(model.tokens)
    known = {c: F.col(f"`{c}`").isNotNull() for c in model.columns}
    step = df.withColumns({f"__x_{c}": _number(c, model.types[c]) for c in numeric} | {f"__x_{c}": _interval(model.tokens[c], normalise_category(F.col(f"`{c}`"), df.schema[c].dataType)) for c in tokens})
    inside = lambda c: F.col(f"__x_{c}.a") + (F.col(f"__x_{c}.b") - F.col(f"__x_{c}.a")) * uniform(key, seed, f"in-{c}")
    step = step.withColumns({f"__p_{c}": (model.quantiles[c].encode(F.col(f"__x_{c}")).cast("double") + 1) / 2 for c in numeric} | {f"__p_{c}": inside(c) for c in tokens})
    step = step.withColumn(out, F.array(*(F.when(known[c], normal_quantile(F.col(f"__p_{c}"))) for c in model.columns)))
    return step.drop(*(f"__{a}_{c}" for a in "xp" for c in model.columns))


def _interval(part: tuple, token: Column) -> Column:
    """The share of all rows before a token and up to it; null for a token never met."""
    tokens, upto = part
    names, after = pa.array(tokens, pa.string()), pa.array(upto, pa.float64())
    before = pa.array([0.0, *upto[:-1]], pa.float64())

    def run(x: pa.Array) -> pa.Array:
        at = pc.index_in(x.cast(pa.string()), names)
        return pa.StructArray.from_arrays([before.take(at), after.take(at)], ["a", "b"])

    return F.arrow_udf(run, "a double, b double")(token)


def latent_moments(df: DataFrame, col: str, width: int) -> DataFrame:
    """``(i, j, mean_i, mean_j, cov)`` of an array column, in one aggregate; for long
    arrays, whose pairs are too many expressions, from sums of products of each task."""
    if width > WIDE:
        return _wide_moments(df, col, width)
    x = [F.col(col)[i] for i in range(width)]
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.avg(x[i]).alias("mean_i"), F.avg(x[j]).alias("mean_j"), F.covar_pop(x[i], x[j]).alias("cov")) for i in range(width) for j in range(i + 1)]
    return df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def _wide_moments(df: DataFrame, col: str, width: int) -> DataFrame:
    """The same from matrices: values less their mean, so that sums of products stay small."""
    rows = df.select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(col, i).cast("double")).alias("x"))
    found = {r.pos: r.m for r in rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m")).collect()}
    means = [found.get(i) for i in range(width)]
    centre = np.array([m or 0.0 for m in means])
    i, j = np.tril_indices(width)

    def run(batches):
        n, s, c = (np.zeros((width, width)) for _ in range(3))
        for b in batches:
            flat = b.column(0).flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = np.where(known, flat.to_numpy(zero_copy_only=False).reshape(-1, width) - centre, 0.0)
            n, s, c = n + known.T.astype(float) @ known, s + x.T @ known, c + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(a) for a in (n[i, j], s[i, j], s[j, i], c[i, j]))], names=["i", "j", "n", "si", "sj", "c"])

    got = rows.mapInArrow(run, "i int, j int, n double, si double, sj double, c double").groupBy("i", "j").agg(*(F.sum(a).alias(a) for a in ("n", "si", "sj", "c")))
    mean = F.array(*(F.lit(m).cast("double") for m in means))
    return got.select("i", "j", mean[F.col("i")].alias("mean_i"), mean[F.col("j")].alias("mean_j"), F.when(F.col("n") > 0, F.col("c") / F.col("n") - F.col("si") / F.col("n") * (F.col("sj") / F.col("n"))).alias("cov"))


def fit(df: DataFrame, key: str, columns: list[str], seed: int = 0, q: int = 200, components: int = 1) -> Generator:
    """Fits the marginals and the scores' covariance, or a mixture of ``components``
    Gaussians, to all rows, whatever is missing of them. Rare categories keep intervals of their own."""
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    numeric = [c for c in columns if types[c] in (*INTEGERS, "float", "double", *TIMES)]
    numbers = df.select(*(_number(c, types[c]).alias(c) for c in numeric))
    quantiles = Quantiles.collect(fit_quantiles(numbers, numeric, q)) if numeric else {}
    tokens = {}
    for c in (c for c in columns if c not in numeric):
        token = normalise_category(F.col(f"`{c}`"), df.schema[c].dataType)
        rows = df.where(F.col(f"`{c}`").isNotNull()).groupBy(token.alias("t")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(CATEGORIES + 1).collect()
        if len(rows) > CATEGORIES:
            raise ValueError(f"{c} has more than {CATEGORIES} categories")
        total, run, upto = sum(r.n for r in rows) or 1, 0, []
        for r in rows:
            run += r.n
            upto.append(run / total)
        tokens[c] = (tuple(r.t for r in rows) or (NULL_TOKEN,), tuple(upto) or (1.0,))
    d = len(columns)
    model = Generator(tuple(columns), types, quantiles, tokens, np.ones(1), np.zeros((1, d)), np.eye(d)[None])
    scored = written(with_scores(df, model, key, seed).select("z"), "scores")
    mean, cov = np.zeros(d), np.eye(d)
    for r in latent_moments(scored, "z", d).collect():
        mean[r.i], mean[r.j] = r.mean_i or 0.0, r.mean_j or 0.0
        cov[r.i, r.j] = cov[r.j, r.i] = r["cov"] or 0.0
    weights, means, covs = np.ones(1), mean[None], cov[None]
    if components > 1:
        weights, means, covs, _ = fit_mixture(scored, "z", d, components, seed)
    return replace(model, weights=weights, means=means, covs=covs + RIDGE * np.eye(d))


def _expect(weights: np.ndarray, means: np.ndarray, covs: np.ndarray):
    """Sums of a task over its rows for one step of expectation and maximisation with
    missing values: of each component, the shares of rows, and the first and second moments
    of what is known and what is expected of the rest, solved once a pattern of gaps."""
    k, d = means.shape

    def run(batches):
        total, share, first, second = 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for b in batches:
            z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            gaps = np.isnan(z)
            for pattern in np.unique(gaps, axis=0) if len(z) else ():
                x, u, o = z[(gaps == pattern).all(1)], np.flatnonzero(pattern), np.flatnonzero(~pattern)
                fit, filled = np.empty((k, len(x))), np.empty((k, len(x), d))
                for c in range(k):
                    lower = np.linalg.cholesky(covs[c][np.ix_(o, o)])
                    t = np.linalg.solve(lower, (x[:, o] - means[c][o]).T)
                    fit[c] = np.log(max(weights[c], 1e-300)) - (t**2).sum(0) / 2 - np.log(np.diag(lower)).sum() - len(o) / 2 * np.log(2 * np.pi)
                    filled[c][:, o] = x[:, o]
                    filled[c][:, u] = means[c][u] + (x[:, o] - means[c][o]) @ np.linalg.solve(covs[c][np.ix_(o, o)], covs[c][np.ix_(o, u)])
                top = fit.max(0)
                p = np.exp(fit - top)
                total += float((np.log(p.sum(0)) + top).sum())
                p /= p.sum(0)
                for c in range(k):
                    share[c] += p[c].sum()
                    first[c] += p[c] @ filled[c]
                    second[c] += (filled[c] * p[c][:, None]).T @ filled[c]
                    rest = covs[c][np.ix_(u, u)] - covs[c][np.ix_(u, o)] @ np.linalg.solve(covs[c][np.ix_(o, o)], covs[c][np.ix_(o, u)])
                    second[c][np.ix_(u, u)] += p[c].sum() * rest
        flat = np.concatenate([[total], share, first.ravel(), second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    return run


def fit_mixture(scored: DataFrame, col: str, d: int, k: int, seed: int, steps: int = 60, tolerance: float = 1e-5, start_rows: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Weights, means and covariances of ``k`` Gaussians of an array column with nulls, and
    the log-likelihood of each step, which never falls.

    A row counts with what it has, by its conditional expectation in each component, so
    gaps are neither dropped nor filled with means. A step is one pass: tasks send sums of
    ``k * d * d`` numbers. It starts from means far apart among ``start_rows`` rows with the
    least hashes (gaps as means), and ends when the likelihood gains less than
    ``tolerance`` of itself. Rows without any known place say nothing."""
    known = scored.where(F.exists(col, lambda x: x.isNotNull())).select(F.transform(F.col(col), lambda x: x.cast("double")).alias("z"))
    rows = np.array([[np.nan if v is None else v for v in r.z] for r in known.orderBy(F.xxhash64("z", F.lit(seed)), "z").limit(start_rows).collect()], np.float64).reshape(-1, d)
    middle = np.array([np.nanmean(x) if (~np.isnan(x)).any() else 0.0 for x in rows.T])
    rows = np.where(np.isnan(rows), middle, rows)
    chosen = [rows[((rows - rows.mean(0)) ** 2).sum(1).argmin()]] if len(rows) else [np.zeros(d)] * k
    for _ in range(len(chosen), k):
        chosen.append(rows[np.min([((rows - c) ** 2).sum(1) for c in chosen], axis=0).argmax()])
    means = np.array(chosen)
    for _ in range(10):  # whole groups of the start rows instead of single ones
        own = ((rows[:, None] - means[None]) ** 2).sum(2).argmin(1) if len(rows) else np.zeros(0, int)
        means = np.array([rows[own == c].mean(0) if (own == c).any() else means[c] for c in range(k)])
    weights, covs = np.full(k, 1 / k), np.repeat((np.cov(rows.T, bias=True).reshape(d, d) / k + 1e-2 * np.eye(d) if len(rows) > 1 else np.eye(d))[None], k, 0)
    seen: list[float] = []
    for _ in range(steps if len(rows) else 0):
        got = known.mapInArrow(_expect(weights, means, covs), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.array([r.v for r in sorted(got, key=lambda r: r.i)])
        share, first, second = flat[1 : k + 1], flat[k + 1 : k + 1 + k * d].reshape(k, d), flat[k + 1 + k * d :].reshape(k, d, d)
        if seen and flat[0] - seen[-1] < tolerance * abs(seen[-1]):
            seen.append(float(flat[0]))
            break
        seen.append(float(flat[0]))
        kept = share > 1e-9
        weights = share / share.sum()
        means[kept] = first[kept] / share[kept, None]
        for c in np.flatnonzero(kept):
            cov = second[c] / share[c] - np.outer(means[c], means[c])
            covs[c] = (cov + cov.T) / 2 + RIDGE * np.eye(d)
    return weights, means, covs, seen


def decode(df: DataFrame, model: Generator, z: str) -> DataFrame:
    """Cells from normal scores, in the types of the fitted table."""
    step = df.withColumns({f"__u_{c}": F.col(z)[i] for i, c in enumerate(model.columns)})
    step = step.withColumns({f"__p_{c}": normal_cdf(F.col(f"__u_{c}")) for c in model.columns})
    out = {}
    for c in model.columns:
        p, kind = F.col(f"__p_{c}"), model.types[c]
        if c in model.quantiles:
            x = model.quantiles[c].decode(2 * p - 1)
            if kind in TIMES:
                x = F.timestamp_seconds(F.round(x).cast("bigint"))
            out[c] = (F.round(x) if kind in INTEGERS else x).cast(kind)
        else:
            tokens, upto = model.tokens[c]
            names = np.array(tokens, object)
            out[c] = lookup([0.0, *upto[:-1]], lambda _, i, names=names: names[i], "string")(p).try_cast(kind)
    return step.withColumns({f"__new_{c}": col for c, col in out.items()}).drop(*(f"__{a}_{c}" for a in "up" for c in model.columns))


def _noise(key: str, seed: int, width: int) -> Column:
    return F.array(*(normal(key, seed, f"z{i}") for i in range(width)))


def sample(spark: SparkSession, model: Generator, n: int, seed: int) -> DataFrame:
    """n rows; the same seed gives the same rows under any partitioning."""
    none = F.array_repeat(F.lit(None).cast("double"), len(model.columns))
    out = decode(_drawn(spark.range(n).withColumn("__z", none), model, "id", seed), model, "__z")
    return out.select(*(F.col(f"__new_{c}").alias(c) for c in model.columns))


def _drawn(rows: DataFrame, model: Generator, key: str, seed: int) -> DataFrame:
    """``rows`` with the unknown places of ``__z`` drawn from keyed numbers. Only those go
    through the Arrow function; no other column leaves the JVM."""
    given = F.arrow_udf(_conditional(model), "array<double>")
    return rows.withColumn("__z", given("__z", _noise(key, seed, len(model.columns)), uniform(key, seed, "component")))


def _conditional(model: Generator):
    """Fills the unknown scores of each row given the known ones. The regressions of a
    pattern of unknown places are kept for later batches (up to ``PATTERNS``); any number
    of patterns will do. Of a
    mixture, a row's component is drawn by how well each explains what is known."""
    weights, means, covs = model.weights, model.means, model.covs
    d = means.shape[1]

    def regressions(u: np.ndarray, k: np.ndarray) -> list[tuple]:
        out = []
        for cov in covs:
            b = np.linalg.solve(cov[np.ix_(k, k)], cov[np.ix_(k, u)]).T if len(k) else np.zeros((len(u), 0))
            rest = cov[np.ix_(u, u)] - b @ cov[np.ix_(k, u)]
            out.append((b, np.linalg.cholesky((rest + rest.T) / 2 + RIDGE * np.eye(len(u))), np.linalg.cholesky(cov[np.ix_(k, k)])))
        return out

    def components(x: np.ndarray, k: np.ndarray, solved: list[tuple], draw: np.ndarray) -> np.ndarray:
        if len(weights) == 1:
            return np.zeros(len(x), np.int64)
        fit = []
        for w, mean, (_, _, lower) in zip(weights, means, solved):
            t = np.linalg.solve(lower, (x - mean[k]).T) if len(k) else np.zeros((0, len(x)))
            fit.append(np.log(max(w, 1e-300)) - (t**2).sum(0) / 2 - np.log(np.diag(lower)).sum())
        p = np.exp(np.array(fit) - np.max(fit, axis=0))
        return ((p / p.sum(0)).cumsum(0) <= draw).sum(0).clip(max=len(weights) - 1)

    known: dict[bytes, list[tuple]] = {}

    def run(z: pa.Array, e: pa.Array, draw: pa.Array) -> pa.Array:
        z, e = (c.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).copy() for c in (z, e))
        draw, unknown = draw.to_numpy(zero_copy_only=False), np.isnan(z)
        for pattern in np.unique(unknown, axis=0) if len(z) else ():
            rows, u, k = np.flatnonzero((unknown == pattern).all(1)), np.flatnonzero(pattern), np.flatnonzero(~pattern)
            if not len(u):
                continue
            if (solved := known.get(pattern.tobytes())) is None:
                if len(known) >= PATTERNS:
                    known.clear()
                solved = known[pattern.tobytes()] = regressions(u, k)
            which = components(z[np.ix_(rows, k)], k, solved, draw[rows])
            for c in np.unique(which):
                own, (b, lower, _) = rows[which == c], solved[c]
                z[np.ix_(own, u)] = means[c][u] + (z[np.ix_(own, k)] - means[c][k]) @ b.T + e[np.ix_(own, u)] @ lower.T
        return pa.array(list(z), pa.list_(pa.float64()))

    return run


def inpaint(df: DataFrame, model: Generator, key: str, seed: int) -> DataFrame:
    """Null cells of the model's columns drawn given the row's known cells; known cells
    and all other columns are copied."""
    filled = decode(_drawn(with_scores(df, model, key, seed, "__z"), model, key, seed), model, "__z")
    return filled.select(*(F.coalesce(F.col(f"`{c}`"), F.col(f"__new_{c}")).alias(c) if c in model.columns else F.col(f"`{c}`") for c in df.columns))


def counterfactual(df: DataFrame, model: Generator, key: str, values: dict, seed: int, hold: tuple[str, ...] = ()) -> DataFrame:
    """One row a row: interventions (and ``hold``) fixed, the model's other columns drawn
    given them."""
    done = intervene(df, values)
    free = [c for c in model.columns if c not in values and c not in hold]
    return inpaint(done.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in free}), model, key, seed)


def augment(df: DataFrame, model: Generator, n: int, seed: int) -> DataFrame:
    """The rows and n more, in the table's columns."""
    return union_relaxed(df.select(*model.columns), sample(df.sparkSession, model, n, seed).select(*model.columns))


def balance(df: DataFrame, model: Generator, label: str, targets: dict[str, int], seed: int, strict: bool = False) -> DataFrame:
    """Rows are added until each requested class has its target; none is removed. A label
    the model has never met cannot be drawn: ``strict`` raises, else it stays short."""
    need = class_deficit(df, label, targets).where("deficit > 0").collect()
    met = set(model.tokens.get(label, ((), ()))[0])
    short = [r.label for r in need if label in model.tokens and r.label not in met]
    if short and strict:
        raise ValueError(f"cannot reach the target of {', '.join(short)}")
    out, kind = df.select(*model.columns), df.schema[label].dataType
    for i, r in enumerate(r for r in need if r.label not in short):
        rows = df.sparkSession.range(r.deficit).select(F.concat(F.lit(f"{i}-"), F.col("id").cast("string")).alias("__key"), *(F.lit(r.label).cast(kind).alias(c) if c == label else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in model.columns))
        out = union_relaxed(out, inpaint(rows, model, "__key", seed).select(*model.columns))
    return out
