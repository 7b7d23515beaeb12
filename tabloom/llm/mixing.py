"""Mixing sources by temperature, in DataFrame expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

BLOCKS = 4096
BROADCAST_SOURCES = 100_000
STEPS, ROUNDS = 32, 5


@dataclass(frozen=True)
class Mixture:
    """The exponent, the budget it was found for, and the plan of each source."""

    alpha: float
    budget: float
    plan: DataFrame


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def _tokens(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _row_hash(cols: tuple[str, ...], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in cols))


def measure(docs: DataFrame, text_col: str, source_col: str, id_col: str, seed: int, keep: list[Column] | None = None) -> DataFrame:
    """Written once, without texts: ``src, n_tokens, doc_key, block`` of each row."""
    key = _row_hash((id_col, source_col, text_col), seed)
    rows = docs.select(*(keep or []), _key(source_col).alias("src"), _tokens(text_col).alias("n_tokens"), key.alias("doc_key"))
    return stage_table(rows.withColumn("block", F.pmod(F.col("doc_key"), F.lit(BLOCKS)).cast("int")), "mix-rows")


def _statistics(sources: DataFrame, alphas: list[float], budget: float | None) -> list:
    """For each exponent: the entropy of its weights and the largest repetition."""
    grid = sources.select("tokens", F.explode(F.array(*(F.lit(a) for a in alphas))).alias("a"))
    grid = grid.withColumn("x", F.expr("pow(tokens, a)"))
    each = grid.groupBy("a").agg(
        F.sum("x").alias("sx"), F.sum(F.expr("CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END")).alias("sl"), F.max(F.expr("x / tokens")).alias("top"), F.min(F.expr("x / tokens")).alias("low")
    )
    # repetition of a source: its weight times the budget, divided by its tokens
    worst = F.col("top") / F.col("low") if budget is None else F.col("top") / F.col("sx") * budget
    return each.select("a", (F.log("sx") - F.col("sl") / F.col("sx")).alias("entropy"), worst.alias("repeat")).orderBy("a").collect()


def temperature(sources: DataFrame, budget: float | None, target_entropy: float | None, max_repeat: float) -> float:
    """The smallest exponent in [0, 1] that flattens no further than asked.

    Entropy falls and repetition falls with the exponent, so the bounds are bisected (in
    sections of 32, one aggregate over the sources a round) until they differ by 3e-8:
    the entropy may not exceed ``target_entropy`` (if given), no source may be repeated
    more than ``max_repeat`` times. If even exponent 1 repeats more, 1 is returned.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        alphas = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        fits = [r.a for r in _statistics(sources, alphas, budget) if r.repeat <= max_repeat * (1 + 1e-12) and (target_entropy is None or r.entropy <= target_entropy + 1e-12)]
        if not fits:
            return 1.0
        high = min(fits)
        low = max([a for a in alphas if a < high], default=high)
        if low == high:
            break
    return high


def plan_mixture(rows: DataFrame, budget_tokens: int | None, entropy_share: float | None, max_repeat: float, seed: int) -> Mixture:
    """The plan of each source: full epochs, and where its last, partial epoch ends.

    Blocks of a source are permuted by hash. The partial epoch takes whole blocks in that
    order, then documents of one boundary block in their hashed order, up to the budget.
    ``budget_tokens`` None takes the least budget that uses every document once.
    """
    blocks = stage_table(rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-blocks")
    sources = blocks.groupBy("src").agg(F.sum("tokens").cast("double").alias("tokens"))
    sources = stage_table(sources.where("tokens > 0"), "mix-sources")
    total = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    if not total.n:
        return Mixture(1.0, 0.0, _no_plan(sources))
    target = entropy_share * math.log(total.n) if entropy_share is not None and total.n > 1 else None
    alpha = temperature(sources, budget_tokens, target, max_repeat)
    x = F.expr(f"pow(tokens, {alpha!r}D)")
    sums = sources.agg(F.sum(x).alias("sx"), F.max(F.col("tokens") / x).alias("need")).first()
    budget = float(budget_tokens) if budget_tokens is not None else sums.need * sums.sx
    weight = x / F.lit(sums.sx)
    # a hair above the whole number keeps a full epoch full
    asked = F.floor(weight * F.lit(budget) * F.lit(1 + 1e-12) + F.lit(1e-6)).cast("long")
    plan = sources.select("src", weight.alias("weight"), F.col("tokens").cast("long").alias("tokens"), asked.alias("asked"))
    plan = plan.withColumn("epochs", F.expr("asked div tokens")).withColumn("rest", F.expr("asked % tokens"))
    order = F.xxhash64(F.lit(seed), F.lit("block"), F.col("src"), F.col("block"))
    run = Window.partitionBy("src").orderBy("block_key", "block")
    done = blocks.join(plan.select("src", "rest"), "src").withColumn("block_key", order)
    done = done.withColumn("upto", F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    edge = done.where("upto > rest").groupBy("src").agg(F.min(F.struct("block_key", "block", (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("left"))).alias("e"))
    plan = stage_table(plan.join(edge.select("src", "e.*"), "src", "left"), "mix-plan")
    near = plan.select("src", F.col("block").alias("b"), "left")
    inside = rows.join(_small(near, total.n), "src").where("block = b")
    cut = inside.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("src").orderBy("doc_key"))).where("upto <= left")
    cut = cut.groupBy("src").agg(F.max("doc_key").alias("doc_cut"))
    return Mixture(alpha, budget, stage_table(plan.join(cut, "src", "left"), "mix-plan"))


def _no_plan(sources: DataFrame) -> DataFrame:
    return sources.selectExpr("src", "1.0D AS weight", "0L AS tokens", "0L AS asked", "1L AS epochs", "0L AS rest", "0L AS block_key", "0 AS block", "0L AS left", "0L AS doc_cut")


def _small(table: DataFrame, n: int) -> DataFrame:
    """Broadcast a table of sources of proven size; beyond that the join shuffles and
    adaptive execution splits its hot keys."""
    return F.broadcast(table) if n <= BROADCAST_SOURCES else table


def realise(rows: DataFrame, mixture: Mixture, seed: int) -> DataFrame:
    """Each row as often as the plan wants it, with ``epoch, block, block_order,
    doc_order``: sorting by ``epoch, block_order, doc_order`` gives the permutation.

    Rows of sources without a token (empty texts only) appear once.
    """
    plan = mixture.plan.select("src", "weight", "epochs", F.col("block_key").alias("__key"), F.col("block").alias("__block"), "doc_cut")
    n = mixture.plan.count()
    key = F.xxhash64(F.lit(seed), F.lit("block"), F.col("src"), F.col("block"))
    got = rows.join(_small(plan, n), "src", "left").withColumn("block_key", key)
    before = (F.col("block_key") < F.col("__key")) | ((F.col("block_key") == F.col("__key")) & (F.col("block") < F.col("__block")))
    inside = (F.col("block") == F.col("__block")) & (F.col("doc_key") <= F.col("doc_cut"))
    times = F.coalesce(F.col("epochs"), F.lit(1)) + F.when(F.coalesce(before | inside, F.lit(False)), 1).otherwise(0)
    got = got.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    got = got.withColumn("block_order", F.when(F.col("epoch") == F.coalesce("epochs", F.lit(1)), F.col("block_key")).otherwise(F.xxhash64(F.lit(seed), "epoch", "src", "block")))
    got = got.withColumn("doc_order", F.when(F.col("epoch") == F.coalesce("epochs", F.lit(1)), F.col("doc_key")).otherwise(F.xxhash64("epoch", "doc_key")))
    return got.drop("__key", "__block", "doc_cut", "block_key", "epochs")


def mix(docs: DataFrame, budget_tokens: int | None = None, entropy_share: float | None = 0.98, max_repeat: float = 4.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Temperature mixing: ``doc_id, source, n_tokens, weight, epoch, block, block_order,
    doc_order``, one row per document and epoch.

    Weights are the token shares of the sources raised to an exponent and normalised. The
    exponent is bisected: weights get as even as ``entropy_share`` of the greatest
    entropy, but no source is repeated more than ``max_repeat`` times. ``budget_tokens``
    None takes the corpus size. Tokens are words. A null source is a source; null and
    empty texts have no tokens; repeated rows are counted each; an empty table gives an
    empty result. Only the partial last epoch of a source leaves documents out, as asked.
    """
    rows = measure(docs, text_col, source_col, id_col, seed, [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")])
    if budget_tokens is None:
        budget_tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first().t
    mixture = plan_mixture(rows, budget_tokens, entropy_share, max_repeat, seed)
    out = realise(rows, mixture, seed).withColumn("alpha", F.lit(mixture.alpha))
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_order", "doc_order", "alpha")


def mix_whole(docs: DataFrame, max_repeat: float = 1.25, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """``docs``, every row at least once, flattened as far as ``max_repeat`` lets it."""
    rows = measure(docs, text_col, source_col, id_col, seed)
    mixture = plan_mixture(rows, None, None, max_repeat, seed)
    key = _row_hash((id_col, source_col, text_col), seed)
    full = docs.select(F.struct(*docs.columns).alias("__doc"), _key(source_col).alias("src"), key.alias("doc_key"))
    full = full.withColumn("block", F.pmod(F.col("doc_key"), F.lit(BLOCKS)).cast("int"))
    return realise(full, mixture, seed).select("__doc.*")
