"""Privacy and utility audits of a synthetic table."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .boosting import ROUNDS, fit_models, score_models
from .metrics import average_precision, distance_summary, f1, mle_ratio, percentiles, roc_auc
from .neighbors import knn_and_own, knn_features
from .profile import active_columns, profile
from .sampling import bootstrap_jitter, bootstrap_jitter_each, kfold, sample_n, split_each, split_random, split_stratified

PART_ROWS = 20_000
FOREST_ROWS, BINS = 200_000, 32
FEATURES = ["d_min", "d_mean", "d_std", "d_ratio"]
Provider = Callable[[DataFrame, int, int], DataFrame]


#: Acceptance limits and defaults of the attack.
@dataclass(frozen=True)
class Thresholds:
    memorization_ratio: float = 0.01
    mia_roc_auc: float = 0.55
    dcr_percentile: float = 1.0


@dataclass(frozen=True)
class ShadowConfig:
    """The shadow attack; ``ci_lite`` caps it."""

    mode: str = "release"
    n_shadow_models: int = 4
    train_fraction: float = 0.5
    multiplier: float = 1.0
    n_neighbors: int = 5
    max_rows: int | None = None
    trees: int = 200
    depth: int = 8
    min_leaf: int = 3
    seed: int = 42

    def effective(self) -> ShadowConfig:
        if self.mode != "ci_lite":
            return self
        return replace(
            self, n_shadow_models=min(self.n_shadow_models, 2), multiplier=min(self.multiplier, 0.5), n_neighbors=min(self.n_neighbors, 3), max_rows=min(self.max_rows or 512, 512),
            trees=min(self.trees, 50), depth=min(self.depth, 6), min_leaf=max(self.min_leaf, 2),
        )


def distances(real: DataFrame, synthetic: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distance of each synthetic row to its nearest real row, and of each real row to its
    nearest other real row."""
    first = lambda d: d.select(key, F.get("near", 0).alias("dist"))
    near, own = knn_and_own(synthetic, real, key, numeric, categorical)
    return first(near), first(own)


def dcr_audit(real: DataFrame, synthetic: DataFrame, key: str, numeric: list[str] | None = None, categorical: list[str] | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row: the alert distance, median, 5th percentile, share below, verdict. Exact
    copies cannot be seen under a threshold of 0, which is flagged. Columns not given are
    those that the real table's profile retains."""
    numeric, categorical = _columns(real, synthetic, key, None, numeric, categorical)
    near, own = distances(real, synthetic, key, numeric, categorical)
    alert = percentiles(own, {"dist": F.col("dist")}, [limits.dcr_percentile / 100])["dist"][0] or 0.0
    got = distance_summary(near, "dist", alert)
    return got.select(
        F.lit(alert).alias("dcr_threshold"), F.col("median").alias("dcr_median"), F.col("p5").alias("dcr_p5"), F.col("share_below").alias("memorized_share"),
        (F.col("share_below") < limits.memorization_ratio).alias("dcr_approved"), F.lit(alert == 0).alias("threshold_is_zero"),
    )


def jitter_provider(key: str, numeric: list[str]) -> Provider:
    """The default synthetic-data provider: bootstrap rows with a little noise."""

    def provide(members: DataFrame, n: int, seed: int) -> DataFrame:
        return bootstrap_jitter(members, key, numeric, n, seed).drop(key).withColumnRenamed("draw", key)

    return provide


def bounded(df: DataFrame, key: str, rows: int | None, seed: int) -> DataFrame:
    return df if rows is None else sample_n(df, key, rows, seed, "bound")


def audit_columns(profile_rows: list, real: DataFrame, synthetic: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns that an audit compares, from a collected profile (a
    row a column): retained, encoded, not the target, and in both tables."""
    both = set(real.columns) & set(synthetic.columns)
    return active_columns([r for r in profile_rows if not r.is_target and r.column_name in both])


def _columns(real: DataFrame, synthetic: DataFrame, key: str, label: str | None, numeric: list[str] | None, categorical: list[str] | None) -> tuple[list[str], list[str]]:
    """The columns given, or else those that the profile of the real table retains."""
    if numeric is None and categorical is None:
        numeric, categorical = audit_columns(profile(real, label).collect(), real, synthetic)
    return tuple([c for c in cols or () if c not in (key, label)] for cols in (numeric, categorical))


def shadow_set(real: DataFrame, key: str, numeric: list[str], categorical: list[str], config: ShadowConfig, provider: Provider | None = None, folds: bool | None = None) -> DataFrame:
    """Features of members (1) and others (0) of every shadow, keyed by ``shadow_id``.

    Each shadow splits the table anew, or takes a fold of a shuffled split as its others
    (``folds``; by default in ``ci_lite``), gets a synthetic table made from its members,
    and measures both parts against it. All shadows and both labels go through each step
    together, keyed by shadow; only a ``provider`` is called once for each."""
    c = config.effective()
    folds = c.mode == "ci_lite" if folds is None else folds
    shadows = F.explode(F.sequence(F.lit(0), F.lit(c.n_shadow_models - 1))).alias("shadow_id")
    rows = written(bounded(real, key, c.max_rows, c.seed), "shadow-rows")
    if folds:
        parts = kfold(rows, key, c.n_shadow_models + 1, c.seed).select("*", shadows).withColumn("in_train", F.col("fold") != F.col("shadow_id") + 1).drop("fold")
    else:
        parts = split_each(rows.select("*", shadows), "shadow_id", key, c.train_fraction, c.seed)
    parts = written(parts, "shadow-split")
    members = parts.where("in_train").drop("in_train")
    if provider is None:
        made = bootstrap_jitter_each(members, "shadow_id", key, numeric, c.multiplier, c.seed).drop(key).withColumnRenamed("draw", key)
    else:
        made = None
        for s in range(c.n_shadow_models):  # a provider may train a model of its own each time
            own = members.where(F.col("shadow_id") == s).drop("shadow_id")
            got = provider(own, max(1, int(own.count() * c.multiplier)), c.seed + s).withColumn("shadow_id", F.lit(s))
            made = got if made is None else made.unionByName(got)
    pair = F.col("shadow_id") * 2
    left = parts.withColumn("label", F.col("in_train").cast("int")).withColumn("pair", pair + F.col("label")).drop("in_train")
    made = written(made, "shadow-made").withColumn("pair", F.explode(F.array(pair, pair + 1)))
    got = knn_features(left, made, key, numeric, categorical, c.n_neighbors, by="pair")
    return got.withColumns({"label": (F.col("pair") % 2).cast("int"), "shadow_id": F.floor(F.col("pair") / 2).cast("int")}).drop("pair")


def fit_attack(features: DataFrame, config: ShadowConfig, most: int = FOREST_ROWS) -> PipelineModel:
    """The attack's forest, learned from all rows. A forest cuts each number at 32 places at
    most; beyond ``most`` rows these are looked for first, and rows that no cut tells apart
    become rows with a weight, of ``n / most`` rows each, so that what the forest holds does
    not grow with the table."""
    c = config.effective()
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=c.trees, maxDepth=c.depth, minInstancesPerNode=c.min_leaf, seed=c.seed)
    n = features.count()
    if n <= most:
        return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="v"), forest]).fit(_in_large_parts(features))
    bins = [f"{f}_bin" for f in FEATURES]
    binned = PipelineModel([QuantileDiscretizer(inputCols=FEATURES, outputCols=bins, numBuckets=BINS).fit(features), VectorAssembler(inputCols=bins, outputCol="v")])
    cells = binned.stages[0].transform(features).groupBy(*bins, "label").agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(F.col("n") * F.lit(most) / n)
    cells = cells.withColumn("weight", F.col("n") / share).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), share))).drop("copy", "n")
    # a leaf's least number of rows is counted by weight
    forest = forest.setWeightCol("weight").setMinInstancesPerNode(1).setMinWeightFractionPerNode(c.min_leaf / n)
    return PipelineModel([*binned.stages, forest.fit(binned.stages[1].transform(_in_large_parts(written(cells, "cells"))))])


def mia_scores(real: DataFrame, synthetic: DataFrame, key: str, numeric: list[str], categorical: list[str], config: ShadowConfig, holdout: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """``(key, label, score)``: how much each member (real) or other (holdout) row looks
    like a member of the released table. Without a holdout half of the real rows stand in
    for one, which proves nothing."""
    c = config.effective()
    model = fit_attack(written(shadow_set(real, key, numeric, categorical, config, provider), "shadow-features"), config)
    if holdout is None:
        parts = split_random(bounded(real, key, c.max_rows, c.seed), key, 0.5, c.seed, "evidence")
        members, others = parts.where("in_train").drop("in_train"), parts.where("NOT in_train").drop("in_train")
    else:
        members, others = real, holdout  # a bound on rows is one on what the attack learns from
    cols = [key, *numeric, *categorical]
    both = members.select(*cols).withColumn("label", F.lit(1)).unionByName(others.select(*cols).withColumn("label", F.lit(0)))
    made = synthetic.select(*numeric, *categorical, F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    # few bytes and many trees: parts by cores, not by size
    features = knn_features(both, made, key, numeric, categorical, c.n_neighbors, by="label")
    scored = model.transform(features.repartition(4 * real.sparkSession.sparkContext.defaultParallelism))
    return scored.select(key, "label", vector_to_array("probability")[1].alias("score"))


def mia_audit(real: DataFrame, synthetic: DataFrame, key: str, numeric: list[str] | None = None, categorical: list[str] | None = None, config: ShadowConfig = ShadowConfig(), holdout: DataFrame | None = None, limits: Thresholds = Thresholds(), provider: Provider | None = None) -> DataFrame:
    """One row: area under the ROC curve and average precision of the attack, and the
    verdict. Columns not given are those that the real table's profile retains."""
    numeric, categorical = _columns(real, synthetic, key, None, numeric, categorical)
    scores = written(mia_scores(real, synthetic, key, numeric, categorical, config, holdout, provider), "mia-scores")
    got = roc_auc(scores, "score", "label").join(F.broadcast(average_precision(scores, "score", "label")))
    c = config.effective()
    return got.select(
        F.col("auc").alias("mia_roc_auc"), F.col("average_precision").alias("mia_average_precision"), (F.col("auc") < limits.mia_roc_auc).alias("mia_approved"),
        F.lit(c.mode).alias("mia_mode"), F.lit(c.n_shadow_models).alias("shadow_models"), F.lit("holdout" if holdout is not None else "no_holdout").alias("mia_evidence"),
    )


def _in_large_parts(rows: DataFrame) -> DataFrame:
    """Every round of a fit is a few jobs over all partitions; small ones only cost time."""
    return written(rows.repartition(max(1, math.ceil(rows.count() / PART_ROWS))), "training")


def utility_scores(real: DataFrame, synthetic: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], seed: int = 42, rounds: int = ROUNDS, train_rows: int | None = None) -> DataFrame:
    """``(source, label, score)``: the same real test rows scored by a model trained on
    real and one trained on synthetic rows. Each is leaf-wise boosted trees, fitted on all
    rows unless a caller gives ``train_rows``; all test rows are scored. Null numbers are 0."""
    keep = lambda d: d.select(key, F.col(label).cast("double").alias(label), *(F.col(c).cast("double").alias(c) for c in numeric), *(F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")).alias(c) for c in categorical)).fillna(0.0, numeric)
    parts = written(split_stratified(keep(real), key, label, 0.2, seed), "utility-split")
    train, test = parts.where("NOT in_test").drop("in_test"), parts.where("in_test").drop("in_test")
    both = train.withColumn("__source", F.lit("real")).unionByName(keep(synthetic).withColumn("__source", F.lit("synthetic")))
    models, tokens = fit_models(both, "__source", label, key, numeric, categorical, seed, rounds, train_rows)
    return score_models(test, models, tokens, label, numeric, categorical)


def utility_audit(real: DataFrame, synthetic: DataFrame, key: str, label: str, numeric: list[str] | None = None, categorical: list[str] | None = None, seed: int = 42, rounds: int = ROUNDS, train_rows: int | None = None) -> DataFrame:
    """One row: area under the ROC curve and F1 of both models, their ratios, the verdict.
    Columns not given are those that the real table's profile retains."""
    numeric, categorical = _columns(real, synthetic, key, label, numeric, categorical)
    scores = written(utility_scores(real, synthetic, key, label, numeric, categorical, seed, rounds, train_rows), "utility-scores")
    rows = [roc_auc(scores.where(F.col("source") == s), "score", "label").join(F.broadcast(f1(scores.where(F.col("source") == s), "score", "label"))) for s in ("real", "synthetic")]
    return mle_ratio(*rows)


def full_audit(real: DataFrame, synthetic: DataFrame, key: str, numeric: list[str] | None = None, categorical: list[str] | None = None, label: str | None = None, config: ShadowConfig = ShadowConfig(), holdout: DataFrame | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """One nested row: privacy (distances and attack), utility where the label is in both
    tables, and the verdicts. Columns not given are those that the real table's profile
    retains, less the label."""
    numeric, cats = _columns(real, synthetic, key, label, numeric, categorical)
    dcr, mia = dcr_audit(real, synthetic, key, numeric, cats, limits), mia_audit(real, synthetic, key, numeric, cats, config, holdout, limits)
    out = dcr.select(F.struct("*").alias("dcr")).join(F.broadcast(mia.select(F.struct("*").alias("mia"))))
    out = out.withColumn("privacy_approved", F.col("dcr.dcr_approved") & F.col("mia.mia_approved"))
    if label is not None and label in real.columns and label in synthetic.columns:
        use = utility_audit(real, synthetic, key, label, numeric, cats, config.seed)
        out = out.join(F.broadcast(use.select(F.struct("*").alias("utility"))))
        return out.withColumn("overall_verdict", F.when(F.col("privacy_approved") & F.col("utility.approved"), "approved").otherwise("rejected"))
    return out.withColumn("overall_verdict", F.when(F.col("privacy_approved"), "approved").otherwise("rejected"))
