"""Samples, neighbours, generator and audits on small tables."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators import audit as A
from tabloom.operators import boosting as B
from tabloom.operators import generate as G
from tabloom.operators import metrics as M
from tabloom.operators import neighbors as N
from tabloom.operators import sampling as S
from tabloom.sources.scratch import Workspace


@pytest.fixture(scope="module")
def pair(spark):
    real = spark.createDataFrame([(i, 20 + 10 * i, "MF"[i % 2]) for i in range(8)], "k long, age long, sex string")
    return real, real.withColumn("age", F.col("age") + 1)


def test_distances_known_by_hand(pair):
    row = A.dcr_audit(*pair, "k", ["age"], ["sex"]).first()
    assert row.dcr_median == pytest.approx(1 / math.sqrt(525)) and row.dcr_p5 == pytest.approx(1 / math.sqrt(525))
    assert row.dcr_threshold == pytest.approx(20 / math.sqrt(525)) and row.memorized_share == 1.0 and not row.dcr_approved


def test_attack_is_capped(pair):
    config = A.ShadowConfig(mode="ci_lite", n_shadow_models=4, max_rows=8, trees=10)
    row = A.mia_audit(*pair, "k", ["age"], ["sex"], config).first()
    assert row.mia_mode == "ci_lite" and row.shadow_models == 2 and 0 <= row.mia_roc_auc <= 1


def test_registered_attacks_see_all_rows(spark):
    from tabloom.plans.registry import QUERIES

    data = "/root/testdata/sf0.01"  # more rows than the capped attack takes
    customers = {r.c_custkey for r in spark.read.parquet(f"{data}/customer.parquet").select("c_custkey").collect()}
    assert len(customers) > 512
    rows = QUERIES["shadow_set_whole"](spark, data).select("c_custkey", "shadow_id").collect()
    assert sorted(rows) == sorted((c, s) for c in customers for s in range(4))
    rows = QUERIES["mia_scores"](spark, data).collect()
    assert {(r.c_custkey, r.label) for r in rows} == {(c, 1 - c % 2) for c in customers} and len(rows) == len(customers)


def test_registered_audits_are_whole(spark, sf, monkeypatch):
    from tabloom.plans.registry import QUERIES

    made, rounds = A.fit_models, []
    monkeypatch.setattr(A, "fit_models", lambda *a: rounds.append(a[7]) or made(*a))
    report = json.loads(QUERIES["full_audit"](spark, sf).first().report)
    assert report["mia"]["mia_mode"] == "release" and report["mia"]["shadow_models"] == 4 and 0 <= report["utility"]["tstr_auc"] <= 1
    QUERIES["utility_audit"](spark, sf)
    assert rounds == [200, 200]
    row = QUERIES["mia_audit_whole"](spark, sf).first()
    assert 0 <= row.mia_roc_auc <= 1 and row.mia_mode == "release" and row.shadow_models == 4


def plain_trees(x, y, rounds, leaves, min_rows):
    """The same trees without histograms: every cut of every leaf tried on its own rows."""
    import numpy as np

    from tabloom.operators.boosting import MIN_HESSIAN, RATE, edges

    score, out = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        parts, splits = {0: np.arange(len(y))}, []

        def best(own):
            found = (0.0,)
            for j in range(x.shape[1]):
                for cut in edges(x[:, j]):
                    up = x[own, j] > cut
                    a, b = own[~up], own[up]
                    if min(len(a), len(b)) >= min_rows and min(h[a].sum(), h[b].sum()) >= MIN_HESSIAN:
                        gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[own].sum() ** 2 / h[own].sum()
                        if gain > found[0] + 1e-10:
                            found = (gain, j, cut)
            return found

        gains, n = {0: best(parts[0])}, 1
        while len(parts) < leaves:
            leaf = max(gains, key=lambda k: (gains[k][0], -k))
            if not gains[leaf][0]:
                break
            _, j, cut = gains.pop(leaf)
            own = parts.pop(leaf)
            splits.append((leaf, j, round(float(cut), 9)))
            for side in (x[own, j] <= cut, x[own, j] > cut):
                parts[n] = own[side]
                gains[n] = best(parts[n])
                n += 1
        for own in parts.values():
            score[own] += RATE * g[own].sum() / h[own].sum()
        out.append(sorted(splits))
    return out, 1 / (1 + np.exp(-score))


def test_trees_agree_with_a_plain_version():
    import numpy as np

    from tabloom.operators.boosting import fit

    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=160).round(1), rng.integers(0, 4, 160), rng.exponential(size=160).round(1)]
    y = (x[:, 0] + (x[:, 1] == 2) + rng.normal(0, 0.7, 160) > 0.6).astype(float)
    got = fit(x, y, rounds=6, leaves=7, min_rows=8)
    splits, score = plain_trees(x, y, 6, 7, 8)
    mine = [sorted((n, int(f), round(float(c), 9)) for n, (f, c) in enumerate(zip(t[0], t[1])) if f >= 0) for t in got.trees]
    assert mine == splits and got(x) == pytest.approx(score)
    assert fit(x, np.ones(160), rounds=3)(x) == pytest.approx(1.0, abs=1e-4)


def test_utility_sees_what_a_table_tells(spark):
    """A copy of the table teaches as much as the table; one with shuffled labels nothing."""
    real = spark.range(3000).selectExpr("id AS k", "CAST(pmod(xxhash64(id), 1000) AS DOUBLE) AS x", "CAST(id % 5 AS STRING) AS c").selectExpr("*", "CAST((x > 500) = (c IN ('1', '2')) AS INT) AS y")
    good = A.utility_audit(real, real, "k", "y", ["x"], ["c"]).first()
    assert good.trtr_auc > 0.99 and good.tstr_auc > 0.99 and good.approved
    bad = A.utility_audit(real, real.withColumn("y", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(2))), "k", "y", ["x"], ["c"], train_rows=500).first()
    assert bad.trtr_auc > 0.9 and bad.tstr_auc < 0.7 and not bad.approved


def test_bound_is_on_what_the_attack_learns_from(spark):
    real = spark.range(40).selectExpr("id AS k", "id * 3 AS age", "CASE WHEN id % 2 = 0 THEN 'M' ELSE 'F' END AS sex")
    other = real.selectExpr("k + 100 AS k", "age + 1 AS age", "sex")
    rows = A.mia_scores(real, real, "k", ["age"], ["sex"], A.ShadowConfig(mode="ci_lite", max_rows=10, trees=5), holdout=other).collect()
    assert sorted((r.k, r.label) for r in rows) == [(k, 1) for k in range(40)] + [(k, 0) for k in range(100, 140)]


def test_small_attack_takes_folds(pair):
    got = A.shadow_set(pair[0], "k", ["age"], ["sex"], A.ShadowConfig(mode="ci_lite", trees=5)).collect()
    others = [sorted(r.k for r in got if r.shadow_id == s and r.label == 0) for s in range(2)]
    assert [len(x) for x in others] == [3, 3] and not set(others[0]) & set(others[1]) and len(got) == 16


def test_audited_columns(spark, sf):
    from tabloom.operators.profile import profile

    df = spark.read.parquet(f"{sf}/customer.parquet")
    names = lambda *x: tuple(sorted(c) for c in A.audit_columns(*x))
    rows = profile(df, "c_mktsegment").collect()
    assert names(rows, df, df) == (["c_acctbal", "c_custkey", "c_nationkey"], ["c_name"])  # not the target
    assert names(rows, df, df.drop("c_acctbal")) == (["c_custkey", "c_nationkey"], ["c_name"])
    assert names(profile(df.withColumn("doc_id", F.lit(1))).collect(), df, df) == (["c_acctbal", "c_custkey", "c_nationkey"], ["c_mktsegment", "c_name"])


def test_exact_percentiles(spark):
    import numpy as np

    x = [float(v) for v in np.random.default_rng(0).integers(0, 40, 301)]
    df = spark.createDataFrame([(v, None if v > 20 else v * 2) for v in x] + [(float("nan"), float("inf")), (None, None)], "a double, b double")
    got = M.percentiles(df.withColumn("c", F.lit(None).cast("double")), {c: F.col(c) for c in "abc"}, [0.0, 0.05, 0.5, 0.99, 1.0])
    assert got["a"] == pytest.approx(list(np.quantile(x, [0, 0.05, 0.5, 0.99, 1])))
    assert got["b"] == pytest.approx(list(np.quantile([2 * v for v in x if v <= 20], [0, 0.05, 0.5, 0.99, 1])))
    assert got["c"] == [None] * 5
    known = df.where("a < 1000")
    places = lambda n: sorted(map(tuple, M.running(known.groupBy("a").count(), [F.col("a")], {"t": "count"}, n).select("a", "t").collect()), key=str)
    assert places(10**6) == places(3)


def test_rank_within_one_large_group(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN id ELSE -1 END AS g")
    got = {r.id: r.n for r in S.rank_within(df, "g", [F.col("id")], "n", 100).collect()}
    assert all(got[i] == 1 if i % 4 == 0 else got[i] == i - i // 4 for i in range(2000))


def test_provider_callback_and_folds(pair):
    seen = []

    def provide(members, n, seed):
        seen.append((members.count(), n, seed))
        return members.limit(n)

    config = A.ShadowConfig(n_shadow_models=2, n_neighbors=2)
    got = A.shadow_set(pair[0], "k", ["age"], ["sex"], config, provide, folds=True)
    assert got.count() == 16 and [s for _, _, s in seen] == [42, 43] and {c for c, _, _ in seen} == {5}


def test_blocks_do_not_change_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    run = lambda b: {r.c_custkey: [round(x, 9) for x in r.near] for r in N.knn(df, df, "c_custkey", ["c_acctbal"], ["c_mktsegment"], 3, True, block=b).collect()}
    assert run(4096) == run(40)


def test_cells_leave_out_nothing(spark):
    """Clusters, ties, one point in half of the rows, nulls: as by comparing all pairs."""
    import numpy as np

    rng = np.random.default_rng(8)
    point = lambda i: (None if i % 17 == 0 else float(rng.normal(i % 5 * 10, 1)) if i % 2 else 3.0, float(rng.integers(0, 4)), "abc"[i % 3])
    a, b = ([(i, *point(i)) for i in range(n)] for n in (300, 500))
    schema = "k long, x double, y double, c string"
    fits = N.scaler(spark.createDataFrame(b, schema), ["x", "y"])
    z = lambda v, f: ((f[2] if v is None else v) - f[0]) / f[1]
    for k, self_too in ((1, False), (7, True)):
        left = b if self_too else a
        got = {r.k: r.near for r in N.knn(spark.createDataFrame(left, schema), spark.createDataFrame(b, schema), "k", ["x", "y"], ["c"], k, self_too, block=40, cell_rows=30).collect()}
        assert len(got) == len(left)
        for i, x, y, c in left:
            want = sorted(math.sqrt((z(x, fits["x"]) - z(u, fits["x"])) ** 2 + (z(y, fits["y"]) - z(v, fits["y"])) ** 2 + 2 * (c != d)) for j, u, v, d in b if not (self_too and i == j))[:k]
            assert got[i] == pytest.approx(want)
    alone = N.knn(spark.createDataFrame(a, schema), spark.createDataFrame([], schema), "k", ["x"], ["c"]).collect()
    assert len(alone) == 300 and all(r.near == [] for r in alone)
    assert N.knn(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", [], ["c"], 2).count() == 300


def test_cells_of_several_levels(spark, monkeypatch):
    """Trees of three leaves over samples of 40: cells are split five levels deep."""
    import numpy as np

    monkeypatch.setattr(N, "FAN", 3)
    monkeypatch.setattr(N, "SAMPLE", 40)
    depth, made = [], N.Cells.__init__
    monkeypatch.setattr(N.Cells, "__init__", lambda self, *a: made(self, *a) or depth.append(len(self.levels)))
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()) if i % 3 else 1.0, float(rng.exponential()), "ab"[i % 2]) for i in range(900)]
    schema = "k long, x double, y double, c string"
    df = spark.createDataFrame(rows, schema)
    got = {r.k: r.near for r in N.knn(df, df, "k", ["x", "y"], ["c"], 3, True, block=5, cell_rows=4).collect()}
    assert depth[0] >= 3 and len(got) == 900
    fits = N.scaler(df, ["x", "y"])
    p = np.array([[(r[1] - fits["x"][0]) / fits["x"][1], (r[2] - fits["y"][0]) / fits["y"][1]] for r in rows])
    c = np.array([r[3] for r in rows])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2) + 2 * (c[:, None] != c[None]))
    np.fill_diagonal(d, np.inf)
    for i in range(900):
        assert got[i] == pytest.approx(sorted(d[i])[:3])


def test_every_left_row_comes_back_once(spark):
    """Keys that repeat or are null belong to rows of their own; so do equal rows."""
    schema = "k long, x double, c string"
    left = spark.createDataFrame([(1, 0.0, "a"), (1, 10.0, "a"), (None, 20.0, "a"), (None, 30.0, "a"), (2, 30.0, "a"), (2, 30.0, "a")], schema)
    right = spark.createDataFrame([(1, 1.0, "a"), (2, 12.0, "a"), (3, 33.0, "a")], schema)
    sd = N.scaler(right, ["x"])["x"][1]
    want = [(1, 1), (1, 2), (None, 3), (None, 8), (2, 3), (2, 3)]
    got = [(r.k, round(r.near[0] * sd, 6)) for r in N.knn(left, right, "k", ["x"], ["c"]).collect()]
    assert Counter(got) == Counter([(1, 1.0), (1, 2.0), (None, 8.0), (None, 3.0), (2, 3.0), (2, 3.0)]) and len(want) == len(got)
    own = N.knn(left, left, "k", ["x"], ["c"], exclude_self=True).collect()
    sd = N.scaler(left, ["x"])["x"][1]
    assert Counter((r.k, round(r.near[0] * sd, 6)) for r in own) == Counter([(1, 10.0), (1, 10.0), (None, 10.0), (None, 0.0), (2, 0.0), (2, 0.0)])
    both = N.knn(left.withColumn("g", F.lit(1)).unionByName(left.withColumn("g", F.lit(None).cast("int"))), right.withColumn("g", F.lit(None).cast("int")), "k", ["x"], ["c"], by="g").collect()
    assert sum(r.near == [] for r in both) == 6 and all(bool(r.near) == (r.g is None) for r in both) and len(both) == 12


def test_hot_points_and_equal_categories(spark):
    """A third of the rows in one point, and categories alone, are few points with copies."""
    df = spark.range(9000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS x", "CAST(id % 5 AS STRING) AS c")
    near = N.knn(df, df, "k", [], ["c"], 4, True).collect()
    assert len(near) == 9000 and all(r.near == [0.0] * 4 for r in near)
    near = N.knn(df, df, "k", ["x"], [], 2, True, cell_rows=100).collect()
    assert len(near) == 9000 and all((r.near == [0.0, 0.0]) == (r.k % 3 == 0) for r in near)


def test_random_projections_find_nearly_all(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, *(float(v) for v in rng.normal(size=3)), "abcd"[i % 4]) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, x double, y double, z double, c string")
    args = ("k", ["x", "y", "z"], ["c"], 5)
    exact, found = ({r.k: r.near for r in f(df.where("k < 500"), df.where("k >= 500"), *args).collect()} for f in (N.knn, N.knn_approximate))
    assert len(found) == 500 and all(all(x >= y - 1e-9 for x, y in zip(found[k], exact[k])) for k in found)
    assert sum(len(set(np.round(found[k], 9)) & set(np.round(exact[k], 9))) for k in exact) >= 0.9 * 2500


def test_codebooks_of_any_size(spark, monkeypatch):
    """A matrix, or cells: 100,000 codes, with ties, nulls and a slice of the vector."""
    import numpy as np

    rng = np.random.default_rng(9)
    book = rng.integers(0, 60, (100_000, 3)).astype(float)
    df = spark.createDataFrame([(i, None if i % 50 == 0 else [7.0, *map(float, rng.integers(0, 60, 3) + 0.25 * (i % 2))]) for i in range(300)], "k long, v array<double>")
    codes = spark.createDataFrame([(i, v) for i, v in enumerate(book.tolist())], "idx long, vector array<double>")
    got = {r.k: (r.code, r.code_distance) for r in N.nearest_code(df, "v", codes, 1, 3).collect()}
    small = {r.k: (r.code, r.code_distance) for r in N.nearest_code(df, "v", codes.where("idx < 3000"), 1, 3).collect()}
    for r in df.collect():
        if r.v is None:
            assert got[r.k] == small[r.k] == (None, None)
            continue
        d = np.sqrt(((book - r.v[1:]) ** 2).sum(1))
        assert got[r.k] == (int(d.argmin()), pytest.approx(d.min())) and small[r.k] == (int(d[:3000].argmin()), pytest.approx(d[:3000].min()))
    with pytest.raises(ValueError):
        N.nearest_code(df, "v", codes.where("false"))


def test_binned_density_is_within_its_bound(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("x"))
    h = df.agg(F.stddev_samp("x")).first()[0] * df.count() ** -0.2
    for per in (4, 64):
        both = M.kde(df, "x", 0.0, 1e5, 30).select("g", F.col("density").alias("a")).join(M.kde_binned(df, "x", 0.0, 1e5, 30, per), "g").collect()
        assert len(both) == 30 and max(abs(r.a - r.density) for r in both) <= 0.4 / (8 * per**2) / h
    assert [r.density for r in M.kde_binned(df.where("false"), "x", 0.0, 1.0, 3).collect()] == [0.0] * 3


def test_ranges_do_not_change_ranks(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(10**6)))
    one = S.global_rank(df, [F.col("x"), F.col("id")], "r")
    many = S.global_rank(df, [F.col("x"), F.col("id")], "r", range_rows=64)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.select(one.columns).collect()))
    g = df.withColumn("g", F.when(F.col("id") % 10 > 2, F.col("id") % 2))
    one, many = (S.rank_within(g, "g", [F.col("x"), F.col("id")], "r", n) for n in (10**6, 64))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.select(one.columns).collect()), key=str)
    assert one.where("r = 1").count() == 3
    a = M.running(df, F.col("x"), {"t": "id"}).agg(F.sum(F.col("t") * F.col("id"))).first()
    b = M.running(df, F.col("x"), {"t": "id"}, range_rows=64).agg(F.sum(F.col("t") * F.col("id"))).first()
    assert a == b


def test_splits_ignore_partitioning(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    key = lambda d: sorted((r.c_custkey, r.in_train) for r in d.collect())
    assert key(S.split_random(df, "c_custkey", 0.3, 1)) == key(S.split_random(df.repartition(9), "c_custkey", 0.3, 1))


def test_metrics_of_single_classes(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 0)], "score double, label int")
    assert M.roc_auc(df, "score", "label").first().auc == 0.5
    assert M.average_precision(df, "score", "label").first().average_precision == 0.0
    assert M.f1(df.where("score < 0.5"), "score", "label").first().f1 == 0.0


@pytest.fixture(scope="module")
def fitted(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return df, G.fit(df, "c_custkey", ["c_acctbal", "c_nationkey", "c_mktsegment"])


def test_samples_stay_inside_the_fit(spark, fitted):
    df, model = fitted
    got = G.sample(spark, model, 400, 3)
    low, high = df.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    rows = got.collect()
    assert len(rows) == 400 and all(low <= r.c_acctbal <= high for r in rows)
    assert {r.c_mktsegment for r in rows} <= {r.c_mktsegment for r in df.collect()}
    assert dict(got.dtypes) == {c: t for c, t in df.dtypes if c != "c_custkey"}
    again = G.sample(spark, model, 400, 3).repartition(5).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mixture_learns_two_clusters(spark):
    """Two clouds of opposite slope: one Gaussian has no correlation left, a mixture has."""
    import numpy as np

    rng = np.random.default_rng(3)
    t = rng.normal(size=1200)
    rows = [(i, float(t[i] - 4 if i % 2 else t[i] + 4), float((t[i] if i % 2 else -t[i]) + rng.normal(0, 0.1))) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    model = G.fit(df, "k", ["x", "y"], components=2)
    assert model.weights == pytest.approx([0.5, 0.5], abs=0.1) and model.weights.sum() == pytest.approx(1)
    got = G.sample(spark, model, 2000, 5).toPandas()
    low, high = got[got.x < 0], got[got.x > 0]
    assert low.x.corr(low.y) > 0.6 and high.x.corr(high.y) < -0.6 and 800 < len(low) < 1200
    holes = df.withColumn("y", F.when(F.col("k") >= 400, F.col("y")))
    done = G.inpaint(holes, model, "k", 2).where("k < 400").toPandas()
    low, high = done[done.x < -1], done[done.x > 1]
    assert done.y.notna().all() and low.x.corr(low.y) > 0.5 and high.x.corr(high.y) < -0.5


def test_mixture_of_incomplete_rows(spark):
    """Planted clusters with 30 % of the cells gone: the gaps cost nothing but evidence,
    where means in their place pull the clusters together."""
    import numpy as np

    rng = np.random.default_rng(7)
    at = np.array([[-4.0, 0, 3], [4, 2, -3], [0, -5, 0]])
    shape = np.array([[[1, 0.8, 0], [0.8, 1, 0], [0, 0, 0.5]], [[1, -0.8, 0], [-0.8, 1, 0], [0, 0, 0.5]], [[0.5, 0, 0.4], [0, 0.5, 0], [0.4, 0, 1]]])
    own = rng.choice(3, 3000, p=[0.5, 0.3, 0.2])
    x = np.array([rng.multivariate_normal(at[c], shape[c]) for c in own])
    gone = rng.random(x.shape) < 0.3
    rows = [([None if g else float(v) for v, g in zip(a, b)],) for a, b in zip(x, gone)]
    weights, means, covs, seen = G.fit_mixture(spark.createDataFrame(rows, "z array<double>"), "z", 3, 3, 1)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:])) and len(seen) > 3
    order = [int(((means - c) ** 2).sum(1).argmin()) for c in at]
    assert sorted(order) == [0, 1, 2] and weights[order] == pytest.approx([0.5, 0.3, 0.2], abs=0.03)
    assert np.abs(means[order] - at).max() < 0.25 and np.abs(covs[order] - shape).max() < 0.25
    filled = np.where(gone, np.nanmean(np.where(gone, np.nan, x), axis=0), x)
    assert np.abs(np.cov(filled[own == 0].T)[0, 1] - 0.8) > 0.25  # what filling with means makes of a cluster
    assert G.fit_mixture(spark.createDataFrame([([None, None],)], "z array<double>"), "z", 2, 2, 1)[3] == []


def test_fill_keeps_known_cells(fitted):
    df, model = fitted
    holes = S.inject_nulls(df, "c_acctbal", "c_custkey", 0.5, 1)
    done = {r.c_custkey: r for r in G.inpaint(holes, model, "c_custkey", 2).collect()}
    for r in holes.collect():
        assert done[r.c_custkey].c_acctbal is not None
        assert r.c_acctbal is None or r == done[r.c_custkey]


def test_fill_hands_on_other_cells_bit_for_bit(spark, fitted):
    """Large longs beside nulls, decimals, bytes, nested cells, and names used inside."""
    from decimal import Decimal

    model = fitted[1]
    kind = "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string, big long, d decimal(38,9), b binary, s struct<x:long,y:array<long>>, z long, e long, u long"
    cells = lambda i: (None, None, None, None) if i % 3 == 0 else ((1 << 53) + 2 * i + 1, Decimal("12345678901234567890123456789.123456789"), bytes(range(i)), ((1 << 53) + 1, [None, (1 << 61) + 1]))
    rows = [(i, None if i % 2 else float(i), i % 25, None if i % 5 == 0 else "BUILDING", *cells(i), i, (1 << 60) + i if i % 4 else None, -i) for i in range(40)]
    df = spark.createDataFrame(rows, kind)
    other = ["big", "d", "b", "s", "z", "e", "u"]
    for done in (G.inpaint(df, model, "c_custkey", 2), G.counterfactual(df, model, "c_custkey", {"c_mktsegment": "MACHINERY"}, 2)):
        assert done.dtypes == df.dtypes
        assert done.select("c_custkey", *other).exceptAll(df.select("c_custkey", *other)).count() == 0 and done.count() == 40
        assert done.where("c_acctbal IS NULL OR c_mktsegment IS NULL").count() == 0
    own = spark.range(300).selectExpr("id AS k", "CASE WHEN id % 3 > 0 THEN 9007199254740993 + 2 * id END AS big", "id % 7 AS w")
    filled = {r.k: r.big for r in G.inpaint(own, G.fit(own, "k", ["big", "w"]), "k", 1).collect()}
    assert all(filled[k] == 9007199254740993 + 2 * k if k % 3 else filled[k] is not None for k in range(300))


def test_counterfactual_and_augment(fitted):
    df, model = fitted
    got = G.counterfactual(df, model, "c_custkey", {"c_mktsegment": "BUILDING"}, 2, hold=("c_nationkey",)).collect()
    nation = {r.c_custkey: r.c_nationkey for r in df.collect()}
    assert len(got) == df.count() and all(r.c_mktsegment == "BUILDING" and r.c_nationkey == nation[r.c_custkey] for r in got)
    assert G.augment(df, model, 30, 1).count() == df.count() + 30


def test_balance_reaches_targets(fitted):
    df, model = fitted
    before = {r.c_mktsegment: r["count"] for r in df.groupBy("c_mktsegment").count().collect()}
    label, other = sorted(before)[:2]
    after = {r.c_mktsegment: r["count"] for r in G.balance(df, model, "c_mktsegment", {label: before[label] + 25, other: 1, "NEW": 5}, 4).groupBy("c_mktsegment").count().collect()}
    assert after == before | {label: before[label] + 25}
    with pytest.raises(ValueError):
        G.balance(df, model, "c_mktsegment", {"NEW": 5}, 4, strict=True)
    with pytest.raises(ValueError):
        G.balance(df, model, "nothing", {"NEW": 5}, 4)


def test_a_token_that_no_point_has_does_not_visit_all_cells(spark, monkeypatch):
    """Such a row is at least its token's price from everything, which reached far cells."""
    import numpy as np

    rng = np.random.default_rng(17)
    point, ask = rng.random((6000, 2)) * 3, rng.random((300, 2)) * 3
    kind, want_kind = rng.integers(4, size=6000), np.where(np.arange(300) % 3 == 0, 9, rng.integers(4, size=300))
    frame = lambda x, c: spark.createDataFrame([(i, float(p[0]), float(p[1]), f"k{t}") for i, (p, t) in enumerate(zip(x, c))], "k long, x double, y double, kind string")
    visits, compare = {}, N._compare
    monkeypatch.setattr(N, "_compare", lambda rows, *a, **b: visits.update({a[6]: rows.count()}) or compare(rows, *a, **b))
    got = {r.k: r.near for r in N.knn(frame(ask, want_kind), frame(point, kind), "k", ["x", "y"], ["kind"], 3, cell_rows=32).collect()}
    sd = point.std(0)
    for i in range(300):
        d = np.sqrt((((point - ask[i]) / sd) ** 2).sum(1) + np.where(kind == want_kind[i], 0, 1 if want_kind[i] == 9 else 2))
        assert np.allclose(got[i], np.sort(d)[:3])
    assert visits["near"] < 300 * 8


def test_projections_deal_the_smaller_side_to_several_buckets(spark, monkeypatch):
    """Rows went to 36 buckets each, however few the points were."""
    import numpy as np

    rng = np.random.default_rng(18)
    frame = lambda x: spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(x)], "k long, x double, y double")
    sent, compare = [], N._compare
    monkeypatch.setattr(N, "_compare", lambda rows, *a, **b: sent.append(rows.count()) or compare(rows, *a, **b))
    point, ask = rng.random((500, 2)), rng.random((2000, 2))
    near = {r.k: r.near for r in N.knn_approximate(frame(ask), frame(point), "k", ["x", "y"], [], bucket_rows=20).collect()}
    d = np.sqrt((((ask[:, None] - point[None]) / point.std(0)) ** 2).sum(2)).min(1)
    assert sent == [8000] and np.mean([bool(near[i]) and abs(near[i][0] - d[i]) < 1e-9 for i in range(2000)]) > 0.95


def _written_rows(monkeypatch):
    """The number of rows of each table that a join writes, by name."""
    from tabloom.sources.scratch import Workspace

    seen, table = {}, Workspace.table

    def spy(self, df, name):
        out = table(self, df, name)
        seen[name] = out.count()
        seen["rows-with-weight"] = seen[name] if "weight" in df.columns else seen.get("rows-with-weight", 0)
        return out

    monkeypatch.setattr(Workspace, "table", spy)
    return seen


def test_copies_of_left_rows_are_compared_once(spark, monkeypatch):
    rows = [(i, float(i % 50), None if i % 50 == 7 else f"c{i % 5}") for i in range(2000)]
    left = spark.createDataFrame(rows, "k long, x double, c string")
    right = spark.createDataFrame([(i, i * 1.5 + 0.1, f"c{i % 4}") for i in range(40)], "k long, x double, c string")
    once = {r.x: r.near for r in N.knn(left.where("k < 50"), right, "k", ["x"], ["c"], 3).select("k", "near").join(left, "k").collect()}
    own = {r.k: r.near for r in N.knn(left, left, "k", ["x"], ["c"], 2, exclude_self=True).collect()}
    seen = _written_rows(monkeypatch)
    got = N.knn(left, right, "k", ["x"], ["c"], 3).collect()
    assert len(got) == 2000 and all(r.near == once[float(r.k % 50)] for r in got)
    assert seen["near"] == 50
    assert set(map(tuple, own.values())) == {(0.0, 0.0)} and len(own) == 2000


def test_large_groups_with_a_slash_in_their_name(spark):
    rows = [(i, f"a/{i % 2}", float(i)) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, g string, x double")
    args = (df, df, "k", ["x"], [])
    parts = {r.k: r.near for g in ("a/0", "a/1") for r in N.knn(df.where(F.col("g") == g), df.where(F.col("g") == g), "k", ["x"], [], exclude_self=True).collect()}
    got = {r.k: r.near for r in N.knn(*args, exclude_self=True, cell_rows=16, by="g").collect()}
    assert got.keys() == parts.keys() and all(got[k] == pytest.approx(parts[k], abs=1e-12) for k in parts)


def test_rows_of_a_rare_category_meet_few_cells(spark, monkeypatch):
    """Its points lie far apart, so that a bound from other categories reaches all cells."""
    rows = [(i, i / 1000, "rare" if i % 100 == 0 else f"c{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, x double, c string")
    want = {r.k: r.near for r in N.knn(df, df, "k", ["x"], ["c"], 2, exclude_self=True).collect()}
    seen = _written_rows(monkeypatch)
    got = {r.k: r.near for r in N.knn(df, df, "k", ["x"], ["c"], 2, exclude_self=True, cell_rows=16).collect()}
    assert got.keys() == want.keys() and all(a == pytest.approx(b, abs=1e-12) for a, b in ((got[k], want[k]) for k in want))
    assert seen["near"] < 3 * 6000


def test_forest_of_many_rows_holds_a_bounded_number(spark, monkeypatch):
    u = lambda seed: F.rand(seed)
    rows = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("label"), *(u(i).alias(c) for i, c in enumerate(A.FEATURES[1:])))
    rows = rows.withColumn(A.FEATURES[0], u(9) + 0.5 * F.col("label"))
    rows = rows.withColumns({c: F.floor(F.col(c) * 3) / 3 for c in A.FEATURES[1:]}).localCheckpoint()
    config = A.ShadowConfig(trees=20, depth=4)
    seen, auc = _written_rows(monkeypatch), []
    from pyspark.ml.functions import vector_to_array

    for most in (20000, 500):
        scored = A.fit_attack(rows, config, most).transform(rows).select("label", vector_to_array("probability")[1].alias("s")).localCheckpoint()
        auc.append(M.roc_auc(scored, "s", "label").first()[0])
    assert 0 < seen["rows-with-weight"] < 500 + 32 * 27 * 2
    assert auc[0] > 0.8 and auc[1] == pytest.approx(auc[0], abs=0.02)


def test_cells_of_few_numbers_are_large_and_on_one_level(spark, monkeypatch):
    df = spark.range(17_000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 17_011).cast("double").alias("x"))
    points = spark.range(2000).selectExpr("'g/0' cell", "id", "array(double(id % 997), double(id % 7)) z", "array(bigint(id % 3)) cat", "1 m")
    cells = N.Cells(points, 2, 30, Workspace(spark, "cells"))
    assert len(cells.levels) == 1
    level = cells.levels[0].first()
    ends = {r.cell for r in cells.points.select("cell").distinct().collect()}
    assert level.cell == "g/0" and {b.leaf for b in level.boxes} == ends and cells.points.count() == 2000

    monkeypatch.setattr(N.Cells, "visits", lambda *a: pytest.fail("split in small cells"))
    got = {r.k: r.near[0] for r in N.knn(df, df, "k", ["x"], [], exclude_self=True).collect()}
    line = sorted((k * 7919 % 17_011, k) for k in range(17_000))
    sd = math.sqrt(sum(x * x for x, _ in line) / 17_000 - (sum(x for x, _ in line) / 17_000) ** 2)
    for i in range(1, 16_999, 53):
        assert got[line[i][1]] * sd == pytest.approx(min(line[i][0] - line[i - 1][0], line[i + 1][0] - line[i][0]))


def test_trees_are_grown_once_and_scored_by_all_cores(spark, pair):
    config = A.ShadowConfig(mode="ci_lite", max_rows=8, trees=3)
    scores = A.mia_scores(*pair, "k", ["age"], ["sex"], config)
    assert scores.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism

    grown, rows = spark.sparkContext.accumulator(0), spark.range(80).selectExpr("id k", "if(id % 4 = 0, 'a', 'b') model", "double(id % 2) y", "double(id) x")
    once = B.fit

    def counted(*args):
        grown.add(1)
        return once(*args)

    B.fit = counted
    try:
        models, _ = B.fit_models(rows, "model", "y", "k", ["x"], [], 1, 2)
    finally:
        B.fit = once
    assert sorted(models) == ["a", "b"] and grown.value == 2


def _cell(numbers, kinds, cost=None):
    import numpy as np
    import pyarrow as pa

    rows = {"id": pa.array(np.arange(len(numbers))), "z": pa.array(list(numbers), pa.list_(pa.float64())), "cat": pa.array(list(kinds), pa.list_(pa.int64()))}
    return pa.table(rows | ({"m": pa.array(np.ones(len(numbers)), pa.int32())} if cost is None else {"cost": pa.array(list(cost), pa.list_(pa.float64()))}))


def test_clumps_do_not_make_a_cell_slow():
    """Points in clumps far apart along the longer number: a row's bound reached over thousands of
    points that another number tells apart, 13 times the work of evenly spread points."""
    import time

    import numpy as np

    drawn, seconds = np.random.default_rng(1), {}
    for size in (60, 1):
        at = drawn.integers(0, 30_000 // size, 30_000)
        line, other = 3.5 * drawn.random(30_000 // size), drawn.integers(0, 25, 30_000 // size) / 7
        points = np.c_[line[at] + 0.003 * (size > 1) * (drawn.random(30_000) - 0.5), other[at]]
        rows = points[drawn.integers(0, 30_000, 8_000)] + np.c_[0.06 * (drawn.random(8_000) - 0.5), np.zeros(8_000)]
        right, left = _cell(points, np.zeros((30_000, 1), int)), _cell(rows, np.zeros((8_000, 1), int), np.ones((8_000, 1)))
        began = time.process_time()
        got = N._nearest(1, False)(None, left, right)["near"].to_pylist()
        seconds[size] = time.process_time() - began
        want = np.sqrt(((rows[:40, None] - points[None]) ** 2).sum(2)).min(1)
        assert [r[0]["d"] for r in got[:40]] == pytest.approx(list(want))
    assert seconds[60] < 4 * seconds[1]


def test_runs_find_the_nearest_of_any_cell():
    """Of none to three numbers and up to two categories, with ties, and numbers that are not."""
    import numpy as np

    drawn = np.random.default_rng(3)
    for trial in range(40):
        d, c, k, grid = trial % 4, trial // 4 % 3, (1, 2, 70)[trial % 3], trial % 2
        draw = lambda n: drawn.integers(0, 6, (n, d)).astype(float) if grid else drawn.normal(size=(n, d))
        both = np.unique(np.c_[draw(500), drawn.integers(0, (3, 300)[trial % 7 == 0], (500, c))], axis=0)
        points, kinds, rows, asked = both[:, :d], both[:, d:].astype(int), draw(150), drawn.integers(0, 4, (150, c))
        cost = drawn.integers(1, 3, (150, c)).astype(float)
        rows[:2] = np.nan
        got = N._nearest(k, False)(None, _cell(rows, asked, cost), _cell(points, kinds))["near"].to_pylist()
        all_pairs = np.sqrt(((rows[:, None] - points[None]) ** 2).sum(2) + ((asked[:, None] != kinds[None]) * cost[:, None]).sum(2))
        for near, want in zip(got, np.sort(all_pairs, axis=1)):
            assert sorted(p["d"] for p in near) == pytest.approx([x for x in want[:k] if np.isfinite(x)])


def test_both_joins_of_the_audit_share_the_real_side(spark, monkeypatch):
    """The real rows were read, scaled and put into cells once for each of the two joins."""
    import random

    built, init, drawn = [], N.Cells.__init__, random.Random(5)
    monkeypatch.setattr(N.Cells, "__init__", lambda self, *a: (built.append(1), init(self, *a))[1])
    row = lambda k: (k, drawn.choice([None, *map(float, range(40))]), drawn.random(), drawn.choice("abc"))
    real, made = ([row(k) for k in range(n)] for n in (400, 300))
    real += [(900 + k, *real[k][1:]) for k in range(5)]
    real, made = (spark.createDataFrame(x, "k int, x double, y double, c string") for x in (real, made + [(999, 3.5, 0.5, "new")]))
    read = lambda d: {r.k: r.near for r in d.collect()}
    near, own = (read(d) for d in N.knn_and_own(made, real, "k", ["x", "y"], ["c"], 2, cell_rows=64))
    assert len(built) == 1
    for got, want in ((near, N.knn(made, real, "k", ["x", "y"], ["c"], 2)), (own, N.knn(real, real, "k", ["x", "y"], ["c"], 2, exclude_self=True))):
        want = read(want)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    built.clear()
    assert A.dcr_audit(real, made, "k", ["x", "y"], ["c"]).first().dcr_threshold == 0 and len(built) == 1


def _same_trees(a, b):
    assert a.base == pytest.approx(b.base, abs=1e-9) and len(a.trees) == len(b.trees)
    for own, other in zip(a.trees, b.trees):
        assert all(list(x) == pytest.approx(list(y), abs=1e-9) for x, y in zip(own, other))


def test_boosted_trees_learn_from_all_rows(spark):
    """Beyond 200,000 rows a model took a sample of so many; rare rows and exact shares tell."""
    import numpy as np

    n = 230_000
    rows = spark.range(n).selectExpr("id k", "'a' model", "double(id % 40 + if(id % 10000 = 7, 1000 + id, 0)) x", "double(id % 3 = 0 or id % 40 > 30 or id % 10000 = 7) y")
    trees = B.fit_models(rows, "model", "y", "k", ["x"], [], 1, 2)[0]["a"]
    k = np.arange(n)
    x, y = k % 40 + np.where(k % 10000 == 7, 1000 + k, 0), ((k % 3 == 0) | (k % 40 > 30) | (k % 10000 == 7)).astype(float)
    assert trees.base == pytest.approx(math.log(y.mean() / (1 - y.mean())), abs=1e-12)
    _same_trees(trees, B.fit(x[:, None].astype(float), y, 2))


def test_trees_summed_by_spark_are_those_of_one_task(spark):
    """More than 255 numbers, tokens that one model never saw, a model that has nothing to split."""
    import numpy as np

    rows = spark.range(4000).selectExpr("id k", "if(id % 3 = 0, 'a', 'b') model", "pmod(xxhash64(id), 1000) / 7 x", "double(id % 9) z", "concat('t', int(pow(pmod(xxhash64(id, 2), 100) / 100, 2) * 5) + id % 3) c")
    rows = rows.selectExpr("*", "double((x > 60) = (c in ('t0', 't1', 't3')) or z * x > 900) y")
    rows = rows.unionByName(rows.where("k < 60").selectExpr("k + 10000 k", "'c' model", "x", "z", "'other' c", "1.0D y"))
    one, tokens = B.fit_models(rows, "model", "y", "k", ["x", "z"], ["c"], 1, 3)
    many, _ = B.fit_models(rows, "model", "y", "k", ["x", "z"], ["c"], 1, 3, None, 0)
    got = rows.where("model = 'a'").collect()
    names = {t: i for i, (t, _) in enumerate(sorted(Counter(r.c for r in got).items(), key=lambda x: (-x[1], x[0])))}
    _same_trees(one["a"], B.fit(np.array([(r.x, r.z, names[r.c]) for r in got], float), np.array([r.y for r in got]), 3))
    assert sorted(one) == sorted(many) == ["a", "b", "c"] and len(one["c"].trees) == 1
    for name in one:
        _same_trees(one[name], many[name])

    seen = {r.token: r.nos for r in tokens.table.collect()}
    assert {t: nos[0] for t, nos in seen.items() if t in names} == names and seen["other"][0] == len(names) == tokens.others[0][0]
    new = spark.createDataFrame([(1, 80.0, 3.0, c) for c in ("t0", "other", None, "never seen")], "y int, x double, z double, c string")
    scored = B.score_models(new, one, tokens, "y", ["x", "z"], ["c"]).where("source = 'a'").collect()
    unseen = one["a"](np.array([(80.0, 3.0, len(names))]))[0]
    assert sorted(r.score for r in scored) == pytest.approx(sorted([one["a"](np.array([(80.0, 3.0, names["t0"])]))[0], *[unseen] * 3]))
    none = B.fit_models(rows.limit(0), "model", "y", "k", ["x", "z"], ["c"], 1, 3)
    assert none == ({}, None) and B.score_models(new, *none, "y", ["x", "z"], ["c"]).count() == 0
