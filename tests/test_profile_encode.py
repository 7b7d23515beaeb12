"""Profiling and encoding on small tables with known answers."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.scalars import normal_cdf, normal_quantile, with_row_key
from tabloom.operators import encode as E
from tabloom.operators import profile as P
from tabloom.operators.sets import supertype, union_relaxed
from tabloom.sources import files


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "people.csv"
    lines = ["record_id,age,sex,municipality,target"] + [f"id-{i},{i},{'MF'[i % 2]},{'small-town' if i == 3 else 'capital'},{i % 2}" for i in range(20)]
    path.write_text("\n".join(lines))
    return files.scan(spark, str(path))


def test_profile_of_people(people):
    got = {r.column_name: r for r in P.profile(people, "target").collect()}
    assert got["record_id"].encoding_strategy == "DROP" and not got["record_id"].retained
    assert got["municipality"].rare_category_count == 1 and got["municipality"].rare_categories_preserved
    assert got["age"].inferred_topology == "NUMERICAL_CONTINUOUS"
    assert {got[c].inferred_topology for c in ("sex", "municipality", "target")} == {"BOOLEAN"}
    assert got["target"].is_target
    numeric, categorical = P.active_columns(list(got.values()))
    assert numeric == ["age"] and set(categorical) == {"sex", "municipality", "target"}


def test_encode_people(spark, people, tmp_path):
    q, vocab = E.fit_quantiles(people, ["age"]), E.fit_vocabulary(people, ["sex", "municipality"])
    files.write_encoder(q, vocab, P.profile(people), str(tmp_path / "enc"))
    q2, vocab2, _ = files.read_encoder(spark, str(tmp_path / "enc"))
    coded = [E.encode_table(people, E.Quantiles.collect(a), b, ["age"], ["sex", "municipality"]) for a, b in ((q, vocab), (q2, vocab2))]
    rows = [sorted(map(tuple, c.select("record_id", "x_num", "x_cat").collect())) for c in coded]
    assert rows[0] == rows[1] and all(math.isfinite(x) for r in rows[0] for x in r[1])
    assert next(r for r in rows[0] if r[0] == "id-3")[2][1] > 1
    new = people.limit(1).withColumn("municipality", F.lit("never-seen-town"))
    assert E.encode_category(new, vocab, "municipality", "i").first().i == 0
    none = people.limit(1).withColumn("municipality", F.lit(None).cast("string"))
    assert E.encode_category(none, vocab, "municipality", "i").first().i == 1
    types = {"age": "bigint", "sex": "string", "municipality": "string"}
    back = E.decode_table(coded[0].drop("age", "sex", "municipality"), E.Quantiles.collect(q), vocab, ["age"], ["sex", "municipality"], types)
    assert sorted((r.record_id, r.age, r.sex, r.municipality) for r in back.collect()) == sorted((r.record_id, r.age, r.sex, r.municipality) for r in people.collect())


def test_topology_rules(spark):
    n = 1200
    rows = [(i, float(i) + 0.5, i % 7, i % 2 == 0, f"t{i % 60}", ("long words " * 12) + str(i % 300), None if i else "x", datetime.date(2020, 1, 1) + datetime.timedelta(i % 90), [1.0]) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, f double, d int, b boolean, h string, t string, s string, day date, a array<double>")
    got = {r.column_name: r.inferred_topology for r in P.profile(df).collect()}
    assert got == {"k": "IDENTIFIER", "f": "IDENTIFIER", "d": "NUMERICAL_DISCRETE", "b": "BOOLEAN", "h": "CATEGORICAL_HIGH_CARDINALITY", "t": "FREE_TEXT", "s": "SPARSE", "day": "DATETIME", "a": "UNKNOWN"}
    quick = {r.column_name: r.inferred_topology for r in P.profile(df, exact=False).collect()}
    assert quick == got
    assert {r.column_name: r.inferred_topology for r in P.profile(df.limit(0)).collect()}["f"] == "SPARSE"


def test_quantiles_with_ties_nulls_and_constants(spark):
    values = [1.0, 1.0, 1.0, 2.0, 5.0, 5.0, 9.0]
    df = spark.createDataFrame([(v, 4.0, None) for v in values] + [(None, 4.0, None), (float("nan"), 4.0, None)], "x double, c double, n double")
    q = E.Quantiles.collect(E.fit_quantiles(df, ["x", "c", "n"]))
    knots = np.quantile(values, np.linspace(0, 1, 7))
    assert np.allclose(q["x"].knots, knots) and q["x"].fill == 2.0 and q["n"].knots == (0.0, 0.0)
    tests = [-3.0, 1.0, 1.5, 2.0, 4.9, 5.0, 8.0, 9.0, 11.0, None]
    got = [r.z for r in spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "i long, x double").orderBy("i").select(q["x"].encode(F.col("x")).alias("z")).collect()]
    want = [2 * np.interp(2.0 if t is None else t, knots, np.linspace(0, 1, 7), left=0, right=1) - 1 for t in tests]
    assert np.allclose(got, want, atol=1e-6)
    assert df.select(q["c"].encode(F.col("c")).alias("z")).distinct().collect()[0].z == 1.0


def test_normal_functions(spark):
    p = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_cdf(normal_quantile(F.col("p"))).alias("q")).collect()
    assert all(abs(r.p - r.q) < 2e-6 for r in got)


def test_delimited_reading(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_bytes(b"id;x;when;flag;txt\n1;1.5;2020-01-02;true;a\n2;NA;;false;\xff\n3;2;2020-01-03;true;c;extra\n4\n")
    df = files.scan(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "when": "date", "flag": "boolean", "txt": "string"}
    rows = {r.id: r for r in df.collect()}
    assert rows[2].x is None and rows[2].when is None and rows[3].txt == "c" and rows[4].flag is None and rows[2].txt == "�"
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path / "a.xlsx"))
    plain = tmp_path / "one.csv"
    plain.write_text("a\nb\n")
    assert files.detect_delimiter(spark, str(plain)) == ";"


def test_reports(spark, tmp_path):
    for i, d in enumerate(("b", "a")):
        files.write_report(spark.createDataFrame([(i,)], "n long"), str(tmp_path / d / "audit_report.json"))
    found = f"{tmp_path}/*/audit_report.json"
    assert [r.domain for r in files.report_domains(spark, found).collect()] == ["a", "b"]
    assert files.latest_report(spark, found).first().n == 1


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2.5)], "s string, n double")
    got = union_relaxed(a, b)
    assert dict(got.dtypes) == {"n": "double", "s": "string"} and got.count() == 2
    with pytest.raises(ValueError):
        union_relaxed(a, b.drop("s"))
    from pyspark.sql import types as T

    assert supertype(T.DateType(), T.TimestampNTZType()) == "timestamp_ntz" and supertype(T.IntegerType(), T.StringType()) == "string"


def test_row_key_and_interventions(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert with_row_key(df).select("row_key").distinct().count() == 3
    with pytest.raises(ValueError):
        E.intervene(df, {"zz": 1})
    assert E.embedding_width(5) == 3 and E.embedding_width(1) == 2 and E.embedding_width(10**6, "power") == 50


def test_frozen_transforms_run_on_a_stream(spark, people, tmp_path):
    from tabloom.streaming.frozen import encode_stream

    src = str(tmp_path / "in")
    people.write.parquet(src)
    q, vocab = E.Quantiles.collect(E.fit_quantiles(people, ["age"])), E.fit_vocabulary(people, ["sex"])
    stream = encode_stream(spark.readStream.schema(people.schema).parquet(src), q, vocab, ["age"], ["sex"])
    run = stream.writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    want = E.encode_table(people, q, vocab, ["age"], ["sex"])
    key = lambda d: sorted((r.record_id, tuple(r.x_num), tuple(r.x_cat)) for r in d.collect())
    assert key(spark.table("encoded")) == key(want)


def test_batches_are_folders(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "k")
    files.write_batches(files.training_batches(df, "k", 4, 0, 1), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(r.k for r in back.where("batch_id = 1").collect()) == [4, 5, 6, 7]
    assert back.where("batch_id = 2").count() == 2


def test_registered_vector_queries_take_all_components(spark, sf):
    from tabloom.plans.registry import QUERIES

    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], dtype=np.float64)
    rows = QUERIES["noising_pairs_whole"](spark, sf).collect()
    assert len(rows) == len(x) and {len(r.noised) for r in rows} == {x.shape[1]}
    rows, cov = QUERIES["latent_moments_whole"](spark, sf).collect(), np.cov(x.T, bias=True)
    assert sorted((r.i, r.j) for r in rows) == [(i, j) for i in range(x.shape[1]) for j in range(i + 1)]
    for r in rows:
        assert abs(r.cov - cov[r.i, r.j]) < 2e-6 and abs(r.mean_i - x[:, r.i].mean()) < 2e-6 and abs(r.mean_j - x[:, r.j].mean()) < 2e-6


def test_types_fit_all_rows(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a,b\n" + "1,1\n" * 10_050 + "x,2.5\n")
    df = files.read_delimited(spark, str(tmp_path / "late.csv"), ",")
    assert dict(df.dtypes) == {"a": "string", "b": "double"} and df.where("a IS NULL OR b IS NULL").count() == 0
    early = files.read_delimited(spark, str(tmp_path / "late.csv"), ",", infer_rows=10_000)
    assert dict(early.dtypes) == {"a": "bigint", "b": "bigint"}


def test_one_hot_of_any_width(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,), ("new",)], "x string")
    vocab = E.fit_vocabulary(spark.createDataFrame([("a",), ("b",), ("c",)], "x string"), ["x"])
    got = {r.x: r.p for r in E.with_one_hot(df, vocab, "x", "p").collect()}
    assert got == {"a": [1.0, 0.0, 0.0], "c": [0.0, 0.0, 1.0], None: [0.0] * 3, "new": [0.0] * 3}
    assert got == {r.x: r.p for r in df.select("x", E.one_hot(vocab, "x", F.col("x")).alias("p")).collect()}


def test_sparse_places_equal_dense_ones(spark):
    from pyspark.ml.functions import vector_to_array

    from tabloom.operators import encode as E

    df = spark.range(400).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(pmod(id * id, 90) AS STRING) END AS c", "CAST(id AS DOUBLE) AS x")
    vocab = E.fit_vocabulary(df.where("id < 300"), ["c"])
    got = E.with_one_hot(E.with_sparse(df, vocab, "c", "v"), vocab, "c", "dense")
    rows = got.select("v", vector_to_array("v").alias("a"), "dense").collect()
    assert all(r.a == r.dense for r in rows) and all(type(r.v).__name__ == "SparseVector" and r.v.numNonzeros() <= 1 for r in rows)
    both = E.sparse_features(df, vocab, ["x"], ["c"]).select("id", vector_to_array("features").alias("f")).collect()
    assert all(r.f[0] == r.id and sum(r.f[1:]) <= 1 for r in both)
    alone = E.with_sparse(df, vocab.where("false"), "c", "v").select(vector_to_array("v").alias("a")).collect()
    assert all(sum(r.a) == 0 for r in alone)


def test_decimals_widen(spark):
    from decimal import Decimal

    from tabloom.operators.sets import supertype, union_relaxed

    kind = lambda t: spark.createDataFrame([], f"x {t}").schema["x"].dataType
    pairs = {("decimal(10,2)", "decimal(8,5)"): "decimal(13,5)", ("decimal(10,2)", "bigint"): "decimal(21,2)", ("decimal(38,10)", "decimal(38,0)"): "decimal(38,0)", ("decimal(5,1)", "double"): "double", ("decimal(5,1)", "string"): "string", ("int", "decimal(4,4)"): "decimal(14,4)"}
    for (a, b), want in pairs.items():
        assert supertype(kind(a), kind(b)) == supertype(kind(b), kind(a)) == want
    rows = union_relaxed(spark.createDataFrame([(Decimal("12345678.25"),)], "x decimal(10,2)"), spark.createDataFrame([(Decimal("1.00001"),)], "x decimal(8,5)")).collect()
    assert [r.x for r in rows] == [Decimal("12345678.25000"), Decimal("1.00001")]


def test_row_groups_are_limited(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from tabloom.sources.files import write_table

    write_table(spark.range(2500).repartition(1), str(tmp_path / "t"), row_group_rows=1000)
    (path,) = glob.glob(f"{tmp_path}/t/*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 500]


def test_sketches_grow_with_new_files(spark, sf, tmp_path):
    import numpy as np

    from tabloom.operators import sketches as K

    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    df = df.withColumn("l_shipdate", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_shipdate")))
    parts = [df.where(F.col("l_orderkey") % 3 == i) for i in range(3)]
    for p in parts:
        found = K.grown(str(tmp_path / "state"), p)
    got, once = ({r.column_name: r for r in K.readout(s).collect()} for s in (found, K.state(df)))
    assert set(got) == set(df.columns)
    for c in df.columns:
        exact = df.agg(F.count(F.lit(1)), F.count_if(F.col(c).isNull()), F.countDistinct(c)).first()
        assert (got[c].rows, got[c].null_ratio) == (once[c].rows, once[c].null_ratio) == (exact[0], exact[1] / exact[0])
        assert abs(got[c].n_unique - exact[2]) <= 0.06 * exact[2] + 1 and abs(once[c].n_unique - exact[2]) <= 0.06 * exact[2] + 1
    for c in ("l_orderkey", "l_extendedprice"):
        x = np.sort([float(r[0]) for r in df.select(c).collect()])
        assert got[c].low == x[0] and got[c].high == x[-1]
        for share, at in zip(K.SHARES, got[c].quantiles):
            assert np.searchsorted(x, at, "left") / len(x) - 0.02 <= share <= np.searchsorted(x, at, "right") / len(x) + 0.02
    assert got["l_returnflag"].quantiles is None
    empty = K.readout(K.merged(K.state(df.where("false")), K.state(df))).collect()
    assert {r.column_name: r.rows for r in empty} == {c: df.count() for c in df.columns}
