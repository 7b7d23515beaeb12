"""Every registered query with SQL gives DuckDB's rows; the others keep their promises."""

import math

import duckdb
import pytest

from tabloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, float) or hasattr(v, "quantize"):
        return "nan" if math.isnan(v) else repr(round(float(v), 9) + 0.0)
    return str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), columns)


def test_ingest_keeps_the_same_columns_of_a_larger_table(spark, sf, duck, tmp_path):
    """Prices are nearly all different in a small table only; in three copies they repeat."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    more = orders.selectExpr("o_orderkey + 1000000 AS o_orderkey", *orders.columns[1:]), orders.selectExpr("o_orderkey + 2000000 AS o_orderkey", *orders.columns[1:])
    orders.unionByName(more[0]).unionByName(more[1]).write.parquet(f"{tmp_path}/orders.parquet")
    want = duck.execute(ORACLE_SQL["ingest_retained"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'"))
    columns = [d[0] for d in want.description]
    df = QUERIES["ingest_retained"](spark, str(tmp_path))
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_audits_report(spark, sf):
    row = QUERIES["mia_audit"](spark, sf).first()
    assert 0 <= row.mia_roc_auc <= 1 and row.mia_mode == "release" and row.shadow_models == 4 and row.mia_evidence == "no_holdout"
    row = QUERIES["utility_audit"](spark, sf).first()
    assert 0 <= row.trtr_auc <= 1 and 0 <= row.tstr_f1 <= 1
