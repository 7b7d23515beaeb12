"""The SQL of the training-data queries gives their rows."""

import math

import duckdb
import pytest

from tabloom.llm.queries import ORACLE_SQL, QUERIES


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    rows = [dict(zip((d[0] for d in want.description), r)) for r in want.fetchall()]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    key = lambda rows: sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)
    assert key([r.asDict() for r in df.collect()]) == key(rows)
