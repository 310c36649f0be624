import duckdb
import pytest
from conftest import DATA

from tallyfold.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
SLOW = {
    "walkforward_selection", "walkforward_predictions", "feature_prefix_invariance", "platt_calibrated",
    "isotonic_calibrated", "gbt_oos", "gbt_shallow_oos", "forest_oos", "logistic_balanced_oos"
}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def cells(rows, columns):
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{v:.5f}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got, rows = df.collect(), [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert len(got) == len(rows)
    a, b = cells([r.asDict() for r in got], columns), cells(rows, columns)
    if a != b:  # a digit at the edge of rounding
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                assert u == v or abs(float(u) - float(v)) <= 2e-5 * max(1.0, abs(float(u)))


def test_every_sql_has_a_query_and_the_flagship_is_there():
    assert set(ORACLE_SQL) <= set(QUERIES) and FLAGSHIP in QUERIES and len(QUERIES) > 100
