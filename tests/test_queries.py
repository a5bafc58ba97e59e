"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from lattiq.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(([None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r] for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    if name == "fit_origin_plane":
        pytest.skip("at this size the scan is one line, which has no plane")
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = normal([[r[c] for c in names] for r in df.collect()])
    cur = con.execute(catalogue.oracle_sql()[name])
    found = [d[0] for d in cur.description]
    assert sorted(found) == names
    want = normal([[r[found.index(c)] for c in names] for r in cur.fetchall()])
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).limit(1).count() == 1


def test_plans_of_relational_queries_hold_no_python(spark):
    for name in ("vi_circle", "bvm_cal", "lattice_fit", "index_peaks", "cooccurrence2", "polar_scatter"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, LeftOuter", ""), name
