"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from tallyframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or v != v:
            return None
        return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool" else repr(round(float(v), 9) + 0.0)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, row)) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_no_cartesian_product(spark):
    for name in ("candidates_union", "rule_resolution", "invoice_candidates", "subset_sum_pairs"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
