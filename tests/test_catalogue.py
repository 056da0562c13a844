"""Queries against their SQL on the smallest tables, as many as keep the suite short."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["classify_files", "distil_text", "hybrid_overlap", "enclosing_interval", "exact_tier_theta", "bm25_batch", "vector_batch", "path_penalty", "refresh_diff", "hybrid_search", "line_windows", "capabilities"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = want.fetchall()
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(str, ([r[c] for c in columns] for r in got.collect()))) == sorted(map(str, ([r[i] for i in place] for r in rows)))


def test_range_joins_keep_their_equality(spark):
    for name in ("enclosing_interval", "exact_tier_theta"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
