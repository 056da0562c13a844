"""Boosts of one query with every document as a candidate: no text is dealt by query."""

import re

import pytest

from tessera.operators import rerank
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["definition_boost", "embedded_boost", "stem_boost"])
def test_no_row_of_text_is_exchanged(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"\bExchange (?:hash|range|Single)\w*", plan)
    assert "Window" not in plan and len(dealt) <= 1  # that of the best scores


def test_each_query_has_its_own_best_score(spark):
    rows = [(1, 7, 0.5), (1, 8, 2.0), (2, 7, 0.0), (2, 8, -1.0), (None, 7, 4.0), (None, 9, 1.0)]
    cands = spark.createDataFrame([(q, "Thing", k, "a/b.py", "class Thing:", s) for q, k, s in rows], "query_id long, query string, doc_id long, path string, text string, score double")
    got = {(r.query_id, r.doc_id): r.score for r in rerank.query_boosts(cands, catalogue.S).collect()}
    unit = catalogue.S.definition_boost
    assert got == {(1, 7): 0.5 + 2 * unit, (1, 8): 2 + 2 * unit, (2, 7): 0.0, (2, 8): -1.0, (None, 7): 4 + 4 * unit, (None, 9): 1 + 4 * unit}
