"""The texts of candidates come from the scan of the documents: what no query found is not dealt out."""

import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["saturation_topk", "hybrid_search"])
def test_texts_meet_their_candidates_in_the_scan(spark, name, monkeypatch):
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are large
    try:
        found = catalogue.QUERIES[name](spark, SF)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "(doc_id" in plan and "rightHint=(strategy=broadcast)" in plan
        want = sorted(map(tuple, found.collect()))
        monkeypatch.setattr(catalogue, "BROADCAST_CANDIDATES", 0)
        joined = catalogue.QUERIES[name](spark, SF)
        assert sorted(map(tuple, joined.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
