"""span_overlap with every document as a target, against plain Python; what injection adds."""

from pyspark.sql import functions as F

from tessera.operators import rerank
from tessera.plans import catalogue
from tessera.sources import corpus as sources

SF = "/root/testdata/sf0.001"


def test_every_document_is_a_target(spark):
    tails = {"/".join(r.path.split("/")[-2:]) for r in sources.documents(spark, SF).select("path").collect()}
    defs = catalogue.line_symbols(spark, SF).where("tag = 'def'").select("symbol_id", "path", "start_line", "end_line").collect()
    want = sorted((s.symbol_id, t) for s in defs if s.start_line <= 4 and s.end_line >= 2 for t in tails if s.path == t or s.path.endswith("/" + t))
    got = sorted(map(tuple, catalogue.QUERIES["span_overlap"](spark, SF).collect()))
    assert got == want and len({t for _, t in got}) > len(tails) // 2


def test_injection_adds_only_what_is_no_candidate(spark):
    rows = sources.documents(spark, SF).withColumn("text", F.concat(F.lit("class doc_7:\n"), F.col("text")))
    every = rows.select(F.lit(0).alias("query_id"), F.lit("doc_7").alias("query"), "doc_id", "path", "text", F.lit(1.0).alias("score"))
    assert rerank.injected(every, rows, catalogue.S).count() == 0
    assert rerank.injected(every.where("doc_id = 0"), rows, catalogue.S).count() == rows.where(F.contains("path", F.lit("doc_7")) & (F.col("doc_id") != 0)).count()
