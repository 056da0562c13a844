"""The pipeline's stages on the smallest tables: what each drops, columns, empty tables. The operators have brute-force tests of their own."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        kept = {r.doc_id for r in rows}
        before = {r.doc_id: r.text for r in left.collect()}
        assert kept <= set(before) and len(rows) == len(kept) and len(kept) > 0.8 * len(before), name
        assert name == "secrets" or all(before[r.doc_id] == r.text for r in rows)
        left = spark.createDataFrame(rows, docs.schema)
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in left.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_of_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumn("digest", F.lit("d")).withColumn("base_spans", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.encode_tokens(spark, docs.limit(0), SF).count() == 0
