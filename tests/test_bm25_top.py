"""The best BM25 hits in two scans against all scores, ranked: ties, odd texts, filters, blocks of queries, repeated keys."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = [(1, "alpha beta beta gamma"), (2, "the and of"), (3, "delta Größe nothing"), (None, "gamma alpha"), (5, ""), (6, "common")]
TEXTS = ["alpha beta", "alpha beta", "ALPHA, beta; gamma_gamma", None, "", "— … !", "größe delta—alpha’s", "x" * 50, "common " * 9, "gamma İı alpha2 ３beta delta", "delta " * 3000 + "alpha"]


def hits(df):
    return sorted((str(r.query_id), str(r.k), r.bm25, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("keyed", ["long", "string", "repeated"])
def test_best_hits_equal_all_scores_ranked(spark, keyed, monkeypatch):
    rows = [(k, k % 3 == 0 if k % 5 else None, t) for k, t in enumerate(TEXTS * 4 + ["common filler"] * 60)]
    docs = spark.createDataFrame(rows, "k long, even boolean, text string").repartition(5)
    docs = docs.withColumn("k", F.concat(F.lit("d"), "k")) if keyed == "string" else docs.withColumn("k", F.col("k") % 50) if keyed == "repeated" else docs
    if keyed == "repeated":  # any length of a repeated key may count: the same in both
        docs = docs.withColumn("text", F.element_at(F.array(*map(F.lit, (t or "" for t in TEXTS))), (F.col("k") % 11 + 1).cast("int")))
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    keep = F.col("even") if keyed != "repeated" else F.lit(True)
    for depth in (1, 4, 1000):
        assert hits(lexical.bm25_top(docs, asked, depth, None, "k")) == hits(lexical.top(lexical.bm25(docs, asked, None, "k"), "bm25", depth, "k"))
        want = hits(lexical.top(lexical.bm25(docs, asked, keep, "k"), "bm25", depth, "k"))
        assert want and hits(lexical.bm25_top(docs, asked, depth, keep, "k")) == want
        if depth == 4:
            monkeypatch.setattr(lexical, "BLOCK_TERMS", 3)
            monkeypatch.setattr(lexical, "CELLS", 7)
            monkeypatch.setattr(lexical, "HELD", 5)
            monkeypatch.setattr(lexical, "TEXT_BYTES", 40)
            assert hits(lexical.bm25_top(docs, asked, depth, keep, "k")) == want
            monkeypatch.undo()
    assert lexical.bm25_top(docs, asked.where("query_id = 5"), 3, None, "k").isEmpty()


def test_tokens_in_pieces_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(lexical, "TEXT_BYTES", 10)
    asked = lexical.Asked.__new__(lexical.Asked)
    asked.terms = pa.array(["alpha", "delta", "common"])
    texts = [(t or "").lower() for t in TEXTS]
    column = pa.array([t and t.lower().encode() for t in ["left out", *TEXTS]], pa.binary()).slice(1)
    data, edges = lexical.blanked(column)
    ranges = list(lexical.blocks(edges, 3))
    assert [a for a, _ in ranges[1:]] == [b for _, b in ranges[:-1]] and ranges[0][0] == 0 and ranges[-1][1] == len(texts)
    for a, b in ranges:
        sizes, owner, term, tf = asked.postings(data, edges[a : b + 1])
        words = [re.findall(r"[^\W_]+", t) for t in texts[a:b]]
        assert sizes.tolist() == [len(w) for w in words]
        want = {(k, n): w.count(t) for k, w in enumerate(words) for n, t in enumerate(asked.terms.to_pylist()) if t in w}
        assert dict(zip(zip(owner.tolist(), term.tolist(), strict=True), tf.tolist(), strict=True)) == want


def test_no_posting_or_score_is_dealt_out(spark):
    plan = catalogue.QUERIES["bm25_batch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # each task hands on its best hits of a query, and they are ranked
    assert plan.count("Exchange hashpartitioning(query_id") == plan.count("Exchange ") == 1 and "Generate" not in plan


@pytest.mark.parametrize("name", ["bm25_batch", "evidence_map", "coherence_boost", "rrf_fusion", "rrf_weighted", "minmax_norm"])
def test_tiers_write_no_postings(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # no text is taken apart into rows, and what is joined with the lists is no posting
    assert "Generate" not in plan and "tf#" not in plan and "MapInArrow" in plan
