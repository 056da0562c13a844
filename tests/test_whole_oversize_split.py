"""oversize_split over every document, against plain Python."""

from tessera.operators import chunking
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def pieces(text, most):
    data = text.encode()
    return [data[k : k + most].decode(errors="ignore") for k in range(0, max(len(data), 1), most)]


def test_every_document_is_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert any(not r.text.isascii() for r in docs)
    want = sorted((r.doc_id, k, len(p.encode())) for r in docs for k, p in enumerate(pieces(r.text, 500)))
    assert sorted(map(tuple, catalogue.QUERIES["oversize_split"](spark, SF).collect())) == want


def test_only_halved_characters_go(spark):
    texts = ["", "abc", "é" * 20, "aé中\U0001F600" * 9, "�" * 5 + "x�", "Å" * 9 + "a", "\U0001F600", "\n\x85 é\n" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for most in (2, 3, 5, 7):
        got = sorted((r.doc_id, r.piece, r.text) for r in chunking.bounded(df, most).collect())
        assert got == [(d, k, p) for d, t in enumerate(texts) for k, p in enumerate(pieces(t, most))]
