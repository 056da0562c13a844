"""op8's fertility figures and bands against plain Python; repeated rows, nulls, empty tables and clashing columns of op8 and op9."""

import collections
import hashlib
import math
import random
import re

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from tessera.llm import bpe, quality

PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def libraries():
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    return tiktoken.Encoding("test", pat_str=PATHS[2], mergeable_ranks=load_tiktoken_bpe(PATHS[0]), special_tokens={}), pieces


def brute(text, libraries):
    """(chars_per_token, fallback_share, token_entropy, n_tokens): every word by itself, as both libraries encode it."""
    encoding, pieces = libraries
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return 0.0, 0.0, 0.0, 0
    tokens = [i for w in words for i in encoding.encode_ordinary(" " + w)]
    fallen = sum(pieces.is_byte(i) for w in words for i in pieces.encode(w))
    entropy = -sum(c / len(tokens) * math.log2(c / len(tokens)) for c in collections.Counter(tokens).values())
    return sum(len(w) + 1 for w in words) / len(tokens), fallen / sum(len(w.encode()) for w in words), abs(entropy), len(tokens)


def script(text):
    held = {name: sum(a <= ord(c) <= b and not (name == "latin" and c < "À" and not c.isalpha()) for c in text) for name, (a, b, _) in quality.SCRIPTS.items()}
    best = max(held, key=held.get)
    return quality.SCRIPTS[best][2] if held[best] else quality.OTHER


def test_figures_and_bands(spark, libraries):
    rng = random.Random(3)
    english = "the river house walked seven morning letter because under light nothing answer people garden window street again little water paper story music".split()
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "日本語中文字漢在的一是不了人我", "अआइईउऊएऐओऔकखगघ", "אבגדהוזחטיכלמנ", "0123456789", "\U0001F600\U0001F601\U0001F680"]
    rows = [(None, None), ("", "en"), (" \n", None), ("word " * 60, "en")]
    for letters in alphabets:
        for lang in (None, "en", "xx"):
            rows.append((" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(80)), lang))
    rows += [(" ".join(rng.choice(english) for _ in range(n)), lang) for n in (49, 50, 60, 300) for lang in ("en", "de", "fr", "es", None, "xx")]
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    seen = set()
    for r in quality.judge(docs, *PATHS).collect():
        text, lang = rows[r.doc_id]
        chars, lost, bits, n = brute(text, libraries)
        assert (r.chars_per_token, r.fallback_share, r.token_entropy) == pytest.approx((chars, lost, bits), abs=1e-9)
        b = quality.LANGUAGES.get(lang) or script(text or "")
        fits = b.low <= chars <= b.high and lost <= b.fallback and bits >= min(b.bits, b.share * math.log2(max(n, 2)))
        assert r.kept == (not r.base_failed and fits)
        seen.add((r.base_failed, r.kept))
    assert seen == {(True, False), (False, True), (False, False)}


def test_rows_repeat_and_tables_may_be_empty(spark):
    text = "some words that repeat here " * 20
    rows = [(1, text, "en", 5, "x"), (1, text, "en", 5, "x"), (1, "another text", None, 5, "x"), (None, None, None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, ids_sha256 string").repartition(2)
    judged = sorted(((r.doc_id, r.n_words) for r in quality.judge(docs, *PATHS).collect()), key=str)
    assert judged == sorted([(1, 100), (1, 100), (1, 2), (None, 0)], key=str)
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = [(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows]
    assert sorted(((r.doc_id, r.decoded_sha256) for r in encoded), key=str) == sorted(want, key=str)
    assert quality.judge(docs.limit(0), *PATHS).count() == 0 == bpe.encode_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count()


def test_long_texts_and_a_full_table_of_words(spark, libraries, monkeypatch):
    """Texts above SPAN, and more distinct words than the table holds."""
    known = quality.Fertility(open(PATHS[0], "rb").read(), open(PATHS[1], "rb").read(), PATHS[2])
    monkeypatch.setattr(quality, "TABLE_WORDS", 50)
    rng = random.Random(1)
    for size in (10, 40, 60, 2000):
        text = " ".join("w" + str(rng.randrange(500)) for _ in range(size))
        words = quality.words_of([text])
        *_, chars, lost, bits, n = quality.figures(text, known.numbered(words), known)
        assert (chars, lost, bits, n) == pytest.approx(brute(text, libraries))
