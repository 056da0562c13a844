"""op1's scores against plain Python: every text by itself, whatever stands beside it in a batch."""

import collections
import math
import random

import numpy as np
import pytest

from tessera.llm import toxicity

M64 = (1 << 64) - 1


def counts(text):
    """Slot to count of the n-grams of one text: letters in lower case, one blank for a run of anything else, a blank at both ends."""
    out, plain = collections.Counter(), " "
    for c in (text or "") + " ":
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        plain += "" if c == " " == plain[-1] else c
    for n in toxicity.SIZES:
        for k in range(len(plain) - n + 1):
            rolled = 0
            for c in plain[k : k + n]:
                rolled = (rolled * 0x100000001B3 + ord(c)) & M64
            out[((rolled + n) * 0x9E3779B97F4A7C15 & M64) >> (64 - toxicity.BITS)] += 1
    return out


def brute(text, model):
    weights = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(weights[s] * math.log1p(c) for s, c in counts(text).items() if s in weights)))))


TEXTS = [None, "", " ", "a", "Vile word.", "vile word", ".vile word", "same", "same", "ÄÖ İstanbul ß 中文 é", "x1y2 z", "  vile  \n\n word  ", "end ", " start", "word. " * 40 + "vile"]


@pytest.fixture(scope="module")
def model():
    """Weights for every slot of the texts, so that no n-gram goes unseen."""
    slots = sorted({s for t in TEXTS for s in counts(t)})
    rng = np.random.default_rng(1)
    return toxicity.Model(np.array(slots), rng.normal(size=len(slots)) / 20, -0.1)


@pytest.mark.parametrize("span", [7, 16, 50, 1 << 18])
def test_counts_of_texts_in_any_company(monkeypatch, span):
    """Spans smaller than a text cut it into pieces, larger ones put many texts side by side; the counts are the same."""
    monkeypatch.setattr(toxicity, "SPAN", span)
    rng = random.Random(span)
    for _ in range(4):
        texts = [rng.choice(TEXTS) or "" for _ in range(30)] + ["".join(rng.choice("ab .\n中") for _ in range(rng.randrange(200))) for _ in range(20)]
        owner, slot, count = toxicity.hits(texts, None)
        got = [collections.Counter() for _ in texts]
        for o, s, c in zip(owner.tolist(), slot.tolist(), count.tolist(), strict=True):
            assert s not in got[o]
            got[o][s] = c
        assert got == [counts(t) for t in texts]
    assert [len(x) for x in toxicity.hits([], None)] == [0, 0, 0]


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_scores_equal_brute_force(spark, model, parts):
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(TEXTS)], "doc_id long, text string, score double").repartition(parts)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got == {k: pytest.approx(brute(t, model), abs=1e-9) for k, t in enumerate(TEXTS)}
    assert got[7] == got[8] and got[0] == got[1]
