"""op5 against brute force: windows of every length, both joins, repeated rows, long texts."""

import random
import re

import pytest

from tessera.llm import decontaminate

EDGES = [None, "", " ", "a", "same text", "same text", "from " * 500]


def prose(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def brute(texts, items):
    """(n_words, n_hit, item_ids) of each text."""
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), []
        for i, x in items:
            x = words(x)
            n = min(len(x), 10)
            own = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in own] if n else []
            hit.update(k + j for k in at for j in range(n))
            ids += [str(i)] * bool(at)
        out.append((len(w), len(hit), sorted(ids)))
    return out


def mixture(rng):
    texts = [*EDGES, *(prose(rng, rng.randrange(5, 80), 6) for _ in range(40)), prose(rng, 30_000, 3000)]
    long = texts[-1].split()
    items = [(1, texts[10]), (2, texts[12] + " w1"), (3, "w1 w2 W3"), (4, None), (5, "!"), (20, "from " * 12), (6, "same text"), (7, " ".join(long[29_000:29_040])), (8, "É " + " ".join(long[:9]))]
    items += [(100 + n, " ".join(long[500 * n : 500 * n + n])) for n in range(1, 12)]
    return texts, items


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_contamination(spark, docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    texts, items = mixture(random.Random(6))
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, size int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(docs_of(texts), benchmark).collect()}
    assert got == dict(enumerate(brute(texts, items)))


def test_stage_keeps_clean_rows(spark):
    texts, items = mixture(random.Random(7))
    items = [x for x in items if x[0] < 101 or x[0] > 104]
    rows = [(k % 20 or None, t, f"c{k}") for k, t in enumerate([*texts, texts[10], "clean words of its own"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, window string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = [r for r, (_, hit, _) in zip(rows, brute([t for _, t, _ in rows], items), strict=True) if not hit]
    out = decontaminate.uncontaminated(docs, benchmark)
    assert out.columns == docs.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and 3 < len(want) < len(rows)
    assert decontaminate.uncontaminated(docs, benchmark.limit(0)).count() == len(rows)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w1 w2 w3"), (1, "w1 w2 w3"), (1, "other"), (None, "w1 w2 w3")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "W1 w2, w3"), (1, "w1 w2 w3")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_hit, r.item_ids) for r in decontaminate.contamination(docs, benchmark).collect()), key=str)
    assert got == [(1, 0, []), (1, 3, ["1"]), (1, 3, ["1"]), (None, 3, ["1"])]
    assert [(r.n_hit, r.item_ids) for r in decontaminate.contamination(docs, benchmark.limit(0)).collect()] == [(0, [])] * 4
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0 == decontaminate.uncontaminated(docs.limit(0), benchmark).count()
