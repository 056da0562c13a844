"""op7 against brute force: repeated rows, texts over SPAN, split buckets, and the cover itself."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import covers, substrings

EDGES = [None, "", " ", "a", "same text", "same text", "from " * 500]


def prose(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def brute(rows):
    """(n_bytes, n_removed, n_spans, digest) of each (doc_id, text), by a set of all windows."""
    age = lambda r: (-(2**63) if r[0] is None else r[0], substrings.text_key((r[1] or "").encode()))
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=age):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[d, t] = (len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return sorted(((d, *out[d, t]) for d, t in rows), key=str)


def found(spark, rows, **limits):
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, id int, text_key string").repartition(3)
    out = substrings.dedup(docs, bits=1 << 20, limits=substrings.Limits(**limits))
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str), out


def mixture(rng):
    passages = [prose(rng, 60, 50) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = prose(rng, rng.randrange(120), 50)
        for _ in range(rng.randrange(3)):
            p, a = rng.choice(passages), rng.randrange(100)
            t = t[: len(t) // 2] + p[a : a + rng.randrange(50, 300)] + t[len(t) // 2 :]
        texts.append(t)
    texts += [*EDGES, "a" * 1000, "ab" * 300, "x" * 99, "x" * 100, "x" * 100, "\0" * 300, "é" * 100, "é" * 99]
    return list(enumerate(texts))


@pytest.mark.parametrize("span,block,hot,held", [(1 << 19, 1 << 19, 4096, 1 << 18), (300, 2000, 3, 50), (300, 1 << 19, 1, 1 << 18), (300, 1 << 19, 4096, 500)])
def test_repeated_substrings(spark, span, block, hot, held):
    """Also with texts over the span, blocks smaller than a bucket, and buckets that are split."""
    rows = mixture(random.Random(3))
    got, _ = found(spark, rows, span=span, block=block, hot=hot, held=held)
    assert got == brute(rows)


def test_repeated_rows_ids_and_nulls(spark):
    rng = random.Random(5)
    long = prose(rng, 80, 5000)
    rows = [(1, long), (1, long), (2, "y" + long[5:]), (3, long[::-1]), (3, long), (None, long[50:]), (None, long[50:]), (9, None), (9, None)]
    got, out = found(spark, rows)
    assert got == brute(rows)
    assert any(r[2] for r in got if r[0] == 3) and [r[2] for r in got if r[0] is None] == [0, 0]
    kept = {r.kept_sha256 for r in out.collect()}
    assert all(hashlib.sha256(r.kept).hexdigest() in kept for r in out.collect())


def test_large_group_of_copies(spark):
    """A group of exact and near copies in which every bucket is split."""
    rng = random.Random(8)
    base = prose(rng, 60, 5000)
    rows = [(k, base) for k in range(50)] + [(k, base[: 10 + k % 7] + f"~{k}~" + base[20:]) for k in range(50, 150)]
    got, _ = found(spark, rows, hot=20, held=1000)
    assert got == brute(rows)


def test_empty_table(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_cover_reaches_every_pair_and_ranks_windows():
    every = {(a - b) % covers.PERIOD for a in covers.COVER for b in covers.COVER}
    assert len(every) == covers.PERIOD
    rng = np.random.default_rng(1)
    for trial in range(60):
        length = (40, 100)[trial % 2]
        passage = rng.integers(97, 97 + (2, 4, 26)[trial % 3], 300).astype(np.uint8)
        noise = rng.integers(97, 99, 50 + trial).astype(np.uint8)
        flat = np.concatenate([passage, noise, passage, passage[:200], noise, passage[100:]])
        at = np.sort(rng.choice(len(flat) - length + 1, 400, replace=False))
        seen, want = set(), []
        for a in at:
            want.append(flat[a : a + length].tobytes() in seen)
            seen.add(flat[a : a + length].tobytes())
        assert covers.Suffixes(flat, length).repeats(at, np.zeros(len(at), np.int64)).tolist() == want
