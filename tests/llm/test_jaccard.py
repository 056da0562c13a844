"""op6 against brute force: components, links, signatures, and the rows that stay of each group."""

import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard

EDGES = [None, "", " ", "a", "same text", "same text", "from " * 500]
LIMITS = [{}, {"block": 6, "shingles": 400, "star": 5, "sets": 5, "columns": 50, "span": 200}]


def prose(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def grams(text, size):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    """(doc_id, n_shingles, component_id, n_links) of each row."""
    sets = [grams(t, size) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    links = {s: {o for o in distinct if o != s and 100 * len(s & o) >= percent * len(s | o)} for s in distinct}
    root = {}
    for s in distinct:
        todo, mine = [s], {s}
        while todo:
            for o in links[todo.pop()] - mine:
                mine.add(o)
                todo.append(o)
        root[s] = frozenset(mine)
    ids = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            ids[root[s]] = min(d, ids.get(root[s], d))
    return [(d, len(s), ids.get(root[s]) if s else d, len(links[s]) if s else 0) for (d, _), s in zip(rows, sets, strict=True)]


def mixture(rng):
    """Edges, a large group of near copies, smaller ones, a chain, one passage in many texts, and noise."""
    texts = list(EDGES)
    for n, words in ((40, 120), (5, 90), (3, 30)):
        base = prose(rng, words, 5000).split()
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
            texts.append(" ".join(copy))
    chain = prose(rng, 100, 5000).split()
    for k in range(12):
        texts.append(" ".join([f"new{k}x{j}" for j in range(3 * k)] + chain[3 * k :]))
    passage = prose(rng, 40, 5000)
    texts += [passage + " " + prose(rng, rng.randrange(2, 12), 300) for _ in range(30)]
    texts += [prose(rng, rng.randrange(1, 60), 300) for _ in range(40)] + [prose(rng, rng.randrange(1, 9), 3) for _ in range(40)]
    return list(enumerate(texts))


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "y", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, key int, root string, row int").repartition(3)


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 60)])
def test_no_link_is_lost_or_invented(spark, limits, size, percent):
    rows = mixture(random.Random(size))
    out = jaccard.similar_groups(table(spark, rows), size, percent, bits=1 << 20, limits=jaccard.Limits(**limits))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out.collect())
    want = sorted(brute(rows, size, percent))
    assert got == want and max(r[3] for r in want) > 8


def test_repeated_ids_and_nulls(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a + " end"), (None, c), (None, c + " end"), (None, a), (5, None), (5, None), (None, "")]
    out = jaccard.similar_groups(table(spark, rows), 3, 90, bits=1 << 20)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out.collect()), key=str)
    assert got == sorted(brute(rows, 3, 90), key=str)
    left = jaccard.deduplicated(table(spark, rows), 3, 90, bits=1 << 20)
    assert left.columns == ["doc_id", "text", "key", "root", "row"]
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert len([x for x in got if x in ((None, c), (None, c + " end"))]) == 1
    assert sorted((x for x in got if x[1] not in (c, c + " end")), key=str) == sorted([(1, a), (1, b), (5, None), (5, None), (None, "")], key=str)


def test_one_row_of_each_group_stays(spark):
    rows = mixture(random.Random(1))
    want = brute(rows, 5, 80)
    keep = {r[0] for r in want if r[0] == r[2]}
    left = jaccard.deduplicated(table(spark, rows + rows[20:30]), 5, 80, bits=1 << 20).collect()
    assert sorted(r.doc_id for r in left) == sorted(keep)


def test_empty_table(spark):
    empty = table(spark, [(1, "x")]).limit(0)
    assert jaccard.similar_groups(empty, bits=1 << 20).count() == 0 == jaccard.deduplicated(empty, bits=1 << 20).count()


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for size in (2, 3, 5, 9, 10, 19, 50, 300, 2000):
        for percent in (60, 80, 90):
            for trial in range(20):
                a = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
                # as unlike as may be: some elements lost, some replaced, some added
                lost, added = (int(rng.integers(0, len(a) * (100 - percent) // 100 + 2)) for _ in range(2))
                b = np.unique(np.append(a[rng.permutation(len(a))[lost:]], rng.integers(0, 2**64, added, np.uint64, endpoint=False)))
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= percent * (len(a) + len(b) - shared) and (len(a) != len(b) or shared < len(a)):
                    assert np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).size


def test_products_of_blocks_count_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(x, y)) for y in sets[3:]] for x in sets[:5]]
    same = jaccard.shared_counts(sets, sets, 7)
    assert all(same[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)
    assert jaccard.shared_counts(sets[:5], sets[3:], 7).tolist() == want and jaccard.shared_counts(sets[:1], sets[3:], 7).tolist() == want[:1]


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 3000), np.uint64, endpoint=False))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, rng.integers(0, 200), np.uint64, endpoint=False)))
        x, y = (np.frombuffer(jaccard.sketch(s), np.uint64) for s in (a, b))
        assert len(jaccard.sketch(a)) * 8 == jaccard.SKETCH and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
