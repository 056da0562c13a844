"""op10 against brute force: phrases, grams and alignments of a table of texts."""

import random
import re

from tessera.llm import licenses

EDGES = [None, "", " ", "a", "same text", "same text", "from " * 3000]
NOTICE = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
LONG = " ".join(f"t{k}" for k in range(40))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(max(row[k + 1], new[-1], row[k] + (x == y)))
        row = new
    return row[-1]


def brute(text, templates):
    """(n_words, n_base, first, last, base_labels, labels, score); texts here are short enough to be one stretch."""
    w = words(text)
    places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    base, more, best = {label for _, label in places}, set(), 0.0
    for label, template in templates.items():
        t = words(template)
        grams = {tuple(t[k : k + 4]): k for k in range(len(t) - 3)}
        found = [(k, grams[tuple(w[k : k + 4])]) for k in range(len(w) - 3) if tuple(w[k : k + 4]) in grams]
        clusters = []
        for d, k, at in sorted((k - at, k, at) for k, at in found):
            if clusters and d - clusters[-1][-1][0] <= licenses.NEIGHBOUR:
                clusters[-1].append((d, k, at))
            else:
                clusters.append([(d, k, at)])
        for c in clusters:
            if len({at for *_, at in c}) < licenses.VOTES * len(grams):
                continue
            n = lcs(w[max(0, min(k for _, k, _ in c) - 8) : max(k for _, k, _ in c) + 12], t)
            if n >= (licenses.LEAST_SHARE if len(t) >= licenses.SHORT else licenses.SHORT_SHARE) * len(t):
                more.add(re.sub("-short$", "", label))
                best = max(best, n / len(t))
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best


def test_documents_equal_brute_force(docs_of):
    rng = random.Random(2)
    templates = {**licenses.TEMPLATES, "notice": NOTICE, "long": LONG}
    texts = [*EDGES, "Licensed under CC BY-NC 4.0. x MIT License", "licensed under cc by 4.0", "cc by by cc by"]
    for template in templates.values():
        w = template.split()
        for _ in range(6):
            copy = [x for x in w if rng.random() > 0.08]
            for _ in range(rng.randrange(4)):
                copy.insert(rng.randrange(len(copy) + 1), f"x{rng.randrange(99)}")
            texts.append(" ".join([f"a{rng.randrange(99)}" for _ in range(rng.randrange(30))] + copy + ["end"] * rng.randrange(5)).upper())
        texts += [template[: len(template) // 3], " ".join(w[len(w) // 2 :])]
    documents, _ = licenses.scan(docs_of(texts), templates)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in documents.collect()}
    want = {k: brute(t, templates) for k, t in enumerate(texts)}
    assert got == {k: (*w[:6], round(w[6], 9)) for k, w in want.items()}
    assert {x for w in want.values() for x in w[5].split(",")} >= {"notice", "long", "mit", "apache-2.0"}


def test_a_repeated_part_is_no_notice(docs_of):
    """Two of nine hashes, three times over, are less than the notice; a long chain of repeats is judged by its best stretch."""
    twelve = " ".join(NOTICE.split()[:12])
    documents, spans = licenses.scan(docs_of([" ".join(twelve.split()[:5] * 3), " ".join(twelve.split()[:5] * 500), twelve, "x " * 500 + f"{twelve} " * 40]), {"notice": twelve}, {})
    assert {r.doc_id: (r.labels, r.score) for r in documents.collect()} == {0: ("", 0.0), 1: ("", 0.0), 2: ("notice", 1.0), 3: ("notice", 1.0)}
    assert [(s.start, s.end) for s in spans.where("doc_id = 2").collect()] == [(0, 12)] and spans.where("doc_id = 3").count() >= 1


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, NOTICE), (1, NOTICE), (1, "MIT License"), (None, NOTICE), (None, None)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, template string, pos int")
    documents, spans = licenses.scan(docs, {"notice": NOTICE})
    got = sorted(((r.doc_id, r.n_words, r.labels) for r in documents.collect()), key=str)
    assert got == sorted([(1, 20, "notice"), (1, 20, "notice"), (1, 2, "mit"), (None, 20, "notice"), (None, 0, "")], key=str)
    assert sorted(((s.doc_id, s.start, s.end, s.share) for s in spans.collect()), key=str) == sorted([(1, 0, 20, 1.0), (None, 0, 20, 1.0)], key=str)
    documents, spans = licenses.scan(docs.limit(0))
    assert documents.count() == 0 == spans.count()
