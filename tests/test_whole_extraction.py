"""Queries without SQL against plain Python, over whole tables: the hashing encoder and the symbols of documents."""

import ast
import re

import numpy as np
import xxhash

from tessera.operators import extract, vectors
from tessera.plans import catalogue
from tessera.sources import corpus

SF = "/root/testdata/sf0.001"


def words_of(text):
    """Identifiers in lower case, each followed by its parts if it has several."""
    for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text):
        camel = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", word))
        cut = [x for x in (word.split("_") if "_" in word else camel) if x]
        yield from [word.lower(), *(x.lower() for x in cut if len(cut) > 1)]


def test_embed_hash(spark):
    dims = catalogue.S.embed_dims
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        counts = np.zeros(dims)
        for word in words_of(r.text):
            slot = xxhash.xxh64_intdigest(word.encode(), 42) % (2 * dims)  # a power of two: signs of the digest do not matter
            counts[slot >> 1] += 1 if slot % 2 == 0 else -1
        length = np.sqrt((counts * counts).sum())
        want[r.doc_id] = counts / length if length else counts
    got = catalogue.QUERIES["embed_hash"](spark, SF).collect()
    assert len(got) == len(want) and all(np.allclose(r.embedding, want[r.doc_id], atol=1e-6) for r in got)


def test_embedding_works_out_a_word_once(spark):
    odd = [None, "", "ñ é", "_ __ _a_b__C a1B2 9ab 12_3 __init__", "wordñword ABc\0x", "x" * 9000 + " yZ" * 9000, " ".join(f"w{k}Q" for k in range(3000))]
    rows = spark.createDataFrame(list(enumerate(odd)), "k long, text string")
    for dims in (64, 24):
        slots = vectors.Slots(dims)
        want = []
        for text in odd:
            counts = np.zeros(dims)
            for word in words_of(text or ""):
                digest = xxhash.xxh64_intdigest(word.encode(), 42)
                slot = (digest - (digest >> 63 << 64)) % (2 * dims)
                counts[slot >> 1] += 1 if slot % 2 == 0 else -1
            want.append(counts)
        assert (slots.counts([text and text.encode() for text in odd]) == want).all()
        assert len(slots) == len({w for text in odd for w in re.findall(rb"[A-Za-z_][A-Za-z0-9_]*", (text or "").encode())})
        got = [r.v for r in rows.select("k", vectors.hashed_vector(rows.text, dims).alias("v")).orderBy("k").collect()]
        assert got[0] is None and got[1] == [0.0] * dims
        assert all(np.allclose(v, c / (np.sqrt((c * c).sum()) or 1), atol=1e-6) for v, c in list(zip(got, want, strict=True))[1:])


def definitions(text, lang):
    """(name, line) of the definitions of a text, by rules written anew."""
    lines = text.split("\n")
    if lang == "markdown":
        inside, out = False, set()
        for n, line in enumerate(lines, 1):
            if re.match(" {0,3}(```|~~~)", line):
                inside = not inside
            elif not inside and re.match(r"\s{0,3}#{1,6}\s", line) and line.strip().strip("#").strip():
                out.add((re.sub(r"\s*#*$", "", line.strip().lstrip("#").strip()), n))
        return out
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return {(m[1], n) for n, line in enumerate(lines, 1) if (m := re.match(r"\s*(?:def|class)\s+([A-Za-z_]\w*)", line))}
        found = {(x.name, x.lineno) for x in ast.walk(tree) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}
        return found | {(t.id, x.lineno) for x in tree.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)}
    words = {"go": "func|type", "swift": "func|class|struct|enum|protocol", "typescript": "function|class|interface|enum|type"}.get(lang)
    return {(m[1], n) for n, line in enumerate(lines, 1) if (m := re.match(rf"\s*(?:{words})\s+([A-Za-z_]\w*)", line))} if words else set()


def test_extract_python(spark):
    got = {}
    for r in catalogue.QUERIES["extract_python"](spark, SF).where("tag = 'def'").collect():
        got.setdefault(r.path, set()).add((r.name, r.start_line))
    want = {r.path: found for r in corpus.documents(spark, SF).collect() if (found := definitions(r.text, r.lang))}
    want["pkg/sample.py"] = definitions(catalogue.SAMPLE, "python")
    assert got == want and len(want["pkg/sample.py"]) > 3


def test_python_nested_too_deep_or_with_other_line_ends(spark):
    deep = "def f(:\n" + "(" * 5000 + ")" * 5000
    chain = "def g():\n    return " + " + ".join(["h(1)"] * 3000)
    note = "def k(a: '" + "(" * 300 + "b" + ")" * 300 + "') -> int:\n    return 1"
    ends = "X = 1\rY = 2\r\nclass Z:\r    pass"
    texts = {"deep": "(" * 5000 + ")" * 5000 + "\ndef f(): pass", "broken": deep, "chain": chain, "note": note, "ends": ends}
    rows = spark.createDataFrame([(path, "python", "code", text) for path, text in texts.items()], "path string, lang string, content_type string, text string")
    got = extract.extract(rows).collect()
    defs = sorted((r.path, r.name, r.start_line) for r in got if r.tag == "def")
    assert defs == [("broken", "f", 1), ("chain", "g", 1), ("deep", "f", 2), ("ends", "X", 1), ("ends", "Y", 2), ("ends", "Z", 3), ("note", "k", 1)]
    assert sum(r.path == "chain" and r.name == "h" and r.enclosing == "g" for r in got) == 3000
