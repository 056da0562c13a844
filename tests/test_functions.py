from pyspark.sql import functions as F

from tessera.functions import classify as fc
from tessera.functions import text as ft
from tessera.operators import chunking, extract, rerank
from tessera.settings import Settings


def values(spark, rows, expression, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1).select(expression).collect()]


def test_text_functions(spark):
    x = F.col("x")
    assert values(spark, ["src/HTTPServer.py", "parse_configFile2"], ft.humanise(x)) == ["src HTTP Server py", "parse config File 2"]
    assert values(spark, ["HandlerStack", "my_func", "plain"], ft.split_identifier(x)) == [["handlerstack", "handler", "stack"], ["my_func", "my", "func"], ["plain"]]
    assert values(spark, ["how does decryptVault work"], ft.tokenize_query(x)) == [["decryptvault", "decrypt", "vault"]]
    assert values(spark, ["HandlerStack", "pkg::Widget", "_x", "plain word", "lower"], ft.is_symbol_query(x)) == [True, True, True, False, False]
    assert values(spark, ["a::b.c", "a.b.c", "x"], ft.unqualified(x)) == ["b.c", "c", "x"]
    assert values(spark, ["use HandlerStack now"], ft.split_inline(x)) == ["use HandlerStack handler stack now"]
    assert values(spark, ["a/b_x.py", "a/b.go"], ft.matches_globs(x, ["*.py"], ["*[!x].py"])) == [True, False]
    assert values(spark, ["\n  \n one \n two", " "], ft.opening_line(x)) == ["one", None]


def test_paths(spark):
    x, s = F.col("x"), Settings()
    paths = ["tests/a.md", "src/inspection.py", "a/test_b.py", "FooTests.swift", "x/latest.py", "d/e.csv", "go.mod", "spec/x.rb"]
    assert values(spark, paths, fc.classify(fc.language(x), x, s)) == ["docs", "code", "tests", "tests", "code", "data", "config", "tests"]
    assert [round(v, 4) for v in values(spark, ["compat/__init__.py", "tests/test_a.py", "a/b.d.ts", "a/b.py"], fc.path_penalty(x))] == [0.15, 0.3, 0.7, 1.0]
    long = "x" * 1500 + "\n"
    assert values(spark, [long * 20, "short\n" * 5000, "x" * 20000, "tiny"], fc.is_generated(x, F.octet_length(x))) == [True, False, True, False]


def test_definitions_and_matches(spark):
    rows = [("class foo.Bar:", "Bar"), ("Class Bar", "Bar"), ("create table Bar (", "Bar"), ("def Barn", "Bar")]
    assert values(spark, rows, rerank.defines(F.col("x"), F.col("y")), "x string, y string") == [True, False, True, False]
    assert values(spark, ["dependencies/parser.py"], rerank.count_matches(F.array(F.lit("dependency"), F.lit("parse"), F.lit("no")), rerank.path_parts(F.col("x")))) == [1]


def test_windows_follow_the_greedy_rule(spark):
    text = "aaa\nbbbbb\nc\n" + "d" * 50 + "\nrest"
    spans = values(spark, [text], chunking.window_spans(chunking.lines_of(F.col("x")), 6))[0]
    assert [(s["first"], s["last"], s["bytes"]) for s in spans] == [(1, 2, 10), (3, 4, 53), (5, 5, 4)]


def test_python_and_markdown_symbols():
    from tessera.plans.catalogue import SAMPLE

    found = extract.from_python(SAMPLE)
    assert {(r["name"], r["kind"]) for r in found if r["tag"] == "def"} == {("LIMIT", "constant"), ("Store", "class"), ("put", "function"), ("outer", "function"), ("inner", "function")}
    refs = {(r["name"], r["enclosing"]) for r in found if r["tag"] == "ref"}
    assert {("write", "put"), ("encode", "put"), ("Row", "put"), ("helper", "inner"), ("inner", "outer"), ("outer", None), ("Codec", "put")} <= refs
    heads = extract.from_markdown("# A\ntext\n```\n# no\n```\n## B\nend")
    assert [(h["name"], h["start_line"], h["end_line"]) for h in heads] == [("A", 1, 5), ("B", 6, 7)]
    assert extract.from_markdown("no headings") == []
    assert extract.from_python("def broken(:\n  pass")[0]["name"] == "broken"
