import json

from tessera.sources import labels


def test_labelled_questions(spark, tmp_path):
    (tmp_path / "repos.json").write_text(json.dumps([{"name": "a", "language": "python", "url": "u", "revision": "r"}, {"name": "b", "language": "go", "url": "u", "revision": "r", "benchmark_root": "src"}]))
    (tmp_path / "annotations").mkdir()
    (tmp_path / "annotations/a.json").write_text(json.dumps([
        {"query": "q1", "category": "symbol", "relevant": ["x.py", {"path": "y.py", "start_line": 3, "end_line": 9}], "secondary": [{"path": "z.py"}]},
        {"query": "q2", "repo": "b"}, {"query": "q3", "repo": "unknown", "relevant": ["x.py"]},
    ]))
    (tmp_path / "annotations/unknown.json").write_text(json.dumps([{"query": "q4", "repo": "a", "relevant": ["x.py"]}]))
    repos = labels.repositories(spark, str(tmp_path / "repos.json"))
    assert {(r.repo, r.benchmark_root) for r in repos.collect()} == {("a", None), ("b", "src")}
    got = {r.query: (r.repo, r.language, r.category, [tuple(t) for t in r.targets]) for r in labels.questions(spark, str(tmp_path / "annotations"), repos).collect()}
    assert got == {"q1": ("a", "python", "symbol", [("x.py", None, None), ("y.py", 3, 9), ("z.py", None, None)]), "q2": ("b", "go", "semantic", [])}
