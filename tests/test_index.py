"""The index from a directory to answers."""

import http.server
import json
import threading

import pytest

from tessera import cli
from tessera.index import Index
from tessera.operators import extract
from tessera.settings import Settings
from tessera.streaming import follow


@pytest.fixture(autouse=True)
def own_home(tmp_path_factory, monkeypatch):
    monkeypatch.setenv("TESSERA_HOME", str(tmp_path_factory.mktemp("home")))


PARSER = '"""Parsing of requests into parts that the rest of the program can use."""\n\n\nclass RequestParser:\n    def parse_request(self, raw):\n        parts = raw.split("/")\n        return [self.clean(p) for p in parts if p]\n\n    def clean(self, part):\n        return part.strip().lower()\n'
USER = "from parser import RequestParser\n\n\ndef handle(raw):\n    parser = RequestParser()\n    return parser.parse_request(raw) or ['nothing was asked for at all in this request']\n"


def test_refresh_navigation_and_search(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/parser.py").write_text(PARSER)
    (tmp_path / "src/user.py").write_text(USER)
    (tmp_path / "node_modules/x.py").write_text(USER)
    (tmp_path / "src/skipped.py").write_text(USER)
    (tmp_path / ".gitignore").write_text("skipped.py\n")
    (tmp_path / "rows.csv").write_text("a,b\n1,2\n")
    index = Index.open(spark, str(tmp_path), Settings(refresh_mode="manual"))
    first = index.refresh()
    assert (first.added, first.changed, first.deleted) == (2, 0, 0)
    assert [(r.path, r.start_line) for r in index.definitions("RequestParser").collect()] == [("src/parser.py", 4)]
    assert [(r.path, r.enclosing) for r in index.references("parse_request").collect()] == [("src/user.py", "handle")]
    top = index.search("RequestParser", 3).collect()
    assert top[0].path == "src/parser.py" and top[0].score == 1.0 and "exact" in top[0].tiers
    (tmp_path / "src/user.py").unlink()
    second = index.refresh()
    assert (second.added, second.changed, second.deleted) == (0, 0, 1)
    assert index.references("parse_request").count() == 0
    assert cli.main(["defs", "clean", "-r", str(tmp_path)], spark) == 0
    assert json.loads(capsys.readouterr().out)["count"] == 1
    assert cli.main(["search", "x", "--content", "data", "-r", str(tmp_path)], spark) == 2
    assert cli.main(["defs", "clean", "-r", str(tmp_path), "-l", "pyton"], spark) == 2
    assert "'python'" in capsys.readouterr().err
    assert cli.main(["status", "-r", str(tmp_path)], spark) == 0
    shown = json.loads(capsys.readouterr().out)
    assert (shown["files"], shown["bytes"], shown["languages"]) == (1, len(PARSER), "python 1") and not (tmp_path / ".tessera").exists()
    assert cli.main(["init", "-r", str(tmp_path)]) == 0 and cli.main(["init", "-r", str(tmp_path)]) == 1
    assert cli.main(["clear", "-r", str(tmp_path), "--dry-run"]) == 0 and "would remove" in capsys.readouterr().out
    assert cli.main(["clear", "-r", str(tmp_path)]) == 0 and index._meta() is None


def test_enclosing_ids_generated_files_and_revisions(spark, tmp_path, monkeypatch):
    twice = "class A:\n    def go(self):\n        return help_out(1)\n\n\nclass B:\n    def go(self):\n        return help_out(2)\n"
    (tmp_path / "a.py").write_text(twice)
    (tmp_path / "made.py").write_text("x = [" + "1, " * 60_000 + "]\n")
    index = Index.open(spark, str(tmp_path), Settings(refresh_mode="manual", data_dir="own/index", hard_exclude=("own",)))
    assert index.data == str(tmp_path / "own/index") and index.refresh().added == 1
    ids = {(r.path, r.start_line): r.symbol_id for r in index.definitions("go").collect()}
    assert [(r.start_line, r.enclosing_id, r.enclosing_line) for r in index.references("help_out").collect()] == [(3, ids["a.py", 2], 2), (8, ids["a.py", 7], 7)]
    again = index.refresh()
    assert (again.added, again.changed, again.deleted) == (0, 0, 0) and index._meta()["version"] == 1
    monkeypatch.setattr(extract, "revision", lambda: "another")
    assert index.stale() and index.refresh().added == 1 and not index.stale()
    (tmp_path / "b.py").write_text(twice)
    index.refresh()
    folders = sorted(p.name[:2] for p in (tmp_path / "own/index").iterdir() if p.name != "meta")
    assert folders == ["v2", "v3"] and index.status().where("what = 'files'").first()["n"] == 2


def test_vectors_that_failed_are_asked_for_again(spark, tmp_path):
    answers = {"up": False, "asked": 0}

    class Encoder(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            answers["asked"] += len(texts)
            self.send_response(200 if answers["up"] else 503)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(texts)]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Encoder)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "a.py").write_text(PARSER)
    index = Index.open(spark, str(tmp_path), Settings(refresh_mode="manual", embed_backend="http", embed_dims=2, embed_endpoint=f"http://127.0.0.1:{server.server_port}/"))
    with pytest.warns(UserWarning, match="no vectors"):
        index.refresh()
    assert index._table("vectors").count() == 0 < index._table("chunks").count()
    answers["up"] = True
    assert index.refresh().changed == 0 and index._table("vectors").count() == index._table("chunks").count()
    assert "cosine" in index.search("parse the request", 2).first().tiers
    other = Index.open(spark, str(tmp_path), Settings(refresh_mode="manual"), index.data)
    with pytest.warns(UserWarning, match="another encoder"):
        assert "cosine" not in other.search("parse the request", 2).first().tiers
    server.shutdown()


def test_streams(spark, tmp_path):
    root, marks = tmp_path / "root", tmp_path / "marks"
    root.mkdir()
    (root / "a.py").write_text(PARSER)
    index = Index.open(spark, str(root), Settings(refresh_mode="manual"))
    follow.follow_directory(index, str(marks / "a")).awaitTermination()
    assert index.definitions("clean").count() == 1
    (root / "b.py").write_text(USER)
    (root / "a.py").unlink()
    follow.follow_directory(index, str(marks / "a")).awaitTermination()
    assert index.definitions("clean").count() == 0 and index.definitions("handle").count() == 1
    with pytest.raises(ValueError):
        follow.follow_directory(Index.open(spark, str(root), data=str(root / "x")), str(marks / "b"))
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow.follow_table(spark, str(tmp_path / "in"), "k int, v string", lambda d: d.selectExpr("k", "upper(v) AS v"), ["k"], str(tmp_path / "out"), str(marks / "c")).awaitTermination()
    assert sorted(map(tuple, follow.latest(spark, str(tmp_path / "out")).collect())) == [(1, "A"), (2, "C"), (3, "D")]
