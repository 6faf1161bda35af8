import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from folio.__main__ import main
from folio.functions import imports
from folio.operators import assistant, decision, retrieval
from folio.sources import git


@pytest.fixture(scope="module")
def docs(spark):
    body = "intro\n\n## Good\n\n```py\n## Bad is not here\nx = 1\n```\n\n## Bad\n\nprose\n"
    rows = [(1, "r/a", "alpha alpha rule", "error", body, "styleguide"), (2, "r/a", "alpha rule", "error", body, "styleguide"), (3, "r/b", "alpha beta", None, "none", "styleguide")]
    return spark.createDataFrame(rows, "id long, concept_id string, text string, priority string, body string, namespace string")


def test_sections():
    body = "## Good\n\n~~~\ncode\n~~~\n### deeper\nmore\n## Bad\n"
    assert assistant.section("## Good\n\n```rs\na\nb\n```\n", "Good") == "a\nb"
    assert assistant.section(body, "Good").startswith("~~~") and assistant.section(body, "Bad") is None


def test_search_rules(docs):
    got = assistant.search_rules(docs, docs, "alpha rule", None, 5, retrieval.Filter(namespaces=["styleguide"]))
    assert [r["concept_id"] for r in got] == ["r/a", "r/b"]
    assert got[0]["good"] == "## Bad is not here\nx = 1" and got[0]["bad"] == "prose" and got[1]["good"] is None


class Says:
    def __init__(self, answer):
        self.answer = answer

    def decide(self, request):
        if isinstance(self.answer, Exception):
            raise self.answer
        return {"answers": {"answer": self.answer}} if self.answer else {}


def test_ask(docs):
    ask = lambda p, q="alpha": assistant.ask(docs, docs, q, None, p)
    first = ask(None)["answer"]
    assert ask(None)["mode"] == "ranked" and len(ask(None)["candidates"]) == 2
    got = ask(Says({"choice": "r/b", "confidence": 0.7}))
    assert (got["mode"], got["answer"], got["confidence"]) == ("decided", "r/b", 0.7)
    assert ask(Says(None))["mode"] == "ranked"
    for bad in (Says(OSError()), Says({"choice": "zzz"})):
        assert (ask(bad)["mode"], ask(bad)["answer"]) == ("failed open", first)
    assert ask(None, "unheard")["mode"] == "empty"


def test_skills(spark):
    rows = [("a", "skill/x", "skill", "Skill", "d", "b", 0), ("b", "skill/x/x", "skill", "Skill", "d", "b", 1), ("b", "skill/y/z", "skill", "Skill", "d", "b", 1), ("b", "skill/w", "skill", "Skill", " ", "b", 1)]
    found = assistant.list_skills(spark.createDataFrame(rows, "book string, concept_id string, namespace string, type string, description string, body string, precedence int"))
    assert {(r.book, r["name"], r.is_shadowed) for r in found.collect()} == {("a", "x", False), ("b", "x", True)}


def test_decorated(spark):
    concepts = spark.createDataFrame([(1, "l", "text", None), (2, "i", "text", "human-reviewed")], "id long, book string, text string, claim string")
    books = spark.createDataFrame([("l", True, None), ("i", False, "c1")], "book string, is_local boolean, source_commit string")
    caps = spark.createDataFrame([("i", "machine-confirmed")], "book string, cap string")
    hits = spark.createDataFrame([(2, 0.9), (1, 0.5)], "id long, score double")
    got = assistant.decorated(hits, concepts, books, caps).orderBy("place").collect()
    assert [(r.id, r.origin, r.trust, r.source_commit) for r in got] == [(2, "imported", "machine-confirmed", "c1"), (1, "local", "unverified", None)]
    assert got[0].shown.startswith("<untrusted") and got[1].shown == "text"


def test_http_provider():
    codes, seen = [200, 400, 503], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(codes[len(seen) - 1])
            self.end_headers()
            self.wfile.write(b'{"answers": {}}')

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    now = [100.0]
    provider = decision.HttpProvider(f"http://127.0.0.1:{server.server_port}/", clock=lambda: now[0])
    assert provider.decide({"a": 1}) == {"answers": {}}
    for _ in range(2):  # a refusal, then an error of the server
        with pytest.raises(OSError):
            provider.decide({})
    with pytest.raises(OSError, match="rests"):
        provider.decide({})
    assert len(seen) == 3
    now[0] += 31
    server.shutdown()


def test_imports():
    assert imports.expanded("use::{a, b::{c, self}};") == [["use", "a"], ["use", "b", "c"], ["use", "b"]]
    assert imports.expanded("std::io as x") == [["std", "io"]]
    assert imports.tree([["a", "b"], ["a", "c", "d"], ["a", "c", "e"], ["z"]]) == "a: b, c::{d, e}\nz"


def test_git_checkouts(tmp_path):
    origin = tmp_path / "origin"
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    origin.mkdir()
    run("init", "-q", "-b", "main")
    commits = []
    for n in range(2):
        (origin / "a.md").write_text(str(n))
        run("add", ".")
        run("commit", "-qm", str(n))
        commits.append(run("rev-parse", "HEAD"))
    url, target = str(origin), str(tmp_path / git.slug("a b", str(origin)))
    assert git.remote_commit(url) == git.remote_commit(url, "main") == commits[1] and git.default_branch(url) == "main"
    assert git.checkout(url, target, commits[0]) == commits[0] == git.head(target)
    assert git.checkout(url, target) == commits[1] and git.split_slug(git.slug("n", "u"))[0] == "n"
    assert git.remove(target) and not git.remove(target) and git.head(target) is None
    with pytest.raises(git.GitFailed):
        git.checkout(url, target, "0" * 40)


def test_command_line(tmp_path, capsys, spark):
    (tmp_path / "document").mkdir()
    (tmp_path / "document/a.md").write_text("---\ntype: Note\n---\nalpha beta\n")
    (tmp_path / "document/b.md").write_text("---\ntype: ''\n---\nalpha\n")
    (tmp_path / "x.py").write_text("def f():\n    g()\n\n\ndef g():\n    pass\n")
    lines = lambda *a: (main(list(a)), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    root = str(tmp_path)
    assert [x["requirement"] for x in lines("validate", root)] == ["DOC-1"]
    assert lines("search", root, "beta")[0]["concept_id"] == "document/a"
    assert lines("callers", root, "g")[0]["caller"] == "f"
    (tmp_path / "y.rs").write_text("fn f() {\n    g(1, 2);\n}\n")
    assert lines("grep", root, "g()") == [{"path": "x.py", "line_start": 2, "line_end": 2, "matched": "g()"}]
    assert lines("grep", root, "g($A, $B)", "--lang", "rust") == [{"path": "y.rs", "line_start": 2, "line_end": 2, "matched": "g(1, 2)"}]
    changed = lines("grep", root, "g($A, $B)", "--lang", "rust", "--rewrite", "g($B)")
    assert [x["path"] for x in changed] == ["y.rs"] and "+    g(2);" in changed[0]["diff"]
    assert lines("index", root, str(tmp_path / "ix"))[0]["upserted"] == 2
