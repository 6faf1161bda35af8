import os
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import catalog, context, decision, review, validation
from folio.sources import bundle, packages


@pytest.fixture
def book(tmp_path):
    files = {
        "book.md": "---\ntype: Book\nname: acme\nversion: 1.0.0\n---\nAbout\n",
        "document/a.md": "---\ntype: Note\ntags: [x, 3, y]\nlanguage: en\n---\nbody\n---\nmore\n",
        "document/index.md": "listing",
        "memory/m.md": "---\ntype: Memory\n---\nremember\n",
        "styleguide/py/r.md": "---\ntype: Rule\ndescription: d\npriority: error\npattern: '(x'\n---\n## Good\n",
        "skill/broken.md": "---\nname: [\n---\n",
        ".book/state.md": "hidden",
    }
    for p, c in files.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(c)
    return tmp_path


def test_frontmatter():
    assert bundle.split_frontmatter("﻿---\na: 1\n---\nx") == ({"a": 1}, "x")
    assert bundle.split_frontmatter("--- \na") == ({}, "--- \na") and bundle.split_frontmatter("---\n---\nb") == ({}, "b")
    for bad in ("---\na: 1\n", "---\n- a\n---\n", "---\na: [\n---\n"):
        with pytest.raises(ValueError):
            bundle.split_frontmatter(bad)
    assert bundle.normalised_tags("a") == ["a"] and bundle.normalised_tags(["a", 1]) == ["a"] and bundle.normalised_tags(None) == []
    assert bundle.split_frontmatter(bundle.join_frontmatter({"a": {"b": [1]}}, "x\n")) == ({"a": {"b": [1]}}, "x\n")


def test_read_a_book(spark, book):
    rows = {r.concept_id: r for r in bundle.read_concepts(spark, str(book), "acme").collect()}
    assert set(rows) == {"book", "document/a", "memory/m", "styleguide/py/r", "skill/broken"}
    assert rows["document/a"].tags == ["x", "y"] and rows["document/a"].body == "body\n---\nmore\n" and rows["document/a"].namespace == "document"
    assert rows["skill/broken"].parse_error and rows["skill/broken"].body is None
    entries, bad = bundle.walk(str(book))
    assert "document/a.md" in entries and not any(".book" in e for e in entries) and bad == []


def test_write_delete_promote(book):
    root = str(book)
    bundle.write_concept(root, "memory/new", {}, "text\n")
    assert "type: Memory" in (book / "memory/new.md").read_text()
    bundle.promote(root, "memory/new", "document/deep/p", {"type": "Note"})
    front, body = bundle.split_frontmatter((book / "document/deep/p.md").read_text())
    assert front["sources"] == ["memory/new"] and body == "text\n"
    with pytest.raises(FileExistsError):
        bundle.promote(root, "memory/new", "document/deep/p", {"type": "Note"})
    bundle.delete_concept(root, "document/deep/p")
    assert not (book / "document/deep").exists() and (book / "document").exists()
    for bad in ("../x", "a//b", ".book/x", "c:d"):
        with pytest.raises(ValueError):
            bundle.write_concept(root, bad, {"type": "x"}, "")


def test_projects(spark, book):
    one = bundle.read_concepts(spark, str(book), "acme")
    both = bundle.open_project([(one, True), (one.withColumn("book", F.lit("other")), False)])
    kept = context.resolved(both, "concept_id", "precedence").collect()
    assert {r.book for r in kept} == {"acme"} and both.count() == 2 * len(kept)
    with pytest.raises(ValueError):
        bundle.open_project([(one, True), (one, False)])


def test_packages(spark, book, tmp_path):
    out = tmp_path / "out"
    listed = packages.package(str(book), str(out))
    assert list(listed["files"])[0] == "book.md" and not any(p.startswith("memory") for p in listed["files"])
    problems = lambda: {(r.path, r.problem) for r in catalog.integrity_problems(packages.listed_hashes(spark, str(out)), packages.found_hashes(spark, str(out))).collect()}
    assert problems() == set()
    (out / "document/a.md").write_text("changed")
    (out / "extra.md").write_text("x")
    os.remove(out / "styleguide/py/r.md")
    assert problems() == {("document/a.md", "mismatch"), ("extra.md", "unlisted"), ("styleguide/py/r.md", "missing")}
    packages.package(str(book), str(tmp_path / "p.tar.gz"))
    with tarfile.open(tmp_path / "p.tar.gz") as tar:
        assert packages.INTEGRITY in tar.getnames()


def test_lockfile(spark, tmp_path):
    lock = packages.Lockfile.load(str(tmp_path / "none"))
    lock.pin("a", "https://x", "0" * 40)
    with pytest.raises(ValueError):
        lock.pin("a", "https://y", "0" * 40)
    lock.save(str(tmp_path / "lock"))
    assert packages.Lockfile.load(str(tmp_path / "lock")).frame(spark).collect()[0].name == "a"
    (tmp_path / "bad").write_text('{"version": 1, "pins": {"a": {"url": "u", "commit": "zz"}}}')
    with pytest.raises(ValueError):
        packages.Lockfile.load(str(tmp_path / "bad"))


def test_sources_and_diffs(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / ".gitignore").write_text("skip.py\n")
    for p in ("a.py", "skip.py", "b.txt", ".hidden.py"):
        (tmp_path / p).write_text("x = 1\n")
    assert {r.path for r in packages.read_sources(spark, str(tmp_path)).collect()} == {"a.py"}
    git("add", "a.py")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    diff = spark.createDataFrame([(1, packages.git_diff(str(tmp_path)))], "diff_id long, diff string")
    (row,) = review.added_lines(review.parse_diff(review.diff_lines(diff))).collect()
    assert (row.path, row.line_no, row.text) == ("a.py", 2, "y = 2")
    with pytest.raises(ValueError):
        packages.git_diff(str(tmp_path), max_bytes=3)


def test_validation(spark, book):
    rows = bundle.read_concepts(spark, str(book), "acme").withColumn("pattern_ok", F.lit(False))
    found = {(r.concept_id, r.requirement) for r in validation.violations(rows, validation.concept_contracts()).collect()}
    assert ("styleguide/py/r", "STG-10") in found and ("skill/broken", "SKL-3") in found and not any(c == "document/a" for c, _ in found)
    paths = spark.createDataFrame([("document/book.md", False), ("skill", False), ("document/index.md", True), ("skill/x.txt", False), ("skill/s/s.md", False), ("skill/s/other.md", False), ("skill/s/references/r.md", False)], "concept_id string, is_folder boolean")
    got = {(r.concept_id, r.requirement) for r in validation.violations(paths, validation.path_contracts("book.md")).collect()}
    assert got == {("document/book.md", "STR-3"), ("skill", "STR-7"), ("document/index.md", "STR-11"), ("skill/x.txt", "SKL-1"), ("skill/s/other.md", "SKL-6")}
    books = spark.createDataFrame([("a", None, "1.0.0", True), ("b", "n", "1.0", True), ("c", None, None, False), ("d", "n", "1.2.3-x", True)], "concept_id string, name string, version string, has_frontmatter boolean")
    bad = {(r.concept_id, r.requirement) for r in validation.violations(books, validation.manifest_contracts()).collect()}
    assert bad == {("a", "STR-5"), ("b", "STR-5"), ("c", "STR-4")}


def test_rules(spark):
    rules, skipped = packages.import_rules("- {id: a, language: py, priority: warning, pattern: [x, y], good: g, examples: {good: G}}\n- {id: b}", {"styleguide/any/general/b"})
    assert rules[0]["priority"] == "warn" and rules[0]["pattern"] == "x\ny" and rules[0]["good"] == "G" and skipped == ["styleguide/any/general/b"]
    good, bad = review.usable_rules(spark, [{"pattern": "a+"}, {"pattern": "(x"}, {"pattern": "(?=x)"}, {"pattern": r"(a)\1"}])
    assert [r["pattern"] for r in good] == ["a+"] and bad == 3


def diff_rows(spark, diff):
    return review.parse_diff(review.diff_lines(spark.createDataFrame([(1, diff)], "diff_id long, diff string")))


def test_diffs(spark):
    parsed = diff_rows(spark, "diff --git a/x b/y b/x b/y\n--- a/x\n+++ b/x\n@@ -2,4 +2,5 @@\n a\n+b\n+c\n d\n-e\n+f\n@@ -9,2 +10,0 @@\n-z\n-z\n@@ -1 +20 @@\n+only\ndiff --git a/q b/q\nnew file\n+++ b/q\n")
    assert [(r.path, r.line_no, r.text) for r in review.added_lines(parsed).orderBy("line_no").collect()] == [("y", 3, "b"), ("y", 4, "c"), ("y", 6, "f"), ("y", 20, "only")]
    assert sorted((r.start, r.end) for r in review.hunk_ranges(parsed).collect()) == [(2, 6), (20, 20)]


def test_prepass_caps_and_findings(spark):
    rules = spark.createDataFrame([(0, "u", "l", "error", "x")], "rule_seq int, rule_uri string, label string, priority string, pattern string")
    added = spark.createDataFrame([(1, "p", 2 * i, "x") for i in range(1, 15)] + [(1, "p", 3, "x"), (1, "p", 100, "no")], "diff_id long, path string, line_no int, text string")
    found = review.prepass(added, rules)
    rows = found.orderBy("line_start").collect()
    assert len(rows) == 10 and rows[0].line_start == 2 and rows[0].line_end == 4 and all(r.truncated for r in rows)
    assert len(review.prepass(added, rules, overall=3).collect()) == 3
    log = review.sarif([{**r.asDict(), "finding_id": "i"} for r in rows])
    assert log["runs"][0]["results"][0]["level"] == "error" and log["runs"][0]["tool"]["driver"]["rules"] == [{"id": "u"}]
    assert review.edit_applies(1, 9, [{"line_start": 4, "line_end": 5}, {"line_start": 1, "line_end": 2}])
    assert not review.edit_applies(1, 9, [{"line_start": 4, "line_end": 5}, {"line_start": 5, "line_end": 6}])


def test_decisions(spark):
    assert decision.estimate("abc漢字") == 3 and decision.trimmed("short", 5) == "short"
    cut = decision.trimmed("a" * 600 + "z" * 400, 50)
    assert decision.estimate(cut) <= 50 and cut[0] == "a" and cut[-1] == "z"
    state = {"big": "word " * 900, "list": ["x" * 300, {"k": "small"}], "n": 3}
    fitted = decision.fit(state, 120)
    assert decision.request_size(fitted) <= 120 and fitted["list"][1] == {"k": "small"} and fitted["n"] == 3
    assert decision.choice({"answers": {"q": {"choice": "a", "probability": 0.5}}}, "q", ["a"]) == ("a", 0.5)
    assert decision.choice({}, "q", ["a"]) == (None, None)
    with pytest.raises(ValueError):
        decision.choice({"answers": {"q": "z"}}, "q", ["a"])
    got = decision.decide_each(spark.createDataFrame([('{"a": 1}',), ("broken",)], "request string"), "request", decision.Disabled).collect()
    assert [r.response for r in got] == ['{"answers": {}}', None]
    hits = spark.createDataFrame([(i, i) for i in range(10)], "id long, place int")
    p = spark.createDataFrame([(3, 0.9), (0, 0.1), (9, 1.0)], "id long, p double")
    assert [r.id for r in decision.reranked(hits, p).collect()] == [3, 0, 1, 2, 4, 5, 6, 7, 8, 9]


def test_text(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("x")).first().x
    assert one(text.line_slice(F.col("b"), 2, 9), b="1\n2\n3") == "2\n3"
    with pytest.raises(ValueError):
        text.line_slice(F.col("b"), 0, 1)
    with pytest.raises(Exception, match="past the end"):
        one(text.line_slice(F.col("b"), 5, 6), b="1")
    assert one(text.capped(F.col("b"), 2), b="abc") == "ab…" and one(text.home_redacted(F.col("b"), "/h/me"), b="/h/me/x") == "~/x"
    assert one(text.home_redacted(F.col("b"), "/h/me"), b="/h/meta") == "/h/meta"
    assert one(text.concept_id(F.col("b")), b="a/./b.md") == "a/b" and one(text.concept_id(F.col("b")), b="a/../b.md") is None
    assert one(text.path_identifiers(F.col("b")), b="src/my_file-x.rs") == ["my_file-x", "my", "file", "x"]
    assert one(text.heading_level(F.col("b")), b="# #") == 0 and one(text.dense_script_tokens(F.col("b")), b="abc漢字") == 3
    assert one(text.project_slug(F.col("b"), F.lit("x")), b="n").startswith("n-2d711642")


def test_catalogue_text():
    counts = [{"book": "b", "document": 1, "skill": 0, "memory": 2, "styleguide": 0, "other": 0}]
    shown = catalog.render_markdown(counts, [{"concept_id": "c", "books": ["a", "b"]}])
    assert "| b | 1 | 0 | 2 | 0 | 0 |" in shown and "- `c`: a, b" in shown
