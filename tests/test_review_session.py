import subprocess

import pytest

from folio.operators import catalog, patterns, review, validation
from folio.operators.review_session import Finding, Reviews, UnknownReview, checked, file_patch
from folio.sources import bundle, git, packages

DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+TODO one\n b\n@@ -20 +21,2 @@\n c\n+d\ndiff --git a/y.md b/y.md\n--- a/y.md\n+++ b/y.md\n@@ -0,0 +1,2 @@\n+TODO two\n+TODO three\n"
RULES = [{"rule_seq": 0, "rule_uri": "book://b/styleguide/todo", "label": "todo", "priority": "error", "pattern": "TODO"}, {"rule_seq": 1, "rule_uri": "book://b/styleguide/bad", "label": "bad", "priority": None, "pattern": "(x"}]


class Says:
    def __init__(self, answers):
        self.answers, self.asked = answers, []

    def decide(self, request):
        self.asked.append(request)
        if isinstance(self.answers, Exception):
            raise self.answers
        return {"answers": self.answers}


def finding(**more):
    return Finding(**({"title": "[P1] wrong", "body": "why", "priority": "P1", "path": "x.py", "line_start": 2, "line_end": 3} | more))


def test_a_session_from_start_to_findings(spark):
    provider = Says({"support": {"choice": "A", "confidence": 0.9}, "severity": {"choice": "P2"}})
    known = spark.createDataFrame([("book://b/styleguide/todo",)], "rule_uri string")
    reviews = Reviews(spark, known_rules=known, provider=provider)
    begun = reviews.start(DIFF, RULES)
    rid = begun["review_id"]
    assert begun["changed_files"] == [{"path": "x.py", "added": 2}, {"path": "y.md", "added": 2}]
    assert begun["prepass"] == {"rules": 1, "invalid_patterns": 1, "findings": 2, "truncated": False}
    assert [(f["path"], f["line_start"], f["line_end"]) for f in reviews.findings(rid)] == [("x.py", 2, 2), ("y.md", 1, 2)]
    assert reviews.diff(rid)["diff"] is None and reviews.diff(rid, "y.md")["diff"].startswith("diff --git a/y.md") and "x.py" not in reviews.diff(rid, "y.md")["diff"]
    first = reviews.report(rid, finding(rule_uris=("book://b/styleguide/todo",)))
    assert first["created"] and first["finding_count"] == 3
    assert first["assessment"] == {"support": "supported", "support_confidence": 0.9, "severity": "P2", "severity_confidence": None}
    again = reviews.report(rid, finding(rule_uris=("book://b/styleguide/todo",)))
    assert not again["created"] and again["finding_id"] == first["finding_id"] and len(provider.asked) == 1
    assert [f["origin"] for f in reviews.findings(rid, "P1", "X.PY")] == ["pattern", "agent"]
    for wrong in (finding(line_end=9), finding(path="z.py"), finding(rule_uris=("book://b/none",)), finding(line_start=10, line_end=11)):
        with pytest.raises(ValueError):
            reviews.report(rid, wrong)
    with pytest.raises(ValueError):
        reviews.diff(rid, "z.py")


@pytest.mark.parametrize("wrong", [{"title": "wrong"}, {"body": " "}, {"priority": "P9"}, {"path": "../x"}, {"path": "/x"}, {"line_start": 0}, {"line_end": 1}, {"confidence": 2.0}, {"confidence": float("nan")}, {"rule_uris": ("http://x",)}, {"edits": ((2, 3, "a"), (3, 3, "b"))}, {"edits": ((1, 2, "a"),)}, {"title": "[P1] " + "x" * 600}])
def test_findings_keep_their_contract(wrong):
    with pytest.raises(ValueError):
        checked(finding(**wrong), "book")
    assert checked(finding(edits=((3, 3, ""), (2, 2, "y"))), "book").edits == ((2, 2, "y"), (3, 3, ""))


def test_providers_that_fail_leave_findings_as_they_are(spark):
    for answers in (OSError("down"), {}, {"support": {"choice": "Z"}}):
        reviews = Reviews(spark, provider=Says(answers))
        rid = reviews.start(DIFF)["review_id"]
        assert reviews.report(rid, finding())["assessment"] is None and len(reviews.findings(rid)) == 1


def test_sessions_expire_and_the_least_recently_used_goes(spark):
    now = [0.0]
    reviews = Reviews(spark, ttl=10, max_sessions=2, clock=lambda: now[0])
    a, b = (reviews.start(DIFF)["review_id"] for _ in range(2))
    now[0] = 1.0
    reviews.findings(a)
    c = reviews.start(DIFF)["review_id"]
    assert set(reviews.sessions) == {a, c}
    now[0] = 10.5
    reviews.findings(a)
    now[0] = 12.0
    with pytest.raises(UnknownReview):
        reviews.findings(c)
    with pytest.raises(UnknownReview):
        reviews.findings(b)
    with pytest.raises(ValueError):
        reviews.start("x" * (review.MAX_DIFF_BYTES + 1))
    assert file_patch(DIFF, "x") is None


def test_rules_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(patterns, "TOGETHER", 3)
    added = spark.createDataFrame([(1, "p", n, f"line w{n} end") for n in range(20)], "diff_id int, path string, line_no int, text string")
    rules = spark.createDataFrame([(n, f"u{n}", f"l{n}", None, f"w{n}\\b") for n in range(11)], "rule_seq int, rule_uri string, label string, priority string, pattern string")
    assert sorted((r.rule_seq, r.line_no) for r in review.matches(added, rules).collect()) == [(n, n) for n in range(11)]


def test_writes_keep_the_contract_and_what_was_read(tmp_path):
    root = str(tmp_path)
    for concept, front, body, ids in (("styleguide/x", {}, "b", "STG-1, STG-3"), ("styleguide/x", {"type": "Note", "description": "d"}, "b", "STG-2"), ("skill/s", {"type": "Skill"}, "", "SKL-4, SKL-5"), ("skill/s/s", {"type": "x", "description": "d"}, "b", "SKL-3"), ("document/d", {"type": " "}, "b", "DOC-1")):
        with pytest.raises(bundle.ContractViolation, match=ids):
            bundle.write_concept(root, concept, front, body)
    assert not list(tmp_path.iterdir())
    tracker = bundle.ReadTracker()
    path = bundle.write_concept(root, "memory/m", {}, "one", tracker=tracker)
    bundle.write_concept(root, "memory/m", {}, "two", tracker=tracker)
    with open(path, "a") as f:
        f.write("by hand")
    import os

    os.utime(path, ns=(1, 1))
    with pytest.raises(bundle.StaleRead):
        bundle.write_concept(root, "memory/m", {}, "three", tracker=tracker)
    tracker.record(path)
    bundle.write_concept(root, "memory/m", {}, "three", tracker=tracker)
    with pytest.raises(bundle.StaleRead):
        bundle.write_concept(root, "memory/m", {}, "four", tracker=bundle.ReadTracker())
    bundle.write_concept(root, "skill/s/s", {"type": "Skill", "description": "d"}, "b")
    with pytest.raises(bundle.ContractViolation):
        bundle.delete_concept(root, "skill/s/s")
    bundle.delete_concept(root, "memory/m")
    assert (tmp_path / "memory").is_dir() and not (tmp_path / "memory" / "m.md").exists()


def test_skill_folders_need_an_entry(spark):
    rows = [("skill/a", True), ("skill/a/a.md", False), ("skill/b", True), ("skill/b/other.md", False), ("document", True)]
    paths = validation.with_entries(spark.createDataFrame(rows, "concept_id string, is_folder boolean"))
    found = validation.violations(paths, validation.path_contracts("book.md", entries=True)).collect()
    assert [(r.concept_id, r.requirement) for r in found if r.requirement == "SKL-2"] == [("skill/b", "SKL-2")]


def test_git_status(tmp_path):
    assert git.status(str(tmp_path))["state"] == "no repository"
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    assert git.status(str(tmp_path))["state"] == "clean"
    (tmp_path / "sub").mkdir()
    for n in range(60):
        (tmp_path / "sub" / f"f{n}").write_text("x")
    (tmp_path / "top").write_text("x")
    run("add", ".")
    got = git.status(str(tmp_path / "sub"))
    assert got["state"] == "changed" and len(got["entries"]) == 50 and got["more"] == 10
    assert git.status(str(tmp_path / "top"))["entries"] == ["A  top"]


def test_rule_files_and_bundle_hashes(spark):
    files = spark.createDataFrame([("a.yaml", "- id: x\n  pattern: [p, q]\n"), ("b.yaml", "rules: [{description: d}]"), ("c.yaml", "{"), ("d.yaml", None)], "path string, content string")
    got = packages.import_rule_files(files).collect()
    assert {(r.path, r.concept_id, r.pattern, r.error is not None) for r in got} == {("a.yaml", "styleguide/any/general/x", "p\nq", False), ("b.yaml", None, None, True), ("c.yaml", None, None, True)}
    import hashlib

    rows = [("b", f"p{n}", f"h{n}") for n in range(3000)] + [("c", "only", "h")]
    hashes = {r.book: r.bundle_hash for r in catalog.bundle_hash(spark.createDataFrame(rows, "book string, path string, hash string").repartition(5), "p7").collect()}
    said = "".join(f"{p}\n{h}\n" for _, p, h in sorted(rows[:-1], key=lambda r: (r[1] != "p7", r[1])))
    assert hashes == {"b": hashlib.sha256(said.encode()).hexdigest(), "c": hashlib.sha256(b"only\nh\n").hexdigest()}
    assert catalog.bundle_hash(spark.createDataFrame([], "book string, path string, hash string"), "m").count() == 0
