import hashlib
import json

import pytest

from folio.operators import assistant, catalog, evaluation, memo
from folio.operators.code import outline
from folio.sources import bundle


def test_project_catalogue(spark, tmp_path):
    path_hash = hashlib.sha256(b"/home/a").hexdigest()[:8]
    projects = spark.createDataFrame([(f"a-{path_hash}", "/home/a", True), ("b-deadbeef", "/gone", False), ("c-0123abcd", None, None)], "slug string, root string, root_exists boolean")
    a = f"a-{path_hash}"
    books = spark.createDataFrame([(a, "own", "1.0.0", "/s/a/own", True), (a, "shared", "2.0.0", "/s/a/shared", False), (None, "shared", "2.0.0", "/g/shared", False), (None, "all", "1.0.0", "/g/all", False)], "slug string, name string, version string, root string, writable boolean")
    concepts = spark.createDataFrame([("/s/a/own", "document", "document/x"), ("/s/a/own", "skill", "skill/s"), ("/s/a/shared", "document", "document/y"), ("/g/shared", "document", "document/y"), ("/g/all", "document", "document/x"), ("/g/all", "custom", "custom/z")], "root string, namespace string, concept_id string")
    found = catalog.project_catalog(projects, books, concepts)
    got = {r.slug: r for r in found.collect()}
    assert [b.root for b in got[a].books] == ["/g/all", "/s/a/own", "/s/a/shared"] and [b.root for b in got["c-0123abcd"].books] == ["/g/all", "/g/shared"]
    assert (got[a].document, got[a].skill, got[a].other, got[a].duplicate_ids) == (3, 1, 1, 1)
    assert (got["b-deadbeef"].document, got["b-deadbeef"].duplicate_ids) == (2, 0)
    assert {s: (r.stale, r.hash) for s, r in got.items()} == {a: (False, path_hash), "b-deadbeef": (True, ""), "c-0123abcd": (False, "0123abcd")}
    text = catalog.render_projects(list(got.values()))
    assert "## b-deadbeef (stale)" in text and "- own 1.0.0: `/s/a/own`" in text and "not recorded" in text
    catalog.write_catalog(found, str(tmp_path / "c"))
    lines = [json.loads(x) for f in (tmp_path / "c").glob("part*") for x in f.read_text().splitlines()]
    assert {x["slug"] for x in lines} == set(got)
    nothing = catalog.project_catalog(projects, books.limit(0), concepts)
    assert all(r.books == [] and r.document == 0 for r in nothing.collect())


def test_open_book(spark, tmp_path):
    def book(name, text):
        (tmp_path / name).mkdir()
        if text is not None:
            (tmp_path / name / bundle.MANIFEST).write_text(text)
        (tmp_path / name / "document").mkdir()
        (tmp_path / name / "document" / "a.md").write_text("---\ntype: Note\n---\nbody")
        return str(tmp_path / name)

    manifest, concepts = bundle.open_book(spark, book("good", "---\ntype: Book\nname: acme\nversion: 1.2.0\ntags: [x]\n---\n"))
    assert manifest == {"name": "acme", "version": "1.2.0", "description": None, "tags": ["x"]}
    assert {(r.book, r.concept_id) for r in concepts.where("namespace = 'document'").collect()} == {("acme", "document/a")}
    for n, (text, said) in enumerate([(None, "STR-2"), ("no frontmatter", "STR-4"), ("---\ntype: Note\nname: x\n---\n", "STR-5"), ("---\ntype: Book\n---\n", "STR-5"), ("---\ntype: Book\nname: x\nversion: one\n---\n", "STR-5"), ("---\nunclosed", "STR-4")]):
        with pytest.raises(bundle.NotABook, match=said):
            bundle.open_book(spark, book(f"bad{n}", text))
    linked = book("linked", None)
    (tmp_path / "linked" / bundle.MANIFEST).symlink_to(tmp_path / "good" / bundle.MANIFEST)
    for path in (linked, str(tmp_path / "nowhere")):
        with pytest.raises(bundle.NotABook):
            bundle.open_book(spark, path)


def test_dataset_files(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"k": [1, 5], "queries": [{"query": "a", "expected": ["x", "y"], "absent": ["z"]}, {"query": "b", "expected": ["x"]}]}))
    settings, expected, absent = evaluation.load_dataset(spark, str(path))
    assert settings == {"k": [1, 5], "absent_window": None, "min": None}
    assert sorted(map(tuple, expected.collect())) == [("a", "x"), ("a", "y"), ("b", "x")] and list(map(tuple, absent.collect())) == [("a", "z")]
    path.write_text('{"k": [1], "queries": [{"query": "a", "expected": ["x"]}], "more": 1}')
    with pytest.raises(ValueError):
        evaluation.load_dataset(spark, str(path))


def test_nesting_by_scope(spark):
    rows = [("f", "A", 1, ""), ("f", "B", 2, "A"), ("f", "m", 3, "A.B"), ("f", "A", 10, ""), ("f", "n", 11, "A"), ("g", "n", 1, "A")]
    got = outline.nested(spark.createDataFrame(rows, "path string, name string, start_row int, scope string")).collect()
    assert {(r.path, r.name, r.start_row): r.parent_row for r in got} == {("f", "A", 1): None, ("f", "B", 2): 1, ("f", "m", 3): 2, ("f", "A", 10): None, ("f", "n", 11): 10, ("g", "n", 1): None}


def test_rule_listing(spark):
    rows = [("b", "styleguide/x/r1", "styleguide", "Rule", "d", "rust", "naming", None, 0), ("b", "styleguide/x/r2", "styleguide", "Rule", "d", None, "naming", "warn", 0), ("b", "styleguide/x/r3", "styleguide", "Rule", " ", "rust", None, None, 0), ("b", "styleguide/index", "styleguide", "Rule", "d", "rust", None, None, 0), ("b", "document/r", "document", "Rule", "d", "rust", None, None, 0), ("a", "styleguide/r0", "styleguide", "Rule", "d", "rust", "other", None, 1)]
    concepts = spark.createDataFrame(rows, "book string, concept_id string, namespace string, type string, description string, language string, category string, priority string, precedence int")
    ids = lambda **where: [r.concept_id for r in assistant.list_rules(concepts, **where).collect()]
    assert ids() == ["styleguide/x/r1", "styleguide/x/r2", "styleguide/r0"]
    assert ids(language="rust") == ["styleguide/x/r1", "styleguide/r0"] and ids(category="naming", language="rust") == ["styleguide/x/r1"]


def test_memo_keeps_what_is_unchanged(spark, tmp_path):
    made, dropped = [], []

    class Value:
        def __init__(self, n):
            self.n = n
            made.append(n)

        def drop(self):
            dropped.append(self.n)

    held = memo.Memo(2)
    assert held.get("a", 1, lambda: Value(1)) is held.get("a", 1, lambda: Value(9)) and made == [1]
    held.get("a", 2, lambda: Value(2))
    held.get("b", 1, lambda: Value(3))
    held.get("a", 2, lambda: Value(9))
    held.get("c", 1, lambda: Value(4))
    assert (made, dropped) == ([1, 2, 3, 4], [1, 3])
    table = memo.Table(spark.range(3).toDF("n"), "memo")
    assert table.df.count() == 3
    table.drop()
    (tmp_path / "x").write_text("one")
    read = lambda: memo.signature(spark.read.format("binaryFile").load(str(tmp_path)))
    first = read()
    assert read() == first and first[0] == 1
    (tmp_path / "x").write_text("two!")
    assert read() != first
