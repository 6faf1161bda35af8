import random

import pytest

from folio.operators import merkle


def tree(spark, rows):
    return spark.createDataFrame(rows, "path string, hash string, folder int").repartition(3)


def brute(a, b):
    def one(rows):
        out = {}
        for p, h, _ in rows:
            if p is not None:
                out.setdefault(p, []).append(h)
        return {p: min((h for h in hs if h is not None), default=None) for p, hs in out.items()}

    a, b = one(a), one(b)
    return {(p, "added" if p not in a else "removed" if p not in b else "changed") for p in a | b if p not in a or p not in b or a[p] != b[p]}


def made(seed):
    r = random.Random(seed)
    a = [(f"{r.choice('abc')}/{r.choice('de')}/{r.randrange(9)}/f{n}", f"h{r.randrange(5)}", n) for n in range(200)]
    a += [("top", "x", 0), ("a/odd  name/f", None, 1), ("a//f", "y", 2), (None, "z", 3)]
    b = [(p, "new" if n % 40 == 7 else h, n) for p, h, n in a if n % 31]
    return a, [*b, ("new/deep/er/f1", "1", 0), ("new/deep/f2", "2", 1)]


def test_changes_equal_brute_force(spark, monkeypatch):
    a, b = made(1)
    for bound in (50_000, 0):
        monkeypatch.setattr(merkle, "BROADCAST_FOLDERS", bound)
        assert {tuple(r) for r in merkle.changes(tree(spark, a), tree(spark, b)).collect()} == brute(a, b)


def test_repeated_paths_null_hashes_and_empty_trees(spark):
    a, b = [("a/x", "1", 0), ("a/x", "1", 0), ("a/y", None, 1), ("b/z", "2", 2)], [("a/x", "1", 0), ("a/y", "", 1), ("b/z", "2", 2)]
    assert {tuple(r) for r in merkle.changes(tree(spark, a), tree(spark, b)).collect()} == {("a/y", "changed")}
    assert {r.change for r in merkle.changes(tree(spark, []), tree(spark, a)).collect()} == {"added"}
    assert merkle.changes(tree(spark, []), tree(spark, [])).count() == 0 and merkle.folders(tree(spark, [])).count() == 0
    assert merkle.changes(tree(spark, a), tree(spark, a)).count() == 0


def test_folders_and_topmost(spark):
    a, b = made(2)
    one, two = merkle.folders(tree(spark, a)), merkle.folders(tree(spark, b))
    got = {r.folder: r for r in one.collect()}
    assert got[""].files == 203 and got[""].own_files == 1 and got[""].depth == 0
    assert got["a"].files == sum(p is not None and p.startswith("a/") for p, _, _ in a) and got["a"].own_digest is None
    compared = merkle.compare(one, two)
    assert {(r.folder, r.change, r.files_after) for r in merkle.topmost(compared).where("change = 'added'").collect()} == {("new", "added", 2)}
    equal = {r.folder for r in compared.where("change = 'same'").collect()}
    assert equal and not any(p.startswith(f"{f}/") for p, _ in brute(a, b) for f in equal)
    assert merkle.open_files(tree(spark, a), compared).count() < 203


@pytest.mark.parametrize("path, folder", [("a/b/c", "a/b"), ("a", ""), ("/a", ""), ("a/", "a")])
def test_folder_of(spark, path, folder):
    from pyspark.sql import functions as F

    assert spark.range(1).select(merkle.folder_of(F.lit(path))).first()[0] == folder


def test_update_counts(spark):
    from folio.operators import catalog

    schema = "name string, path string, hash string"
    before = spark.createDataFrame([("a/b c", "x/1", "1"), ("a/b c", "x/2", "2"), ("same", "y", "1"), ("gone", "z", "1"), (None, "q", "1")], schema)
    after = spark.createDataFrame([("a/b c", "x/1", "9"), ("a/b c", "x/3", "2"), ("a/b c", "w", "2"), ("same", "y", "1")], schema)
    plan = spark.createDataFrame([("a/b c", True), ("same", False), ("gone", True), ("new", True), (None, True)], "name string, wanted boolean")
    got = {r.name: (r.wanted, r.added, r.changed, r.removed) for r in catalog.update_counts(plan, before, after).collect()}
    assert got == {"a/b c": (True, 2, 1, 1), "same": (False, 0, 0, 0), "gone": (True, 0, 0, 1), "new": (True, 0, 0, 0), None: (True, 0, 0, 0)}
