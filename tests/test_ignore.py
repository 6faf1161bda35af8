import random
import subprocess

import pytest

from folio.functions import ignore
from folio.sources import packages

NAMES = ["a", "b", "ab", "a.py", "b.txt", "x y", "build", "[a]", "!a", "#a", "é.py"]
PATTERNS = ["a", "*.py", "/a", "a/", "a/b", "**/b", "a/**", "a/**/b", "!a", "!*.py", "[ab]", "[!a]*", "?", "\\\\!a", "\\\\#a", "# no", "", "  ", "x y", "x\\\\ y", "build/", "!build/", "/**/a.py", "*", "!*/", "a*b", "**", "b/*", "[a", "**/", "a b  ", "/*", "[[:alpha:]]", "\\\\[a]"]


def trees():
    rng = random.Random(11)
    for _ in range(40):
        files = [("/".join(rng.choice(NAMES[:8]) for _ in range(rng.randrange(0, 3))), [p.replace("\\\\", "\\") for p in rng.sample(PATTERNS, rng.randrange(1, 6))]) for _ in range(rng.randrange(1, 4))]
        paths = {"/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 5))) for _ in range(40)}
        yield {f"{d}/.gitignore".lstrip("/"): "\n".join(p) + "\n" for d, p in files}, sorted(paths)


def test_against_git(tmp_path):
    """Paths need not be there: git is asked about names; a rule file counts if no folder above it is ignored."""
    seen = 0
    for n, (files, paths) in enumerate(trees()):
        top = tmp_path / str(n)
        top.mkdir()
        subprocess.run(["git", "init", "-q", str(top)], check=True)
        for path, text in files.items():
            (top / path).parent.mkdir(parents=True, exist_ok=True)
            (top / path).write_text(text)
        paths = [p for p in paths if not (top / p).is_dir()]
        asked = "".join(f"{p}\0" for p in paths).encode()
        told = subprocess.run(["git", "-C", str(top), "check-ignore", "--no-index", "--stdin", "-z"], input=asked, capture_output=True).stdout.decode().split("\0")
        judge = ignore.Judge(ignore.rules_of(list(files.items())))
        assert {p for p in paths if judge.ignored(p)} == set(told) - {""}, files
        seen += len(told)
    assert seen > 100


@pytest.mark.parametrize(("pattern", "path", "fits"), [("a/**", "a/b/c", True), ("a/**", "a", False), ("**/b", "b", True), ("*.py", "x/y.py", True), ("/*.py", "x/y.py", False), ("a/b", "c/a/b", False)])
def test_patterns(pattern, path, fits):
    assert ignore.Judge(ignore.parse(pattern)).ignored(path) == fits


def test_a_tree_outside_git(spark, tmp_path):
    for path, text in {".gitignore": "*.rs\n!keep.rs\nout/\n", "a.py": "x = 1", "b.rs": "", "keep.rs": "fn f() {}", "out/c.py": "", "sub/.gitignore": "/d.py\n", "sub/d.py": "", "sub/e.py": "y = 2", "sub/deep/d.py": "z = 3"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert {r.path for r in packages.read_sources(spark, str(tmp_path)).collect()} == {"a.py", "keep.rs", "sub/e.py", "sub/deep/d.py"}
    rows = spark.createDataFrame([("a.rs", 1), (None, 2)], "path string, ignored int")
    got = ignore.with_ignored(rows, ignore.parse("*.rs")).collect()
    assert {(r.path, r.ignored) for r in got} == {("a.rs", True), (None, None)}
