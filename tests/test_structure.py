import ast
import random
import time

import duckdb
import pytest

from folio.operators.code import structure, symbols, trees
from folio.plans.oracle import ORACLE_SQL
from folio.plans.queries import QUERIES
from tests.oracle import compare

RUST = "fn main() {\n    // store(a, 1)\n    let x = store(a.b(1)?, vec![1, 2]);\n    store(\n        \"store(q, r)\",\n    );\n    if x == y && store(z, store(k, 2)) == 3 { let v = store; }\n}\n"


def found(content, pattern, language):
    return [m[2] for m in trees.search(content, pattern, language)]


def test_calls_in_rust():
    assert found(RUST, "store($X, $$$REST)", "rust") == ["store(a.b(1)?, vec![1, 2])", 'store(\n        "store(q, r)",\n    )', "store(z, store(k, 2))", "store(k, 2)"]
    assert found(RUST, "store($X, $Y)", "rust") == ["store(a.b(1)?, vec![1, 2])", "store(z, store(k, 2))", "store(k, 2)"]
    assert trees.search(RUST, "store($X)", "rust") == [(4, 6, 'store(\n        "store(q, r)",\n    )')]
    assert found(RUST, "let $N = $V;", "rust") == ["let x = store(a.b(1)?, vec![1, 2]);", "let v = store;"]
    assert found(RUST, "fn $N($$$A) { $$$B }", "rust") == [RUST.strip()]


def test_operators_bind_by_rank():
    code = "if (!a.b(1)[2] == c + 1 && d == e.f || g) { return h == -i; }\n"
    assert found(code, "$A == $B", "typescript") == ["!a.b(1)[2] == c + 1", "d == e.f", "h == -i"]
    assert found(code, "$A && $B", "typescript") == ["!a.b(1)[2] == c + 1 && d == e.f"]
    assert found(code, "return $X", "typescript") == ["return h == -i"]
    assert found(code, "$O.$M", "typescript") == ["a.b", "e.f"]
    assert found("x = a + b * c - d;", "$A * $B", "java") == ["b * c"]


def test_chains_and_lines():
    assert found("f(p).g(p).h(q)\n", "$F(p)", "typescript") == ["f(p)", "f(p).g(p)"]
    go = "func f() {\n\tx := g(a,\n\t\tb)\n\ty := x +\n\t\t1\n\tz = append(z, y)\n}\n"
    assert found(go, "$N := $V", "go") == ["x := g(a,\n\t\tb)", "y := x +\n\t\t1"]
    assert found(go, "$X = append($X, $Y)", "go") == ["z = append(z, y)"]
    assert found(go, "$X = append($Y, $X)", "go") == []
    assert found("m.Lock()\ndefer m.Unlock()\n", "$M.Lock()\ndefer $M.Unlock()", "go") == ["m.Lock()\ndefer m.Unlock()"]


def test_what_is_no_pattern():
    for pattern in ("$X", "", "f(", "$$$A $B"):
        with pytest.raises(ValueError):
            trees.Pattern(pattern, "rust")
    with pytest.raises(ValueError):
        trees.Pattern("f($X)", "no such")
    with pytest.raises(ValueError):
        trees.check_template("f($X)", "rust", "g($Y)")
    assert found("", "f($X)", "rust") == [] and found("f(", "f($X)", "rust") == [] and found("f())", "f()", "rust") == ["f()"]


def test_rewriting():
    assert trees.rewrite("a(b, c(d, e)); // b, c\na(1,2)", "a($X, $Y)", "z($Y, $X)", "c") == ("z(c(d, e), b); // b, c\nz(2, 1)", False)
    assert trees.rewrite("f(f(1))", "f($X)", "g($X)", "go") == ("g(f(1))", False)
    assert trees.rewrite("log(a, b, c)", "log($X, $$$R)", "log([$$$R], $X)", "go") == ("log([b, c], a)", False)
    assert trees.rewrite("f(1)", "f($X)", "g($X", "go") == ("f(1)", True)  # a new fault
    assert trees.rewrite("f(1) }", "f($X)", "g($X)", "go") == ("g(1) }", False)  # an old one


def test_large_levels_end():
    many = "f(" + ", ".join(f"a{i}" for i in range(30_000)) + ");\n"
    started = time.monotonic()
    assert found(many, "f($$$A, missing, $$$B, $C)", "rust") == []
    assert found(many + "missing", "f($$$A, a29999, $$$B)", "rust") == [many[:-2]]
    deep = "(" * 20_000 + "x" + ")" * 20_000
    assert found(f"f{deep}", "f($X)", "rust") == [f"f{deep}"]
    assert found(f"{{ f(1); {many * 3} g(2) }}", "{ f($X); $$$R h($Y) }", "rust") == []
    assert found("a " * 50_000 + "(b)", "a $$$R b", "rust") == [] and found("a + " * 50_000 + "(b)", "a $X b", "rust") == []
    assert time.monotonic() - started < 60


def test_files(spark):
    files = spark.createDataFrame([("a.rs", RUST), ("b.ts", RUST), ("c", RUST), ("d.rs", None), ("e.rs", "")], "path string, content string")
    assert {(r.path, r.line_start, r.line_end) for r in structure.search_files(files, "store($X)", "rust").collect()} == {("a.rs", 4, 6)}
    assert {r.path: r.changed for r in structure.rewrite_files(files, "store($X)", "keep($X)", "rust").collect()} == {"a.rs": True, "b.ts": False, "c": False, "e.rs": False}
    after = {r.path: r.content for r in structure.rewritten_files(files, "store($X)", "keep($X)", "rust").collect()}
    assert after["a.rs"] == RUST.replace('store(\n        "store(q, r)",\n    )', 'keep("store(q, r)")') and after["b.ts"] == RUST and after["e.rs"] == ""
    both = structure.search_each(files, [("store($X)", "rust"), ("$A == $B", "rust"), ("$A == $B", "typescript")])
    assert sorted((r.path, r.pattern, r.line_start) for r in both.collect()) == [("a.rs", "$A == $B", 7), ("a.rs", "$A == $B", 7), ("a.rs", "store($X)", 4), ("b.ts", "$A == $B", 7), ("b.ts", "$A == $B", 7)]


def test_files_of_any_size(spark, monkeypatch):
    """A file over a million characters is matched and rewritten as others are, in Python and by tokens."""
    many = 40_000
    sources = [("a.rs", "store(a, 1); // store(b, 2)\n" * many), ("b.py", "store(a, 1)  # store(b, 2)\n" * many), ("c.rs", "store(a, 1);\n")]
    assert all(len(content) > 1_000_000 for _, content in sources[:2])
    files = spark.createDataFrame(sources, "path string, content string").coalesce(1)
    monkeypatch.setattr(symbols, "BATCH_CHARS", 500_000)  # handed on in several batches
    for path, content, language in ((*sources[0], "rust"), (*sources[1], "python")):
        assert structure.search_files(files.where(f"path = '{path}'"), "store($X, $Y)", language).count() == many
        after = {r.path: r for r in structure.rewritten_files(files, "store($X, $Y)", "keep($Y)", language).collect()}
        assert len(after) == 3 and not any(r.error_introduced for r in after.values())
        assert after[path].changed and after[path].content == content.replace("store(a, 1)", "keep(1)")
        other = next(p for p, _ in sources[:2] if p != path)
        assert not after[other].changed and after[other].content == dict(sources)[other]


def test_sources_of_nodes_are_as_asts():
    for code in ("a = 'é'\r\nb = (1,\r\n 2)\rc = '''x\ny'''\n", "x = 1 \x0c\ny = f(\n'ü', a)\n", "", "f(é)"):
        of = structure._segments(code)
        assert all(of(n) == ast.get_source_segment(code, n) for n in ast.walk(ast.parse(code)))


@pytest.mark.parametrize("name", ["structure_rewrite", "structure_search"])
def test_large_documents_against_duckdb(spark, tmp_path, name):
    """Documents whose files have more than a million characters give what the SQL gives."""
    rows = [(k, "\n".join(f"word{i} of {k} and more" for i in range(n)), "en", "a", 0) for k, n in enumerate((9000, 10_000, 20, 15_000))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare(spark, con, str(tmp_path), QUERIES[name], ORACLE_SQL[name])


class Forgetful(set):
    def __contains__(self, _):
        return False


def test_what_is_remembered_changes_nothing(monkeypatch):
    r, own = random.Random(5), trees._Run.__init__

    def forgetful(self, *a):
        own(self, *a)
        self.failed = Forgetful()

    patterns = ["a $$$R b", "f($X, $Y)", "f($$$A, $X, $$$B)", "$X + $X", "$X = $Y", "a $X b $$$R a", "f($X, $$$R, $X)", "$A.b($$$R)", "{ $$$A f($X) $$$B }"]
    for n in range(600):
        code = " ".join(r.choice(["a", "b", "f", "(", ")", "{", "}", ",", ";", "+", "=", ".", "\n"]) for _ in range(r.randrange(4, 26)))
        pattern, language = patterns[n % len(patterns)], ("go", "rust")[n % 2]
        got = found(code, pattern, language)
        with monkeypatch.context() as m:
            m.setattr(trees._Run, "__init__", forgetful)
            assert got == found(code, pattern, language), (code, pattern)


@pytest.mark.parametrize("language", ["rust", "typescript", "go", "kotlin", "c", "ruby"])
def test_faults_are_counted_without_tokens(language):
    """As many as tokens() finds, and its stretches go by brackets, commas and semicolons."""
    rng = random.Random(7)
    signs = ["b", "r", 'r"', 'r#"', '"#', '"', "'", "`", "//", "/", "/*", "*/", "<<", "<<EOT\n", "EOT\n", "\n", " ", "x1", "1b", "(", ")", "[", "]", "{", "}", ",", ";", "==", "=", "\\", "#", "--"]
    for _ in range(2000):
        code = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        got = trees.tokens(code, language)
        assert [code[a:b] for a, b in zip(got.starts, got.ends, strict=True)] == got.texts
        assert trees.fault_count(code, language) == got.faults
        now, last, outer, want = 0, 0, [], []
        for n, text in enumerate(got.texts):
            if text in ("(", "[", "{"):
                want.append(now)
                outer.append(now)
                now = last = last + 1
                continue
            if text in (",", ";"):
                now = last = last + 1
            elif 0 <= got.partner[n] < n:
                now = outer.pop()
            want.append(now)
        assert got.stretch == want
