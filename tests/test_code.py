import pytest

from folio.operators import calls, graph
from folio.operators.code import conflicts, outline, structure, symbols

CODE = [
    ("pkg/app.py", "import os\n\nLIMIT = 3\n\n\nclass Store:\n    def load(self, path):\n        return read(path)\n\n    def save(self, path, data):\n        self.load(path)\n        write(path, data)\n\n\ndef read(path):\n    return os.open(path)\n\n\ndef write(path, data):\n    print(path, data)\n    if len(data) > LIMIT:\n        read(path)\n"),
    ("pkg/cli.py", "from pkg.app import Store, write\n\n\ndef main(argv):\n    Store().save(argv[0], argv[1])\n    write(argv[0], argv[1])\n"),
    ("src/lib.rs", "pub struct Node {\n    x: u32,\n}\n\nimpl Node {\n    pub fn new(x: u32) -> Self {\n        check(x);\n        Node { x }\n    }\n}\n\nfn check(x: u32) {}\n"),
    ("docs/a.md", "# Top\n\ntext\n\n## Part\n\n```\n# no heading\n```\n\n### Deep\n\n# Next\n"),
    ("web/x.ts", "export class View {\n}\n\nexport function draw(v: View) {\n  v.paint();\n}\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(CODE, "path string, content string")


def test_python_symbols():
    got = [(s.name, s.kind, s.start, s.end, s.scope) for s in symbols.symbols_of("a.py", dict(CODE)["pkg/app.py"])]
    assert got[:3] == [("Store", "class", 6, 12, ""), ("load", "method", 7, 8, "Store"), ("save", "method", 10, 12, "Store")]
    assert symbols.symbols_of("a.py", "def broken(") == [] and symbols.symbols_of("a.unknown", "x") == []


def test_pattern_languages():
    rust = {(s.name, s.kind, s.start, s.end, s.exported) for s in symbols.symbols_of("a.rs", dict(CODE)["src/lib.rs"])}
    assert {("Node", "struct", 1, 3, True), ("new", "method", 6, 9, True), ("check", "function", 12, 12, False)} <= rust
    go = symbols.symbols_of("a.go", "func Run(x int) {\n}\n\nfunc (s *S) stop() {\n}\ntype S struct {\n}\n")
    assert [(s.name, s.kind, s.exported) for s in go] == [("Run", "function", True), ("stop", "method", False), ("S", "type", True)]
    for path, text, name in (("a.java", "public class A {\n  public int size() {\n  }\n}\n", "size"), ("a.rb", "def go?\nend\n", "go?"), ("a.sql", "CREATE TABLE t (x int);", "t"), ("a.toml", "[tool.x]\ny = 1\n", "tool.x"), ("a.yaml", "key: 1\n", "key"), ("a.kt", "fun f() {}\n", "f")):
        assert name in [s.name for s in symbols.symbols_of(path, text)]


def test_headings():
    got = [(s.name, s.kind, s.start, s.end) for s in symbols.symbols_of("a.md", dict(CODE)["docs/a.md"])]
    assert got == [("Top", "h1", 1, 12), ("Part", "h2", 5, 12), ("Deep", "h3", 11, 12), ("Next", "h1", 13, 14)]
    assert [s.name for s in symbols.symbols_of("a.html", "<h1>A <b>b</b></h1>\n<h2>C</h2>")] == ["A b", "C"]


def test_calls_and_callers(files):
    found = symbols.extract_symbols(files)
    edges = calls.resolve(calls.calls_in_symbols(symbols.extract_calls(files), found), found)
    assert {r.caller for r in calls.callers(edges, "pkg/app.py", "read", 15).collect()} == {"Store", "load", "write"}
    assert {(r.caller, r.callee) for r in edges.where("path = 'src/lib.rs' AND callee_start IS NOT NULL").collect()} >= {("new", "check")}


def test_reachability_and_trees(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "source string")
    assert {(r.node, r.depth) for r in calls.reachable(edges, start).where("node <> 'a'").collect()} == {("b", 1), ("c", 2), ("d", 3)}
    tree = calls.call_tree(edges, start.toDF("node")).collect()
    assert {("".join(r.trail), r.is_cycle) for r in tree} == {("a", False), ("ab", False), ("abc", False), ("abca", True), ("abcd", False)}


def test_find_symbol(files):
    found = symbols.extract_symbols(files)
    assert [r.similar for r in calls.find_symbol(found, "read").collect()] == [False]
    assert {r["name"] for r in calls.find_symbol(found, "rea").collect()} == {"read"}


def test_outline_and_zoom(files):
    found = symbols.extract_symbols(files)
    parents = {(r["name"], r.kind): r.parent for r in outline.containment(found).where("path = 'pkg/app.py'").collect()}
    assert parents[("load", "method")] == "Store" and parents[("read", "function")] is None
    assert [r.line_no for r in outline.zoom(files, found, "pkg/app.py", "read", 0).orderBy("line_no").collect()] == [15, 16]
    with pytest.raises(outline.Ambiguous):
        outline.zoom(files, found, "src/lib.rs", "Node")
    assert outline.render(found.where("path = 'pkg/app.py'").collect()).splitlines()[1].startswith("  7-8 method")
    assert outline.render(found.collect(), 40).endswith("[cut]\n")


def test_structural_search():
    code = "f(a, 1)\nf(b, 2, k=3)\nif x:\n    g(f(c))\nx == x\nx == y\n"
    assert [m[2] for m in structure.search(code, "f($$$A)")] == ["f(a, 1)", "f(c)"]  # keywords are not in the pattern
    assert [m[2] for m in structure.search(code, "f($X, $Y)")] == ["f(a, 1)"]
    assert [m[2] for m in structure.search(code, "$X == $X")] == ["x == x"]
    assert structure.rewrite(code, "f($X, $Y)", "h($Y, $X)").startswith("h(1, a)\n")
    with pytest.raises(SyntaxError):
        structure.rewrite(code, "f($X, $Y)", "h($Y")
    assert structure.change_count("a\nb\n", "a\nc\n") == 2 and "-b" in structure.unified_diff("a\nb\n", "a\nc\n", "x")


CONFLICT = "top\r\n<<<<<<< HEAD\r\na\r\n||||||| base\r\no\r\n=======\r\nb\r\n>>>>>>> x\r\nend\r\n"


def test_conflicts():
    (c,) = conflicts.scan(CONFLICT)
    assert (c.start, c.end, c.ours, c.base, c.theirs) == (2, 8, ["a\r\n"], ["o\r\n"], ["b\r\n"])
    assert conflicts.resolve(CONFLICT, "ours") == ("top\r\na\r\nend\r\n", 1)
    assert conflicts.resolve(CONFLICT, "base")[0] == "top\r\nend\r\n" and conflicts.resolve(CONFLICT, "my\nown")[0] == "top\r\nmy\r\nown\r\nend\r\n"
    open_ = "<<<<<<< a\nx\n=======\ny\n"
    assert conflicts.scan(open_) == [] and conflicts.resolve(open_, "ours") == (open_, 0)
    two = CONFLICT * 2
    assert conflicts.resolve(two, "theirs", 2) == (CONFLICT + "top\r\nb\r\nend\r\n", 1)
    with pytest.raises(ValueError):
        conflicts.resolve(two, "ours", 3)


def test_edges_and_ranks(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, ident string")
    defs = rows(("a", "f"), ("b", "g"), ("b", "_p"), *((x, "many") for x in "abcdef"))
    refs = rows(("b", "f"), ("c", "f"), ("a", "f"), ("c", "g"), ("c", "_p"), ("a", "many"))
    edges = {(r.src, r.dst): r.weight for r in graph.reference_edges(defs, refs, ["g"]).collect()}
    assert edges == {("b", "a"): pytest.approx(3**0.5), ("c", "a"): pytest.approx(3**0.5), ("c", "b"): pytest.approx(10.1)}


def brute_rank(nodes, edges, seeds, rounds):
    n = len(nodes)
    bias = {x: (1 / len(seeds) if x in seeds else 0) if seeds else 1 / n for x in nodes}
    out = {x: sum(w for (s, _), w in edges.items() if s == x) for x in nodes}
    x = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        dangling = sum(x[v] for v in nodes if not out[v])
        y = {v: 0.15 / n + 0.85 * dangling / n + 0.15 * bias[v] + 0.85 * sum(x[s] * w / out[s] for (s, d), w in edges.items() if d == v) for v in nodes}
        moved, x = sum(abs(x[v] - y[v]) for v in nodes), y
        if moved < 1e-6:
            break
    return x


def test_pagerank(spark):
    edges = {("a", "b"): 1.0, ("b", "c"): 2.0, ("c", "a"): 1.0, ("a", "d"): 3.0}
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    frame = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double")
    for seeds in ([], ["a", "e"]):
        seed = spark.createDataFrame([(x,) for x in seeds], "node string")
        got = {r.node: r.score for r in graph.pagerank(nodes, frame, seed, rounds=12).collect()}
        assert got == pytest.approx(brute_rank("abcde", edges, seeds, 12))
    assert graph.pagerank(nodes.limit(0), frame.limit(0)).count() == 0


def test_rendered_map_fits():
    rows = [{"path": f"p{i % 3}", "line": i, "ident": f"name{i}"} for i in range(50)]
    assert len(graph.render_map(rows, 100).encode()) // 4 <= 85 and graph.render_map(rows[:1], 1).startswith("p0:")
    assert graph.render_map([], 10) == ""
