import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.operators.code import symbols
from folio.operators.code.lexer import SYNTAX, Blocks, blanked


@given(st.sampled_from(sorted(SYNTAX)), st.text(alphabet="ab{}()[]'\"`/*#-\\\n $<>=;@~", max_size=120))
@settings(max_examples=600, deadline=None)
def test_places_stay(language, text):
    code = blanked(text, language)
    assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert all(a in (b, " ", "\0") for a, b in zip(code, text, strict=True))
    blocks = Blocks(code, language)
    assert all(row <= blocks.end_row(row, blocks.starts[row]) < len(blocks.starts) for row in range(len(blocks.starts)))
    symbols.pattern_symbols(text, language)


HIDING = {
    "rust": ['// }', '/* } /* { */ } */', 'let s = "} {";', 'let r = r#"} " {"#;', "let c = '}';", "fn_like::<'a>('{');"],
    "typescript": ["// }", "/* } */", "const s = `} ${'{'} {`;", "const r = /[}/]{2}/g;", "const q = '}';"],
    "java": ["// }", "/* } */", 'String s = "}";', "char c = '}';", 'String t = """\n } {\n""";'],
    "c": ["// }", "/* } { */", 'char *s = "}\\"}";', "char c = '{';"],
    "cpp": ["// }", 'auto s = R"x(} " {)x";', "char c = '}';"],
    "csharp": ["// }", 'var s = @"} "" {";', 'var t = $"{{ }} }";'],
    "php": ["// }", "# }", "$s = '}';", "$h = <<<TXT\n } {\nTXT;"],
    "go": ["// }", "s := `} {`", 'x := "}"', "r := '}'"],
    "kotlin": ["// }", "/* } /* */ } */", 'val s = "}"', 'val t = """ } { """'],
    "zig": ["// }", 'const s = "}";', "const m = \\\\ } {"],
    "bash": ["# }", "echo '}'", 'echo "} {"', "cat <<EOF\n } {\nEOF"],
    "ruby": ["# end", "x = 'end'", 'y = "if"', "z = <<~T\n  end\n  end\nT", "if a\nend", "while b do\nend", "c.each do |d|\nend", "e = 1 if f"],
    "lua": ["-- end", "--[[ end\n end ]]", "local s = 'end'", "if a then b() elseif c then d() else e() end", "for i = 1, 2 do f() end", "local t = [[ end ]]"],
    "elixir": ["# end", 'x = "end do"', "if a do\nend", "y = fn z -> z end", "if b, do: c"],
    "fish": ["# end", "echo 'end'", "if a\nend", "switch b\ncase c\nend"],
    "gdscript": ["# func x():", 'var s = "func y():"', "if a:\n\t\tpass", "var t = \"\"\"\nfunc z():\n\"\"\""],
}
SHAPE = {
    "rust": ("fn {n}(a: u32) {", "}"), "typescript": ("function {n}(a) {", "}"), "java": ("class {n} {", "}"), "c": ("int {n}(int a) {", "}"), "cpp": ("int {n}(int a) {", "}"), "csharp": ("class {n} {", "}"), "php": ("function {n}($a) {", "}"),
    "go": ("func {n}(a int) {", "}"), "kotlin": ("fun {n}(a: Int) {", "}"), "zig": ("fn {n}(a: u8) void {", "}"), "bash": ("{n}() {", "}"), "ruby": ("def {n}(a)", "end"), "lua": ("function {n}(a)", "end"), "elixir": ("def {n}(a) do", "end"), "fish": ("function {n}", "end"), "gdscript": ("func {n}(a):", "\tpass"),
}


@pytest.mark.parametrize("language", sorted(HIDING))
def test_made_functions_are_found_where_they_were_put(language):
    """Bodies of what would close or open a block elsewhere."""
    rng = random.Random(language)
    extension = next(e for e, name in symbols.EXTENSIONS.items() if name == language)
    for _ in range(12):
        text, want = "", []
        for n in range(rng.randrange(1, 6)):
            head, tail = SHAPE[language]
            indent = "\t" if language == "gdscript" else "  "
            body = [indent + line if not line.startswith((" }", "EOF", "TXT", "T")) and "\n" not in line else line if language != "gdscript" else indent + line for line in rng.sample(HIDING[language], rng.randrange(1, len(HIDING[language])))]
            start = text.count("\n") + 1
            text += "\n".join([head.replace("{n}", f"name{n}"), *body, tail]) + "\n"
            end = text.count("\n")
            want.append((f"name{n}", start, end))
            text += rng.choice(["", "\n", "\n\n"])
        got = [(s.name, s.start, s.end) for s in symbols.symbols_of(f"a.{extension}", text) if s.name.startswith("name")]
        assert got == want, text


def found(path, text):
    return [(s.name, s.kind, s.start, s.end, s.scope) for s in symbols.symbols_of(path, text)]


def test_members_and_other_languages():
    assert found("a.rs", "pub enum E {\n    A,\n    B(u8),\n    C { x: u8 },\n}\n")[1:] == [("A", "variant", 2, 2, "E"), ("B", "variant", 3, 3, "E"), ("C", "variant", 4, 4, "E")]
    assert found("a.rs", "struct S {\n    pub a: Vec<u8>,\n}\nimpl S {\n    fn f(&self) {\n        let x: u8 = 1;\n    }\n}\n")[1:] == [("a", "field", 2, 2, "S"), ("S", "impl", 4, 8, ""), ("f", "method", 5, 7, "S")]
    assert found("a.ts", "class A {\n  private x: number = 1;\n  get y(): number {\n    return this.x;\n  }\n}\n")[1:] == [("x", "field", 2, 2, "A"), ("y", "method", 3, 5, "A")]
    assert found("a.sql", "CREATE TABLE t (\n  a int, -- b int,\n  \"c d\" text,\n  PRIMARY KEY (a)\n);\n") == [("t", "table", 1, 5, ""), ("a", "field", 2, 2, "t"), ("c d", "field", 3, 3, "t")]
    assert [x[:4] for x in found("a.css", ".a > b {\n  color: red;\n}\n/* .no { } */\n@media x {\n  #c {\n  }\n}\n")] == [(".a > b", "class", 1, 3), ("#c", "class", 6, 7)]
    assert [x[:2] for x in found("a.nix", "{\n  a.b = 1; # c = 2;\n  d = ''\n    e = 3;\n  '';\n}\n")] == [("a.b", "variable"), ("d", "variable")]
    assert [x[:4] for x in found("a.gleam", "pub fn f(x) {\n  \"}\"\n}\npub type T {\n}\nconst c = 1\n")] == [("f", "function", 1, 3), ("T", "type", 4, 5), ("c", "const", 6, 6)]
    assert [x[:4] for x in found("a.m", "@interface A : B\n- (void)go;\n@end\n")] == [("A", "class", 1, 3), ("go", "method", 2, 2)]
    assert [x[:4] for x in found("a.bzl", "def f(x):\n    return 1\n\ndef g():\n    pass\n")] == [("f", "function", 1, 2), ("g", "function", 4, 5)]
    assert [x[:4] for x in found("a.tscn", "[node name=\"[x]\"]\nk = 1\n\n[sub]\n")] == [("node", "class", 1, 2), ("sub", "class", 4, 4)]
    assert symbols.calls_of("a.go", "// no(\nf(\"no(\")\n") == [("f", 2)]


def test_keys():
    yaml = "a: 1\nb:\n  - c: x\n    d: |\n      e: no\n\n  - f\n'q r':\n  \"s.t\": [1,\n    2]\n# g: no\nh: {i: 1}\n---\nj:\n"
    assert [(x[0], *x[2:]) for x in found("a.yaml", yaml)] == [("a", 1, 1, ""), ("b", 2, 7, ""), ("c", 3, 3, "b"), ("d", 4, 5, "b"), ("q r", 8, 10, ""), ("s.t", 9, 10, "q r"), ("h", 12, 12, ""), ("j", 14, 14, "")]
    toml = "x = 1\n[a.\"b c\"]\ny = '''\n[no]\nz = 1\n'''\n\n[[d]]\ne.f = {g = 1}\n"
    assert found("a.toml", toml) == [("x", "key", 1, 1, ""), ("a.b c", "table", 2, 6, ""), ("y", "key", 3, 6, "a.b c"), ("d", "table", 8, 9, ""), ("e.f", "key", 9, 9, "d")]


def test_odd_files():
    for language in SYNTAX:
        extension = next((e for e, name in symbols.EXTENSIONS.items() if name == language), "x")
        for text in ("", "\n", "{" * 50, "}" * 50, "\"", "'", "/*", "end\n" * 20):
            symbols.symbols_of(f"a.{extension}", text)
    assert symbols.symbols_of("a.yaml", "") == [] and symbols.symbols_of("a.toml", "[") == []


def test_blanking_keeps_every_place():
    """Hidden stretches of one row and of several: as long as before, with the line ends where they were."""
    from folio.operators.code.lexer import blanked

    for language, code in (("go", 'a "b\tc" /* d\r\ne\n*/ f // g\nh `i\rj`'), ("gdscript", 'a = "b" # c\nd = """e\nf"""\n'), ("ruby", "a 'b\nc' # d\n")):
        got = blanked(code, language)
        assert len(got) == len(code) and [c for c in got if c in "\r\n"] == [c for c in code if c in "\r\n"]
        assert all(x == y or x in " \0" for x, y in zip(got, code, strict=True)) and "b" not in got
    assert "\0" in blanked('a = "b"\n', "gdscript") and "\0" not in blanked("# b\n", "gdscript")
