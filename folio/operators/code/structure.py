"""Structural search and rewriting by patterns with $NAME and $$$NAME, and text differences.

Python is matched by its own syntax trees, other languages by balanced tokens (trees.py). Files of any size are
matched."""

from __future__ import annotations

import ast
import difflib
import re
from typing import Any

from pyspark.sql import DataFrame

from folio.operators.code import trees
from folio.operators.code.symbols import _exploded, language_of

_ONE, _MANY = "__one_", "__many_"


def _parsed(pattern: str) -> ast.AST:
    text = re.sub(r"\$\$\$([A-Z_][A-Z0-9_]*)?", lambda m: _MANY + (m[1] or ""), pattern)
    text = re.sub(r"\$([A-Z_][A-Z0-9_]*)", lambda m: _ONE + m[1], text)
    body = ast.parse(text.strip()).body
    if len(body) != 1:
        raise ValueError("a pattern is one statement or expression")
    return body[0].value if isinstance(body[0], ast.Expr) else body[0]


def _hole(node: Any, mark: str) -> str | None:
    if isinstance(node, ast.Expr):
        node = node.value
    if isinstance(node, ast.arg):
        return node.arg[len(mark) :] if node.arg.startswith(mark) else None
    return node.id[len(mark) :] if isinstance(node, ast.Name) and node.id.startswith(mark) else None


def _same(pattern: Any, node: Any, held: dict[str, Any]) -> bool:
    if (name := _hole(pattern, _ONE)) is not None and isinstance(node, ast.AST):
        if name in held and name != "_":
            return ast.dump(held[name]) == ast.dump(node)
        held[name] = node
        return True
    if isinstance(pattern, str) and pattern.startswith(_ONE) and isinstance(node, str):
        return held.setdefault(pattern, node) == node
    if isinstance(pattern, list):
        return isinstance(node, list) and _same_list(pattern, node, held)
    if isinstance(pattern, ast.AST):
        return type(pattern) is type(node) and all(_same(getattr(pattern, f, None), getattr(node, f, None), held) for f in pattern._fields if f not in ("ctx", "type_comment", "kind", "type_params"))
    return pattern == node


def _same_list(patterns: list, nodes: list, held: dict[str, Any]) -> bool:
    if not patterns:
        return not nodes
    if (name := _hole(patterns[0], _MANY)) is not None:
        for n in range(len(nodes) + 1):
            trial = dict(held)
            if _same_list(patterns[1:], nodes[n:], trial):
                held.update(trial)
                if name:
                    held[name] = nodes[:n]
                return True
        return False
    trial = dict(held)
    if nodes and _same(patterns[0], nodes[0], trial) and _same_list(patterns[1:], nodes[1:], trial):
        held.update(trial)
        return True
    return False


def _segments(content: str):
    """Node -> its source, as ast.get_source_segment gives it; the lines are cut once for all nodes."""
    lines = [line.encode() for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", content)]

    def of(node: ast.AST) -> str | None:
        if getattr(node, "end_lineno", None) is None:
            return None
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return lines[a][node.col_offset : node.end_col_offset].decode()
        return b"".join([lines[a][node.col_offset :], *lines[a + 1 : b], lines[b][: node.end_col_offset]]).decode()

    return of


def search(content: str, pattern: str) -> list[tuple[int, int, str, dict[str, Any], ast.AST]]:
    """(first line, last line, source, what the holes hold, node) of each match."""
    wanted, out, segment = _parsed(pattern), [], _segments(content)
    for node in ast.walk(ast.parse(content)):
        held: dict[str, Any] = {}
        if hasattr(node, "lineno") and _same(wanted, node, held):
            out.append((node.lineno, node.end_lineno, segment(node), held, node))
    return sorted(out, key=lambda m: (m[0], m[4].col_offset))


def rewrite(content: str, pattern: str, template: str) -> str:
    """Content with outermost matches replaced; raises SyntaxError if that breaks code that parsed before."""
    data, lines = content.encode(), content.encode().split(b"\n")
    start_of = [0]
    for line in lines:
        start_of.append(start_of[-1] + len(line) + 1)
    segment = _segments(content)
    source = lambda x: ", ".join(map(source, x)) if isinstance(x, list) else x if isinstance(x, str) else segment(x) or ast.unparse(x)
    spans = []
    for _, _, _, held, node in search(content, pattern):
        a, b = start_of[node.lineno - 1] + node.col_offset, start_of[node.end_lineno - 1] + node.end_col_offset
        if not spans or a >= spans[-1][1]:
            made = re.sub(r"\$\$\$([A-Z_][A-Z0-9_]*)|\$([A-Z_][A-Z0-9_]*)", lambda m, held=held: source(held[m[1] or m[2]]), template)
            spans.append((a, b, made.encode()))
    for a, b, made in reversed(spans):
        data = data[:a] + made + data[b:]
    out = data.decode()
    ast.parse(out)
    return out


def unified_diff(before: str, after: str, path: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))


def change_count(before: str, after: str) -> int:
    return sum(line[:1] in "+-" and line[:3] not in ("+++", "---") for line in difflib.unified_diff(before.splitlines(), after.splitlines(), lineterm=""))


def _searcher(pattern: str, language: str | None):
    """(path, content) -> matches; checks the pattern at once."""

    def of_python(path: str, content: str) -> list[tuple]:
        try:
            return [m[:3] for m in search(content, pattern)] if language is None or language_of(path) == language else []
        except (SyntaxError, ValueError, RecursionError):
            return []

    def of_tokens(path: str, content: str) -> list[tuple]:
        return trees.search(content, pattern, language) if language_of(path) == language else []

    if language in (None, "python"):
        _parsed(pattern)
        return of_python
    trees.compiled(pattern, language)
    return of_tokens


def search_files(files: DataFrame, pattern: str, language: str | None = None) -> DataFrame:
    """(path, line_start, line_end, matched) of Python, or of files of another language of the lexer's table.

    Files that don't parse as Python have no matches; nor have files of other languages, if one is given."""
    return _exploded(files, _searcher(pattern, language), "path string, line_start int, line_end int, matched string")


def search_each(files: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """(path, pattern, line_start, line_end, matched) of many (pattern, language) in one pass over the files."""
    each = [(pattern, _searcher(pattern, language)) for pattern, language in asked]
    return _exploded(files, lambda path, content: [(pattern, *m) for pattern, of in each for m in of(path, content)], "path string, pattern string, line_start int, line_end int, matched string")


def _rewriter(pattern: str, template: str, language: str | None):
    """(path, content) -> (content after, whether the template broke it); checks the pattern at once."""

    def of_python(path: str, content: str) -> tuple[str, bool]:
        if language is not None and language_of(path) != language:
            return content, False
        try:
            search(content, pattern)
        except (SyntaxError, ValueError, RecursionError):
            return content, False
        try:
            return rewrite(content, pattern, template), False
        except SyntaxError:
            return content, True

    def of_tokens(path: str, content: str) -> tuple[str, bool]:
        return trees.rewrite(content, pattern, template, language) if language_of(path) == language else (content, False)

    if language in (None, "python"):
        _parsed(pattern)
        return of_python
    trees.check_template(pattern, language, template)
    return of_tokens


def rewrite_files(files: DataFrame, pattern: str, template: str, language: str | None = None) -> DataFrame:
    """(path, changed, diff, error_introduced): a dry run."""
    after_of = _rewriter(pattern, template, language)

    def made(path: str, content: str) -> list[tuple]:
        after, broke = after_of(path, content)
        return [(after != content, unified_diff(content, after, path) if after != content else "", broke)]

    return _exploded(files, made, "path string, changed boolean, diff string, error_introduced boolean")


def rewritten_files(files: DataFrame, pattern: str, template: str, language: str | None = None) -> DataFrame:
    """(path, content, changed, error_introduced): every file as it is after the rewriting, whole.

    A file that the template would break keeps its content; one that was faulty before is rewritten."""
    after_of = _rewriter(pattern, template, language)

    def made(path: str, content: str) -> list[tuple]:
        after, broke = after_of(path, content)
        return [(after, after != content, broke)]

    return _exploded(files, made, "path string, content string, changed boolean, error_introduced boolean")
