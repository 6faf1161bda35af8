"""Ignore rules of source trees: ordered patterns with negation, anchors and nested folders, applied to paths.

The rules of a tree are a few short files, which the driver compiles; paths are judged by tasks, in
Arrow batches. A path is ignored if one of the folders above it is, from the top down, or else by the
last pattern that fits it; a file's patterns come after those of the folders above, and an ignored
folder can't be reopened below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES_FILE = ".gitignore"
#: Folders whose verdict a task remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Rule:
    #: The folder that the rule's file is in, with a slash at its end; empty at the top.
    base: str
    pattern: str
    negated: bool
    folders_only: bool


def _class(text: str, at: int) -> tuple[str, int] | None:
    """(expression, next place) of a bracket that opens at a place; None if it isn't closed."""
    n = at + 1
    negated = text[n : n + 1] in ("!", "^")
    n += negated
    out, first = "", True
    while n < len(text) and (first or text[n] != "]"):
        first = False
        if text[n] == "\\" and n + 1 < len(text):
            n += 1
            out += re.escape(text[n])
        elif text.startswith("[:", n) and ":]" in text[n:]:
            name = text[n + 2 : text.index(":]", n)]
            out += {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "lower": "a-z", "upper": "A-Z", "space": r"\s", "xdigit": "0-9a-fA-F", "punct": r"!-/:-@\[-`{-~"}.get(name, "")
            n += len(name) + 3
        else:
            out += text[n] if text[n] == "-" else re.escape(text[n])
        n += 1
    if n >= len(text):
        return None
    return (f"(?!/)[{'^' if negated else ''}{out}]" if out else "(?!)"), n + 1


def expression(pattern: str) -> str:
    """The regular expression of a pattern without its marks at the ends."""
    anchored, body, n = "/" in pattern, pattern.removeprefix("/"), 0
    out = "" if anchored else "(?:.*/)?"
    while n < len(body):
        if body.startswith("**/", n) and (n == 0 or body[n - 1] == "/"):
            out, n = out + "(?:.*/)?", n + 3
        elif body[n:] == "**" and body[n - 1 : n] == "/":
            out, n = out + ".+", n + 2
        elif body[n] == "*":
            out, n = out + "[^/]*", n + 1
        elif body[n] == "?":
            out, n = out + "[^/]", n + 1
        elif body[n] == "[" and (found := _class(body, n)):
            out, n = out + found[0], found[1]
        elif body[n] == "\\" and n + 1 < len(body):
            out, n = out + re.escape(body[n + 1]), n + 2
        else:
            out, n = out + re.escape(body[n]), n + 1
    return out


def parse(text: str, base: str = "") -> list[Rule]:
    """The rules of one file, in order; patterns that aren't well-formed fit nothing."""
    out = []
    for line in text.removeprefix("﻿").split("\n"):
        line = line.removesuffix("\r")
        line = re.sub(r"(?<!\\)[ ]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line.removeprefix("!") if negated else line
        folders_only = line.endswith("/") and not line.endswith("\\/")
        line = line.removesuffix("/") if folders_only else line
        if not line:
            continue
        try:
            made = expression(line)
            re.compile(made)
        except re.error:
            continue
        out.append(Rule(base, made, negated, folders_only))
    return out


def rules_of(files: list[tuple[str, str]]) -> list[Rule]:
    """Of (path, text) of all rule files of a tree: those nearer to the top come first."""
    named = [(path.rpartition("/")[0], text) for path, text in files]
    return [r for folder, text in sorted(named, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])) for r in parse(text, f"{folder}/" if folder else "")]


class Judge:
    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.DOTALL)) for r in rules]
        self.folder = lru_cache(REMEMBERED)(self._folder)

    def _fits(self, path: str, is_folder: bool) -> bool:
        for rule, pattern in reversed(self.rules):
            if path.startswith(rule.base) and (is_folder or not rule.folders_only) and pattern.fullmatch(path, len(rule.base)):
                return not rule.negated
        return False

    def _folder(self, path: str) -> bool:
        above = path.rpartition("/")[0]
        return bool(above and self.folder(above)) or self._fits(path, True)

    def ignored(self, path: str) -> bool:
        above = path.rpartition("/")[0]
        return bool(above and self.folder(above)) or self._fits(path, False)


def with_ignored(paths: DataFrame, rules: list[Rule], path_col: str = "path", out: str = "ignored") -> DataFrame:
    """paths with a boolean column; null for a null path. Paths are relative to the tree's top, of files."""
    own = paths.drop(out)
    at = own.columns.index(path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules)
        for batch in batches:
            found = [None if p is None else judge.ignored(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, out])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(out, T.BooleanType())]))


def kept(files: DataFrame, rules_files: DataFrame) -> DataFrame:
    """files (path, ...) that the tree's own rule files (path, content as bytes) don't ignore."""
    found = [(r.path, bytes(r.content).decode("utf-8", "replace")) for r in rules_files.where(F.element_at(F.split("path", "/"), -1) == RULES_FILE).select("path", "content").collect()]
    return with_ignored(files, rules_of(found), out="_ignored").where("NOT _ignored").drop("_ignored") if found else files
