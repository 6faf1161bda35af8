"""Merge conflicts: listing and resolving marked blocks, with or without a base part, any line ends."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from folio.operators.code.symbols import _exploded


@dataclass
class Conflict:
    start: int
    end: int
    ours: list[str] = field(default_factory=list)
    base: list[str] | None = None
    theirs: list[str] = field(default_factory=list)
    ours_label: str = ""
    theirs_label: str = ""


def _marker(line: str, mark: str) -> bool:
    bare = line.rstrip("\r\n")
    return bare == mark or bare.startswith(mark + " ")


def scan(content: str) -> list[Conflict]:
    """Complete conflicts, lines from 1; one that isn't closed is left out, and so is one begun anew."""
    out: list[Conflict] = []
    now, part = None, ""
    for n, line in enumerate(content.splitlines(True), 1):
        if _marker(line, "<<<<<<<"):
            now, part = Conflict(n, n, ours_label=line[7:].strip()), "ours"
        elif now and part == "ours" and _marker(line, "|||||||"):
            now.base, part = [], "base"
        elif now and part in ("ours", "base") and line.rstrip("\r\n") == "=======":
            part = "theirs"
        elif now and part == "theirs" and _marker(line, ">>>>>>>"):
            now.end, now.theirs_label = n, line[7:].strip()
            out.append(now)
            now = None
        elif now:
            {"ours": now.ours, "base": now.base, "theirs": now.theirs}[part].append(line)
    return out


def resolve(content: str, side: str, nth: int | None = None) -> tuple[str, int]:
    """(content, number resolved). side: ours, theirs, base (which drops both sides) or a text of one's own.

    nth (from 1) resolves one conflict only. What isn't a complete conflict stays as it is."""
    found = scan(content)
    if nth is not None and not 1 <= nth <= len(found):
        raise ValueError(f"there are {len(found)} conflicts, not {nth}")
    chosen = {c.start: c for i, c in enumerate(found, 1) if nth is None or i == nth}
    out, skip = [], 0
    for n, line in enumerate(content.splitlines(True), 1):
        if c := chosen.get(n):
            skip = c.end
            newline = "\r\n" if line.endswith("\r\n") else "\n"
            own = {"ours": c.ours, "theirs": c.theirs, "base": []}
            out += own[side] if side in own else [x + newline for x in side.split("\n")]
        if n > skip:
            out.append(line)
    return "".join(out), len(chosen)


def list_conflicts(files: DataFrame) -> DataFrame:
    """(path, nth, line_start, line_end, ours_lines, theirs_lines, has_base)"""
    made = lambda p, c: [(i, x.start, x.end, len(x.ours), len(x.theirs), x.base is not None) for i, x in enumerate(scan(c), 1)]
    return _exploded(files, made, "path string, nth int, line_start int, line_end int, ours_lines int, theirs_lines int, has_base boolean")


def resolve_files(files: DataFrame, side: str) -> DataFrame:
    """(path, resolved, content)"""

    def made(path: str, content: str) -> list[tuple]:
        text, n = resolve(content, side)
        return [(n, text)]

    return _exploded(files, made, "path string, resolved int, content string")
