"""Passages: documents cut along headings and blocks within a token budget.

The cut is a fold over a document's lines whose state is the budget used so far, which no built-in
expression holds; it runs row by row in Arrow batches, without a shuffle.

Edge cases: null bodies count as empty; an empty body gives one passage of the prefix alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.functions.text import INVISIBLE

BUDGET = 220
SLACK = 4
LEAST_BUDGET = 32
DESCRIPTION_LIMIT = 200
BREADCRUMB = " › "
_INVISIBLE = re.compile(INVISIBLE)
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*))?$")
PASSAGE = "ordinal int, passage string, heading_path string, start_line int, end_line int, invisible int"


@dataclass
class Passage:
    text: str
    heading_path: str
    start: int
    end: int


def tokens(s: str) -> int:
    return -(-4 * len(s.split()) // 3)


def heading(line: str) -> tuple[int, str] | None:
    """(level, text) of an ATX heading with text."""
    m = _HEADING.match(line.rstrip("\r"))
    if not m:
        return None
    said = re.sub(r"(^|[ \t]+)#+$", "", (m[2] or "").strip()).strip()
    return (len(m[1]), said) if said else None


def is_fence(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line is a fence or lies between two."""
    out, inside = [], False
    for line in lines:
        mark = is_fence(line)
        out.append(inside or mark)
        inside ^= mark
    return out


def title_of(lines: list[str], description: str | None, fallback: str) -> str:
    """First level-1 heading among the leading ones, else the first of these, the description, the fallback."""
    first, within = None, fenced(lines)
    for line, skip in zip(lines, within, strict=True):
        if skip or not line.strip():
            continue
        h = heading(line)
        if not h:
            break
        if h[0] == 1:
            return h[1]
        first = first or h[1]
    return first or (description or "").strip() or fallback


def prefix_of(title: str, description: str | None, path: str) -> str:
    out, said = f"Concept: {title}", (description or "").strip()
    if said and said != title:
        out += "\nDescription: " + (said[:DESCRIPTION_LIMIT] + "…" if len(said) > DESCRIPTION_LIMIT else said)
    return out + (f"\nSection: {path}" if path else "")


def sections(lines: list[str]) -> list[tuple[str, int, int]]:
    """(heading path, first line, last line), 0-based, blank ones dropped; headings alone join the next."""
    within, stack = fenced(lines), []
    found: list[tuple[str, int, int]] = []
    start, path = 0, ""

    def close(end: int) -> None:
        if any(x.strip() for x in lines[start : end + 1]):
            found.append((path, start, end))

    for i, line in enumerate(lines):
        h = None if within[i] else heading(line)
        if h:
            close(i - 1)
            while stack and stack[-1][0] >= h[0]:
                stack.pop()
            stack.append(h)
            start, path = i, BREADCRUMB.join(t for _, t in stack)
    close(len(lines) - 1)
    only_headings = lambda a, b: all(not x.strip() or (heading(x) and not within[n]) for n, x in enumerate(lines[a : b + 1], a))
    out: list[tuple[str, int, int]] = []
    waiting: int | None = None
    for p, a, b in found:
        a = a if waiting is None else waiting
        if only_headings(a, b):
            waiting = a
            last = (p, a, b)
            continue
        waiting = None
        out.append((p, a, b))
    if waiting is not None:
        out = [*out[:-1], (out[-1][0], out[-1][1], last[2])] if out else [last]
    return out


def blocks(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    """Runs of non-blank lines; a fence keeps its blank lines; a heading of one line joins the next run."""
    within = fenced(lines[first : last + 1])
    runs: list[list[int]] = []
    for i in range(first, last + 1):
        if not lines[i].strip() and not within[i - first]:
            runs.append([])
        elif not runs:
            runs.append([i])
        else:
            runs[-1].append(i)
    spans = [(r[0], r[-1]) for r in runs if r]
    out: list[tuple[int, int]] = []
    start: int | None = None
    for n, (a, b) in enumerate(spans):
        begin = a if start is None else start
        if a == b and heading(lines[a]) and not within[a - first] and n + 1 < len(spans):
            start = begin
            continue
        out.append((begin, b))
        start = None
    return out


def pack(lines: list[str], first: int, last: int, budget: int) -> list[tuple[int, int]]:
    """Ranges of lines within the budget, by whole blocks, else by lines; one over-long line stays whole."""
    text = lambda a, b: "\n".join(lines[a : b + 1])
    out: list[tuple[int, int]] = []
    now: tuple[int, int] | None = None
    for a, b in blocks(lines, first, last):
        if now and tokens(text(now[0], b)) <= budget:
            now = (now[0], b)
            continue
        if now:
            out.append(now)
            now = None
        if tokens(text(a, b)) <= budget:
            now = (a, b)
            continue
        begin = a
        for i in range(a, b + 1):
            bare = all(not x.strip() or heading(x) for x in lines[begin:i])
            if i > begin and not bare and tokens(text(begin, i)) > budget:
                out.append((begin, i - 1))
                begin = i
        out.append((begin, b))
    return out + ([now] if now else [])


def chunk(body: str, fallback: str, description: str | None = None, budget: int = BUDGET) -> list[Passage]:
    """The passages of one document; each line that isn't blank is in exactly one."""
    lines = body.split("\n")
    title = title_of(lines, description, fallback)
    filled = [i for i, x in enumerate(lines) if x.strip()]
    end = filled[-1] if filled else 0
    render = lambda p, a, b: Passage(prefix_of(title, description, p) + "\n\n" + "\n".join(lines[a : b + 1]).rstrip(), p, a + 1, b + 1)
    fits = lambda p, a, b: tokens(prefix_of(title, description, p)) + tokens("\n".join(lines[a : b + 1])) + SLACK <= budget
    whole = [render("", 0, end)]
    if fits("", 0, end):
        return whole
    out: list[Passage] = []
    for p, a, b in sections(lines):
        while b > a and not lines[b].strip():
            b -= 1
        if fits(p, a, b):
            out.append(render(p, a, b))
        else:
            room = max(budget - tokens(prefix_of(title, description, p)) - SLACK, LEAST_BUDGET)
            out += [render(p, x, y) for x, y in pack(lines, a, b, room)]
    return out or whole


def passages(concepts: DataFrame, id_col: str = "id", body_col: str = "body", description_col: str | None = None, budget: int = BUDGET) -> DataFrame:
    """(id, ordinal, passage, heading_path, start_line, end_line, invisible) of each concept's passages."""
    own = concepts.select(id_col, body_col, *([description_col] if description_col else []))
    kind = dict(own.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                said = part.column(2).to_pylist() if description_col else [None] * part.num_rows
                rows: list[tuple] = []
                for i, body, about in zip(range(part.num_rows), part.column(1).to_pylist(), said, strict=True):
                    name = str(part.column(0)[i].as_py()).split("/")[-1]
                    for n, p in enumerate(chunk(body or "", name, about, budget)):
                        rows.append((i, n, _INVISIBLE.sub("", p.text), p.heading_path, p.start, p.end, len(_INVISIBLE.findall(p.text))))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                ints = lambda c: pa.array(c, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(ints(cols[0])), ints(cols[1]), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), ints(cols[4]), ints(cols[5]), ints(cols[6])], ["id", *(x.split()[0] for x in PASSAGE.split(", "))])

    return own.mapInArrow(run, f"id {kind}, {PASSAGE}")
