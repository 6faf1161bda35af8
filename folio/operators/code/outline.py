"""Outlines and zooms over symbol tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import intervals

OUTPUT_BYTES = 30_000
CONTEXT = 3


class Ambiguous(ValueError):
    """A name with several symbols; the message lists them."""


def containment(symbols: DataFrame) -> DataFrame:
    """Adds `parent` and `parent_start`: the innermost other symbol of the file whose lines hold the symbol's."""
    return intervals.innermost(symbols, "path", "name", "start_row", "end_row", "parent", "parent_start")


def nested(symbols: DataFrame) -> DataFrame:
    """Adds `parent_row`: the first row of the symbol that the scope chain names, the nearest one above; null at the top."""
    whole = F.concat_ws(".", F.when(F.col("scope") != "", F.col("scope")), "name")
    holders = symbols.select("path", whole.alias("scope"), F.col("start_row").alias("parent_row"))
    met = symbols.join(holders, ["path", "scope"]).where(F.col("parent_row") <= F.col("start_row"))
    near = met.groupBy("path", "scope", "name", "start_row").agg(F.max("parent_row").alias("parent_row"))
    return symbols.join(near, ["path", "scope", "name", "start_row"], "left").select(*symbols.columns, "parent_row")


def file_totals(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bytes, symbols) of each file."""
    counted = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    return files.select("path", F.octet_length("content").alias("bytes")).join(counted, "path", "left").select("path", "bytes", F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols"))


def _signature(said: str) -> str:
    """Its first line, of 80 bytes at most."""
    line = said.splitlines()[0] if said else ""
    data = line.encode()
    return line if len(data) <= 80 else data[:79].decode(errors="ignore") + "…"


def render(symbols: list, limit: int = OUTPUT_BYTES) -> str:
    """An outline's text, from one file's collected symbols; cut at whole lines with a note."""
    out = ""
    for s in sorted(symbols, key=lambda s: s["start_row"]):
        line = "  " * (s["scope"].count(".") + 1 if s["scope"] else 0) + f"{s['start_row']}-{s['end_row']} {s['kind']} {_signature(s['signature'])}\n"
        if len((out + line).encode()) > limit:
            return out + "… [cut]\n"
        out += line
    return out


def zoom(files: DataFrame, symbols: DataFrame, path: str, name: str, context: int = CONTEXT) -> DataFrame:
    """(line_no, line) of a symbol and the lines around it."""
    found = symbols.where((F.col("path") == path) & (F.col("name") == name)).orderBy("start_row").limit(20).collect()
    if not found:
        raise ValueError(f"no symbol {name} in {path}")
    if len(found) > 1:
        raise Ambiguous(", ".join(f"{s['name']} ({s['kind']}, line {s['start_row']})" for s in found))
    lines = files.where(F.col("path") == path).select(F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return lines.select((F.col("pos") + 1).alias("line_no"), "line").where(F.col("line_no").between(found[0]["start_row"] - context, found[0]["end_row"] + context))


def zooms(files: DataFrame, wanted: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Many zooms at once: wanted (path, name, start_row, end_row), of a symbol table, with `first_line`,
    `last_line` and `lines`, the text of the symbol and of the lines around it.

    Lines are sliced from their file by task; none is made a row. A file that isn't there gives no row."""
    lines = F.split("content", "\n")
    first = F.greatest(F.col("start_row") - context, F.lit(1))
    last = F.least(F.col("end_row") + context, F.size(lines))
    met = wanted.join(files.select("path", "content").where(F.col("content").isNotNull()), "path")
    return met.select("path", "name", "start_row", "end_row", first.alias("first_line"), last.alias("last_line"), F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n").alias("lines"))
