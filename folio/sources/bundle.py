"""Books on disk or in any store that Spark reads: concepts of markdown with YAML frontmatter.

Files are read by Spark; frontmatter is parsed row by row in Arrow batches into JSON, which
`parse_json` turns into a variant. Listings of a local folder (symbolic links, unreadable entries)
are the driver's work: Spark's readers don't report those.
"""

from __future__ import annotations

import datetime
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import RESERVED_FOLDER, concept_id

MANIFEST = "book.md"
LISTINGS = ("index.md", "log.md")
MAX_DEPTH = 100


class MissingFrontmatter(ValueError):
    pass


def _depth(value: object) -> int:
    deep, todo = 0, [(value, 1)]
    while todo:
        x, n = todo.pop()
        deep = max(deep, n)
        if n > MAX_DEPTH:
            break
        todo += [(y, n + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return deep


def split_frontmatter(text: str) -> tuple[dict, str]:
    """(frontmatter, body). Without an opening `---` all is body; an unclosed block, or one that isn't a
    mapping, is an error; a blank one is empty."""
    text = text.removeprefix("﻿")
    lines = text.split("\n")
    if lines[0].rstrip("\r") != "---":
        return {}, text
    for n, line in enumerate(lines[1:], 1):
        if line.rstrip("\r") == "---":
            try:
                found = yaml.safe_load("\n".join(lines[1:n]))
            except (yaml.YAMLError, RecursionError) as e:
                raise ValueError(f"the frontmatter isn't YAML: {e}") from None
            if found is None:
                found = {}
            if not isinstance(found, dict):
                raise ValueError("the frontmatter isn't a mapping")
            if _depth(found) > MAX_DEPTH:
                raise ValueError("the frontmatter is nested too deeply")
            return found, "\n".join(lines[n + 1 :])
    raise MissingFrontmatter("the frontmatter isn't closed")


def join_frontmatter(frontmatter: dict, body: str) -> str:
    return f"---\n{yaml.safe_dump(frontmatter, sort_keys=False, allow_unicode=True) if frontmatter else ''}---\n{body}"


def normalised_tags(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def parse_concepts(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds frontmatter (JSON), body, tags and parse_error to files; a failure is a row, not an exception."""
    names, at = files.columns, files.columns.index(content_col)
    as_text = lambda x: x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                try:
                    front, body = split_frontmatter((raw or b"").decode("utf-8"))
                    rows.append((json.dumps(front, default=as_text, ensure_ascii=False), body, normalised_tags(front.get("tags")), None))
                except ValueError as e:
                    rows.append((None, None, [], str(e)))
            front, body, tags, error = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(front, pa.string()), pa.array(body, pa.string()), pa.array(tags, pa.list_(pa.string())), pa.array(error, pa.string())], [*names, "frontmatter", "body", "tags", "parse_error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInArrow(run, f"{schema}, frontmatter string, body string, tags array<string>, parse_error string")


def facet(name: str, frontmatter: Column | None = None) -> Column:
    """A text field of the frontmatter; null unless it is a text."""
    return F.get_json_object(F.col("frontmatter") if frontmatter is None else frontmatter, f"$.{name}")


def with_facets(concepts: DataFrame) -> DataFrame:
    return concepts.withColumns({n: facet(n) for n in ("type", "name", "description", "language", "category", "priority", "pattern", "rule_id", "verified", "version")})


def read_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """(path, content, length) of all files below root, by path relative to it; state folders are left out."""
    root = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)
    base = root if "://" in root else f"file:{os.path.abspath(root)}"
    relative = F.expr(f"substr(path, locate('{base.split('://')[-1].removeprefix('file:')}/', path) + {len(base.split('://')[-1].removeprefix('file:')) + 1})")
    hidden = F.exists(F.split("path", "/"), lambda s: s.isin(RESERVED_FOLDER, ".git"))
    return found.select(relative.alias("path"), "content", "length").where(~hidden)


def read_concepts(spark: SparkSession, root: str, book: str) -> DataFrame:
    """All concepts of a book with their facets; the namespace is the first part of the path."""
    files = read_files(spark, root).where(F.col("path").endswith(".md") & ~F.element_at(F.split("path", "/"), -1).isin(*LISTINGS))
    named = files.select(F.lit(book).alias("book"), "path", F.substring_index("path", "/", 1).alias("namespace"), concept_id(F.col("path")).alias("concept_id"), "content")
    return with_facets(parse_concepts(named)).drop("content")


class NotABook(ValueError):
    """A folder that can't be opened as a book; the requirement it breaks is named."""


#: The type of a manifest. (Fixed value.)
MANIFEST_TYPE = "Book"
_VERSION = re.compile(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?")


def manifest_of(concepts: DataFrame) -> dict:
    """name, version, description and tags of the one manifest among a book's parsed files (path, frontmatter, parse_error)."""
    rows = concepts.where(F.col("path") == MANIFEST).select("frontmatter", "parse_error").limit(1).collect()
    if not rows:
        raise NotABook(f"no {MANIFEST} at the root (STR-2)")
    if rows[0].parse_error:
        raise NotABook(f"{MANIFEST}: {rows[0].parse_error} (STR-4)")
    front = json.loads(rows[0].frontmatter)
    if not front:
        raise NotABook(f"{MANIFEST} has no frontmatter (STR-4)")
    if str(front.get("type") or "").strip() != MANIFEST_TYPE:
        raise NotABook(f"{MANIFEST} has type {front.get('type')!r}, not {MANIFEST_TYPE} (STR-5)")
    name, version = str(front.get("name") or "").strip(), str(front.get("version") or "").strip()
    if not name:
        raise NotABook(f"{MANIFEST} has no name (STR-5)")
    if version and not _VERSION.fullmatch(version):
        raise NotABook(f"{MANIFEST} has version {version!r}, which isn't semantic (STR-5)")
    return {"name": name, "version": version or None, "description": front.get("description"), "tags": normalised_tags(front.get("tags"))}


def open_book(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """(manifest, concepts) of a book below root, a folder of any store; a linked manifest is refused."""
    if os.path.islink(os.path.join(root, MANIFEST)):
        raise NotABook(f"{MANIFEST} is a link; a book's content lies in it (STR-2)")
    try:
        files = read_files(spark, root).where(F.col("path") == MANIFEST)
        manifest = manifest_of(parse_concepts(files))
    except AnalysisException as e:
        raise NotABook(f"{root} is no folder: {e}") from None
    return manifest, read_concepts(spark, root, manifest["name"])


def open_project(books: list[tuple[DataFrame, bool]]) -> DataFrame:
    """Books' concepts in the order of precedence, the local one first; a name taken twice is an error."""
    out, names = None, set()
    for at, (concepts, is_local) in enumerate(books):
        name = concepts.select("book").first()
        if name and name.book in names:
            raise ValueError(f"two books are named {name.book}")
        names |= {name.book} if name else set()
        own = concepts.withColumn("is_local", F.lit(is_local)).withColumn("precedence", F.lit(at))
        out = own if out is None else out.unionByName(own)
    return out


def walk(root: str) -> tuple[list[str], list[str]]:
    """(entries by relative path, entries that can't be read) of a local folder; links aren't followed."""
    out, bad = [], []

    def go(folder: str, prefix: str) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            bad.append(prefix.rstrip("/"))
            return
        for e in entries:
            if e.name in (RESERVED_FOLDER, ".git"):
                continue
            out.append(prefix + e.name)
            if e.is_dir(follow_symlinks=False):
                go(e.path, f"{prefix}{e.name}/")

    go(root, "")
    return sorted(out), sorted(bad)


class ContractViolation(ValueError):
    """What is to be written breaks a requirement, whose id comes first."""


def contract_faults(concept: str, frontmatter: dict, body: str) -> list[str]:
    """Requirements that a concept of a namespace breaks; the same ids as in the validation of books."""
    parts, said = concept.split("/"), lambda k: str(frontmatter.get(k) or "").strip()
    entry = parts[0] == "skill" and (len(parts) == 2 or (len(parts) == 3 and parts[1] == parts[2]))
    listing = parts[0] == "styleguide" and parts[-1] in ("index", "log")
    out = [("DOC-1", parts[0] == "document" and not said("type")), ("MEM-1", parts[0] == "memory" and not said("type"))]
    if parts[0] == "styleguide" and not listing:
        out += [("STG-1", not said("type")), ("STG-2", bool(said("type")) and said("type") != "Rule"), ("STG-3", not said("description"))]
    if entry:
        out += [("SKL-3", said("type") != "Skill"), ("SKL-4", not said("description")), ("SKL-5", not body.strip())]
    return [name for name, broken in out if broken]


def _place(root: str, concept: str) -> str:
    parts = concept.split("/")
    if any(p in ("", ".", "..", RESERVED_FOLDER) for p in parts) or "\\" in concept or ":" in concept:
        raise ValueError(f"not a concept id: {concept}")
    return os.path.join(root, *parts) + ".md"


class ReadTracker:
    """Writes go only to files as they were last read: a file that was never read, or has changed since, is refused."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    @staticmethod
    def _changed(path: str) -> int | None:
        try:
            return os.stat(path).st_mtime_ns
        except OSError:
            return None

    def record(self, path: str) -> None:
        path = os.path.realpath(path)
        if (at := self._changed(path)) is not None:
            self.seen[path] = at

    def check(self, path: str) -> None:
        path = os.path.realpath(path)
        now = self._changed(path)
        if now is None:  # nothing to overwrite
            self.seen.pop(path, None)
        elif path not in self.seen:
            raise StaleRead(f"{path} was never read: read it first")
        elif self.seen[path] != now:
            raise StaleRead(f"{path} has changed since it was read: read it again")


class StaleRead(ValueError):
    pass


def write_concept(root: str, concept: str, frontmatter: dict, body: str, overwrite: bool = True, tracker: ReadTracker | None = None) -> str:
    """Write one concept of a local book, complete or not at all, if it keeps its namespace's contract.

    With a tracker an existing file is overwritten only as it was last read."""
    path = _place(root, concept)
    if not overwrite and os.path.exists(path):
        raise FileExistsError(concept)
    if tracker is not None:
        tracker.check(path)
    if concept.split("/")[0] == "memory" and not str(frontmatter.get("type") or "").strip():
        frontmatter = {**frontmatter, "type": "Memory"}
    if broken := contract_faults(concept, frontmatter, body):
        raise ContractViolation(f"{', '.join(broken)}: {concept}")
    if not str(frontmatter.get("type") or "").strip():
        raise ValueError("a concept needs a type")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8", newline="") as f:
        f.write(join_frontmatter(frontmatter, body))
    os.replace(f"{path}.new", path)
    if tracker is not None:
        tracker.record(path)
    return path


def delete_concept(root: str, concept: str) -> None:
    """Delete a concept, and folders that are empty then, up to its namespace.

    The entry of a skill in folder form isn't deleted alone: the folder goes, or nothing."""
    path, parts = _place(root, concept), concept.split("/")
    if parts[0] == "skill" and len(parts) == 3 and parts[1] == parts[2]:
        raise ContractViolation(f"SKL-2: without {concept} its folder is no skill; remove the folder")
    os.remove(path)
    folder, top = os.path.dirname(path), os.path.join(root, parts[0])
    while folder not in (root, top) and not os.listdir(folder):
        os.rmdir(folder)
        folder = os.path.dirname(folder)


def promote(root: str, memory: str, target: str, frontmatter: dict) -> str:
    """Copy a memory note's body to a new concept that names its source; nothing is overwritten."""
    with open(os.path.join(root, *memory.split("/")) + ".md", encoding="utf-8") as f:
        _, body = split_frontmatter(f.read())
    sources = [*frontmatter.get("sources", []), memory]
    return write_concept(root, target, {**frontmatter, "sources": sources}, body, overwrite=False)
