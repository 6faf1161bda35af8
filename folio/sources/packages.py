"""Packages with integrity files, lockfiles, imported rule lists, source trees."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import subprocess
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import ignore
from folio.operators.code.symbols import EXTENSIONS, MAX_BYTES
from folio.sources.bundle import MANIFEST, read_files, walk

INTEGRITY = "integrity.json"
LOCK_VERSION = 1


def payload(root: str) -> list[tuple[str, bytes]]:
    """(path, content) of a local book's files, the manifest first; its memory and links stay out."""
    names = [p for p in walk(root)[0] if os.path.isfile(os.path.join(root, p)) and not os.path.islink(os.path.join(root, p)) and p.split("/")[0] != "memory" and p != INTEGRITY]
    out = []
    for p in sorted(names, key=lambda p: (p != MANIFEST, p)):
        with open(os.path.join(root, p), "rb") as f:
            out.append((p, f.read()))
    return out


def integrity(files: list[tuple[str, bytes]]) -> dict:
    hashes = {p: hashlib.sha256(c).hexdigest() for p, c in files}
    return {"version": 1, "bundle": hashlib.sha256("".join(f"{p}\n{h}\n" for p, h in hashes.items()).encode()).hexdigest(), "files": hashes}


def package(root: str, target: str) -> dict:
    """Write target (a folder, or .tar.gz) with the payload and its integrity file."""
    files = payload(root)
    listed = integrity(files)
    files = [*files, (INTEGRITY, json.dumps(listed, indent=1, sort_keys=True).encode())]
    if target.endswith(".tar.gz"):
        with tarfile.open(f"{target}.new", "w:gz") as tar:
            for p, c in files:
                info = tarfile.TarInfo(p)
                info.size = len(c)
                tar.addfile(info, io.BytesIO(c))
        os.replace(f"{target}.new", target)
    else:
        for p, c in files:
            os.makedirs(os.path.dirname(os.path.join(target, p)) or target, exist_ok=True)
            with open(os.path.join(target, p), "wb") as f:
                f.write(c)
    return listed


def listed_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash) of a book's integrity file."""
    files = json.loads(spark.read.text(f"{root}/{INTEGRITY}", wholetext=True).first().value)["files"]
    return spark.createDataFrame(sorted(files.items()), "path string, hash string")


def found_hashes(spark: SparkSession, root: str) -> DataFrame:
    files = read_files(spark, root).where(F.col("path") != INTEGRITY).where(~F.col("path").startswith("memory/"))
    return files.select("path", F.sha2("content", 256).alias("hash"))


class Lockfile:
    """Pins of imported books: name -> url, reference, commit, integrity."""

    FIELDS = {"url", "reference", "commit", "integrity"}

    def __init__(self, pins: dict[str, dict] | None = None):
        self.pins = pins or {}

    @classmethod
    def load(cls, path: str) -> Lockfile:
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data.get("version") != LOCK_VERSION:
            raise ValueError(f"a lockfile of version {data.get('version')}")
        for name, pin in data["pins"].items():
            if set(pin) - cls.FIELDS or not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", pin.get("commit", "")):
                raise ValueError(f"not a pin: {name}")
        return cls(data["pins"])

    def render(self) -> str:
        return json.dumps({"version": LOCK_VERSION, "pins": self.pins}, indent=2, sort_keys=True) + "\n"

    def save(self, path: str) -> None:
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            f.write(self.render())
        os.replace(f"{path}.new", path)

    def pin(self, name: str, url: str, commit: str, reference: str | None = None, integrity_hash: str | None = None) -> None:
        """Another url for a pinned name is refused: remove the pin first."""
        if name in self.pins and self.pins[name]["url"] != url:
            raise ValueError(f"{name} is pinned to {self.pins[name]['url']}")
        self.pins[name] = {k: v for k, v in (("url", url), ("commit", commit), ("reference", reference), ("integrity", integrity_hash)) if v is not None}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, p["url"], p["commit"]) for n, p in sorted(self.pins.items())]
        return spark.createDataFrame(rows, "name string, url string, commit string")


def import_rules(text: str, existing: set[str] = frozenset()) -> tuple[list[dict], list[str]]:
    """(rules, skipped ids) of a YAML rule list. A rule's own facets go before its file's; `warning` is
    `warn`; lists of patterns are joined by lines; nested examples go before flat ones; rules that
    exist already are skipped."""
    data = yaml.safe_load(text)
    meta, listed = (data.get("metadata") or {}, data.get("rules") or []) if isinstance(data, dict) else ({}, data or [])
    out, skipped = [], []
    for rule in listed:
        rid = str(rule.get("id") or rule.get("rule_id") or "").strip()
        if not rid:
            raise ValueError(f"a rule without id: {rule}")
        facet = lambda n, rule=rule: rule.get(n, meta.get(n))
        pattern = facet("pattern")
        examples = rule.get("examples") or {}
        made = {
            "rule_id": rid,
            "description": rule.get("description"),
            "language": facet("language"),
            "category": facet("category"),
            "priority": {"warning": "warn"}.get(facet("priority"), facet("priority")),
            "pattern": "\n".join(pattern) if isinstance(pattern, list) else pattern,
            "good": examples.get("good", rule.get("good")),
            "bad": examples.get("bad", rule.get("bad")),
        }
        where = f"styleguide/{made['language'] or 'any'}/{made['category'] or 'general'}/{rid}"
        if where in existing:
            skipped.append(where)
        else:
            out.append({"concept_id": where, **made})
    return out, skipped


def imported_rules(spark: SparkSession, text: str, existing: set[str] = frozenset()) -> DataFrame:
    names = ["concept_id", "rule_id", "description", "language", "category", "priority", "pattern", "good", "bad"]
    rows = [tuple(r[n] for n in names) for r in import_rules(text, existing)[0]]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


_RULE = ["concept_id", "rule_id", "description", "language", "category", "priority", "pattern", "good", "bad"]


def import_rule_files(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(path, the columns of a rule, error) of YAML rule lists (path, content); a list that can't be read is
    one row with its error. Rules whose concept_id is in existing (concept_id) are left out."""
    schema = ", ".join(f"{n} string" for n in ["path", *_RULE, "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = import_rules(content or "")[0]
                    rows += [(path, *(None if r[n] is None else str(r[n]) for n in _RULE), None) for r in found]
                except (yaml.YAMLError, ValueError, AttributeError, TypeError) as e:
                    rows.append((path, *[None] * len(_RULE), f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(_RULE) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", *_RULE, "error"])

    found = files.select("path", "content").mapInArrow(run, schema)
    if existing is None:
        return found
    return found.join(existing.select("concept_id").distinct(), "concept_id", "left_anti").select("path", *_RULE, "error")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of source files of known languages up to a megabyte; in a git work tree those
    that git lists, elsewhere all that aren't hidden or ignored by the tree's rule files, in any store."""
    every = read_files(spark, root, MAX_BYTES)
    files = every.where(F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS) & ~F.col("path").rlike(r"(^|/)\."))
    if os.path.isdir(os.path.join(root, ".git")):
        listed = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard"], capture_output=True, text=True, check=True).stdout.splitlines()
        files = files.join(spark.createDataFrame([(p,) for p in listed], "path string"), "path", "left_semi")
    else:
        files = ignore.kept(files, every)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def git_diff(root: str, *revisions: str, max_bytes: int = 2 * 1024 * 1024) -> str:
    """A unified diff of a local repository; over the limit it is refused."""
    out = subprocess.run(["git", "-C", root, "diff", "--no-color", "--no-ext-diff", "-U3", *revisions], capture_output=True, check=True).stdout
    if len(out) > max_bytes:
        raise ValueError(f"the diff has {len(out)} bytes, over {max_bytes}")
    return out.decode("utf-8", "replace")
