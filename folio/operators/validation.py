"""Contracts of books, concepts, skills and rules, as a table of predicates.

Each contract is (requirement, severity, when it applies, when it is violated, message). All are
evaluated in one pass over the concepts: violations are an array that is exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITIES = ["error", "warn", "info"]
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"
_blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))


def concept_contracts() -> list[tuple[str, str, Column, Column, str]]:
    """For rows of concept_id, namespace, type, description, body, language, category, priority, pattern, pattern_ok."""
    ns, kind = F.col("namespace"), F.col("type")
    rule, skill, always = ns == "styleguide", ns == "skill", F.lit(True)
    given = lambda c: F.col(c).isNotNull()
    return [
        ("DOC-1", "error", ns == "document", _blank(kind), "a concept needs a type"),
        ("MEM-1", "error", ns == "memory", _blank(kind), "a memory note needs a type"),
        ("STG-1", "error", rule, _blank(kind), "a rule needs a type"),
        ("STG-2", "error", rule & ~_blank(kind), kind != "Rule", "a rule's type must be Rule"),
        ("STG-3", "error", rule, _blank(F.col("description")), "a rule needs a description"),
        ("STG-4", "warning", rule, F.col("language").isNull() | F.col("category").isNull(), "a rule should name its language and category"),
        ("STG-9", "warning", rule & given("priority"), ~F.col("priority").isin(*PRIORITIES), "the priority isn't one of error, warn, info"),
        ("STG-10", "warning", rule & given("pattern"), ~F.col("pattern_ok"), "the pattern doesn't compile"),
        ("SKL-3", "error", skill, _blank(kind) | (kind != "Skill"), "a skill's type must be Skill"),
        ("SKL-4", "error", skill, _blank(F.col("description")), "a skill needs a description"),
        ("SKL-5", "error", skill & always, _blank(F.col("body")), "a skill needs a body"),
    ]


def manifest_contracts() -> list[tuple[str, str, Column, Column, str]]:
    """For rows of concept_id (the book), type, name, version, has_frontmatter."""
    always = F.lit(True)
    return [
        ("STR-4", "error", always, ~F.col("has_frontmatter"), "the manifest has no frontmatter"),
        ("STR-5", "error", F.col("has_frontmatter"), _blank(F.col("name")), "the manifest has no name"),
        ("STR-5", "error", F.col("has_frontmatter") & F.col("version").isNotNull(), ~F.col("version").rlike(SEMVER), "the version isn't semantic"),
    ]


def with_entries(paths: DataFrame) -> DataFrame:
    """Adds has_entry to rows of paths: whether a folder of skill/ holds a file of its own name."""
    shape = "^skill/([^/]+)/\\1\\.md$"
    held = paths.where(F.col("concept_id").rlike(shape)).select(F.concat(F.lit("skill/"), F.regexp_extract("concept_id", shape, 1)).alias("concept_id"), F.lit(True).alias("has_entry")).distinct()
    return paths.join(held, "concept_id", "left").withColumn("has_entry", F.coalesce("has_entry", F.lit(False)))


def path_contracts(manifest: str, entries: bool = False) -> list[tuple[str, str, Column, Column, str]]:
    """For rows of concept_id (the path), is_folder; with entries also has_entry (SKL-2)."""
    path, last = F.col("concept_id"), F.element_at(F.split("concept_id", "/"), -1)
    return [
        ("STR-3", "error", path.contains("/"), last == manifest, "a manifest lies below the root"),
        ("STR-7", "error", ~path.contains("/"), last.isin("document", "skill", "memory", "styleguide") & ~F.col("is_folder"), "a namespace is a file"),
        ("STR-11", "error", F.col("is_folder"), last.isin("index.md", "log.md"), "a folder has the name of a listing"),
        ("SKL-1", "warning", path.startswith("skill/") & ~F.col("is_folder") & ~path.rlike("^skill/[^/]+/"), ~last.endswith(".md"), "a stray file in skill"),
        ("SKL-2", "error", path.rlike("^skill/[^/]+$") & F.col("is_folder"), ~F.col("has_entry") if entries else F.lit(False), "a skill's folder has no entry of its name"),
        ("SKL-6", "info", path.rlike("^skill/[^/]+/") & ~F.col("is_folder"), ~path.rlike("^skill/([^/]+)/\\1\\.md$") & ~path.rlike("^skill/[^/]+/references/"), "materials belong in references"),
    ]


def violations(rows: DataFrame, contracts: list[tuple[str, str, Column, Column, str]]) -> DataFrame:
    """(concept_id, requirement, severity, message)"""
    found = [F.when(F.coalesce(applies & broken, F.lit(False)), F.struct(F.lit(r).alias("requirement"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for r, s, applies, broken, m in contracts]
    return rows.select("concept_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")).select("concept_id", "v.requirement", "v.severity", "v.message")


def verdict(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, and whether all conforms (no errors)."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"), (count("error") == 0).alias("conformant"))


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
