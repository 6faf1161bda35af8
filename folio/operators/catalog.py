"""Catalogues, tree differences, integrity, update plans and sync states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import RESERVED_NAMESPACES
from folio.operators import merkle

#: Global books of one machine at most.
GLOBAL_BOOKS = 10_000


def namespace_counts(concepts: DataFrame, key: str = "book") -> DataFrame:
    """A column for each reserved namespace with its number of concepts, and `other`."""
    ns = F.col("namespace")
    known = [F.count_if(ns == n).alias(n) for n in RESERVED_NAMESPACES]
    return concepts.groupBy(key).agg(*known, F.count_if(~ns.isin(*RESERVED_NAMESPACES)).alias("other"))


def status(units: DataFrame) -> DataFrame:
    """(book, namespace, passages, concepts) with subtotals: null stands for all."""
    return units.rollup("book", "namespace").agg(F.count("*").alias("passages"), F.countDistinct("concept_id").alias("concepts"))


def distinct_books(books: DataFrame) -> DataFrame:
    """One row for each (name, version), however many projects use it."""
    return books.dropDuplicates(["name", "version"])


def duplicates(concepts: DataFrame) -> DataFrame:
    """(concept_id, roots, books): ids that more than one book root holds."""
    grouped = concepts.groupBy("concept_id").agg(F.countDistinct("root").alias("roots"), F.array_sort(F.collect_set("book")).alias("books"))
    return grouped.where("roots > 1")


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, bucket, change): added, removed or changed files of two trees (path, hash)."""
    a, b = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    first = F.substring_index("path", "/", 1)
    bucket = F.when(first.isin("skill", "styleguide") & F.col("path").contains("/"), first).otherwise("other")
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", bucket.alias("bucket"), change.alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("bucket", "change").agg(F.count("*").alias("files"))


def update_plan(pins: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, from_commit, to_commit, up_to_date) of pins (name, commit) and remote heads (name, commit)."""
    r = remote.select("name", F.col("commit").alias("to_commit"))
    return pins.select("name", F.col("commit").alias("from_commit")).join(r, "name", "left").withColumn("up_to_date", F.col("from_commit").eqNullSafe(F.col("to_commit")))


def update_counts(plan: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The plan (name, ...) with `added`, `changed` and `removed`: files of each book's tree at its pin and at the
    remote head. Both trees: name, path, hash. Books whose trees are equal are settled by their digests alone.

    A null name is no book; a book without files on both sides counts nothing."""
    one = lambda tree: tree.select(F.concat(F.url_encode("name"), F.lit("/"), "path").alias("path"), "hash")
    found = merkle.changes(one(before), one(after)).select(F.url_decode(F.substring_index("path", "/", 1)).alias("name"), "change")
    kinds = ("added", "changed", "removed")
    counted = found.groupBy("name").agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds))
    return plan.join(counted, "name", "left").select(*plan.columns, *(F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in kinds))


def integrity_problems(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): missing, mismatch or unlisted; both sides: path, hash."""
    a, b = listed.select("path", F.col("hash").alias("said")), found.select("path", F.col("hash").alias("is"))
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("said").isNull(), "unlisted").otherwise("mismatch")
    return a.join(b, "path", "full_outer").where(~F.col("said").eqNullSafe(F.col("is"))).select("path", problem.alias("problem"))


def bundle_hash(files: DataFrame, manifest: str, key: str = "book") -> DataFrame:
    """(book, bundle_hash): SHA-256 over `path`, `hash` lines, the manifest first, then by path.

    The digest is fed line by line from rows in order, so a book of any size needs no memory; a digest
    over lines in order is one task's work by its nature."""
    rows = files.select(F.col(key).cast("string").alias(key), (F.col("path") != manifest).alias("later"), "path", "hash")
    dealt = rows.repartition(key).sortWithinPartitions(key, "later", "path", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        made = lambda name, d: pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([d.hexdigest()], pa.string())], [key, "bundle_hash"])
        for batch in batches:
            for name, _, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or name != now:
                    if digest is not None:
                        yield made(now, digest)
                    now, digest = name, hashlib.sha256()
                digest.update(f"{path}\n{content}\n".encode())
        if digest is not None:
            yield made(now, digest)

    return dealt.mapInArrow(run, f"`{key}` string, bundle_hash string")


def stamp_state(stamp: Column, sidecar_hash: Column, contents_valid: Column, no_sidecar: str = "none") -> Column:
    """What the stamp of a pull and the integrity sidecar say together.

    No stamp: a sidecar is verified, none is fine. A stamp of `none`: a sidecar must not have appeared.
    A stamp with a hash: the sidecar must be there, unchanged, and its contents valid."""
    verified = F.when(contents_valid, "ok").otherwise("contents differ")
    return (
        F.when(stamp.isNull() & sidecar_hash.isNull(), "ok")
        .when(stamp.isNull(), verified)
        .when((stamp == no_sidecar) & sidecar_hash.isNull(), "ok")
        .when(stamp == no_sidecar, "sidecar appeared")
        .when(sidecar_hash.isNull(), "sidecar missing")
        .when(sidecar_hash != stamp, "sidecar changed")
        .otherwise(verified)
    )


def sync_states(pins: DataFrame, checkouts: DataFrame) -> DataFrame:
    """(name, state) of pins (name, commit) and checkouts (name, head, intact, error)."""
    state = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("head").isNull(), "pulled")
        .when(~F.col("intact"), "integrity failed")
        .when(F.col("head") != F.col("commit"), "drifted")
        .otherwise("at pin")
    )
    return pins.join(checkouts, "name", "left").select("name", state.alias("state"))


def render_markdown(counts: list, duplicate_ids: list) -> str:
    """The catalogue's text, from collected rollups."""
    heads = ["book", *RESERVED_NAMESPACES, "other"]
    table = ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
    table += ["| " + " | ".join(str(r[h]) for h in heads) + " |" for r in sorted(counts, key=lambda r: r["book"])]
    extra = [f"- `{r['concept_id']}`: {', '.join(r['books'])}" for r in sorted(duplicate_ids, key=lambda r: r["concept_id"])]
    return "\n".join(["# Catalogue", "", *table, *(["", "## Duplicates", "", *extra] if extra else []), ""])


def active_books(projects: DataFrame, books: DataFrame) -> DataFrame:
    """(slug, name, version, root, writable): each project's own books, and the global ones (null slug) that
    aren't among these by name and version. Global books are those of one machine; too many raise."""
    kept = ["name", "version", "root", "writable"]
    if books.where(F.col("slug").isNull()).count() > GLOBAL_BOOKS:
        raise ValueError(f"over {GLOBAL_BOOKS} global books")
    own = books.where(F.col("slug").isNotNull()).select("slug", *kept)
    shared = projects.select("slug").distinct().crossJoin(F.broadcast(books.where(F.col("slug").isNull()).select(*kept)))
    return own.union(shared.join(own.select("slug", "name", "version"), ["slug", "name", "version"], "left_anti").select("slug", *kept))


def project_catalog(projects: DataFrame, books: DataFrame, concepts: DataFrame) -> DataFrame:
    """A row for each project: slug, hash, root, stale, books, the namespace counts, duplicate_ids.

    projects: slug, root, root_exists (null root: none was recorded); books: slug, name, version, root,
    writable; concepts: root (of the book), namespace, concept_id. A project whose recorded root is gone
    is stale. hash: the slug's last part if it is the root's, or looks like one where no root is known."""
    active = active_books(projects, books)
    held = active.select("slug", "root", F.col("name").alias("book")).join(concepts, "root")
    counts = namespace_counts(held, "slug")
    twice = held.groupBy("slug", "concept_id").agg(F.countDistinct("root").alias("roots")).where("roots > 1").groupBy("slug").agg(F.count("*").alias("duplicate_ids"))
    listed = active.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("name", "version", "root", "writable"))).alias("books"))
    ends = F.regexp_extract("slug", "-([0-9a-f]{8})$", 1)
    recorded = F.substring(F.sha2("root", 256), 1, 8)
    own_hash = F.when(F.col("root").isNull(), ends).when(ends == recorded, ends).otherwise("")
    base = projects.select("slug", own_hash.alias("hash"), "root", (F.col("root").isNotNull() & ~F.coalesce("root_exists", F.lit(False))).alias("stale"))
    numbers = [*RESERVED_NAMESPACES, "other"]
    out = base.join(listed, "slug", "left").join(counts, "slug", "left").join(twice, "slug", "left")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in (*numbers, "duplicate_ids")]
    return out.select("slug", "hash", "root", "stale", F.coalesce("books", F.array().cast("array<struct<name:string,version:string,root:string,writable:boolean>>")).alias("books"), *zero).orderBy("slug")


def write_catalog(catalog: DataFrame, path: str) -> None:
    """The catalogue as one JSON line a project, in a folder that readers see whole."""
    catalog.write.mode("overwrite").json(path)


def render_projects(rows: list) -> str:
    """The projects' catalogue as Markdown, from collected rows; stale ones are marked."""
    out = ["# Projects"]
    for r in sorted(rows, key=lambda r: r["slug"]):
        counts = ", ".join(f"{r[n]} {n}" for n in (*RESERVED_NAMESPACES, "other") if r[n])
        out += ["", f"## {r['slug']}" + (" (stale)" if r["stale"] else ""), "", f"root: {r['root'] or 'not recorded'}", f"concepts: {counts or 'none'}; ids in several books: {r['duplicate_ids']}"]
        out += [f"- {b['name']} {b['version']}{'' if b['writable'] else ' (read-only)'}: `{b['root']}`" for b in r["books"]]
    return "\n".join([*out, ""])
