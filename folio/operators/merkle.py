"""Trees of files compared by digests of folders: what is equal is left out before any file is joined.

A folder's digest is the sum of its files' digests (240 bits of SHA-256 over path and hash, in four numbers) and
a count, so it is made by partial sums on every task, from the bottom up, and no folder's files are gathered.
Sums don't depend on order. Folders of two trees meet in one join; only files that lie directly in folders
whose own digests differ are joined by path.

Edge cases: a null path is no file; a null hash is a value of its own; a path that stands several times in one
tree counts once, with its smallest hash; a path without a slash lies in the folder ''. An empty tree has no folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.storage import saved

#: Folders that differ are broadcast up to this number, beyond it joined by shuffle.
BROADCAST_FOLDERS = 50_000
_PARTS = 4
_DIGITS = 15


def folder_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _ancestors(folder: Column) -> Column:
    """A folder, all above it, and the top."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.filter(above, lambda x: x != "")))


def folders(files: DataFrame) -> DataFrame:
    """(folder, depth, files, digest, own_files, own_digest) of a tree (path, hash): of all files below, and of
    those directly inside. own_digest is null for folders of folders alone."""
    digest = F.sha2(F.concat(F.col("path"), F.lit("\0"), F.coalesce(F.concat(F.lit("="), F.col("hash").cast("string")), F.lit(""))), 256)
    part = [F.conv(F.substring(digest, 1 + n * _DIGITS, _DIGITS), 16, 10).cast("decimal(20,0)").alias(f"p{n}") for n in range(_PARTS)]
    total = [F.sum(f"p{n}").cast("decimal(38,0)").alias(f"p{n}") for n in range(_PARTS)]
    own = files.where(F.col("path").isNotNull()).select(folder_of(F.col("path")).alias("own"), *part).groupBy("own").agg(F.count("*").alias("n"), *total)
    spread = own.select("*", F.explode(_ancestors(F.col("own"))).alias("folder"))
    inside = F.col("own") == F.col("folder")
    sums = [F.sum(f"p{n}").cast("string") for n in range(_PARTS)]
    direct = [F.max(F.when(inside, F.col(f"p{n}"))).cast("string") for n in range(_PARTS)]  # one row of a folder is its own
    count, own_count = F.sum("n"), F.max(F.when(inside, F.col("n")))
    return spread.groupBy("folder").agg(
        count.alias("files"),
        F.concat_ws(".", count, *sums).alias("digest"),
        F.coalesce(own_count, F.lit(0)).alias("own_files"),
        F.when(own_count.isNotNull(), F.concat_ws(".", own_count, *direct)).alias("own_digest"),
    ).withColumn("depth", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, depth, change, own_differs, files_before, files_after) of two trees' folders.

    change: same, added, removed or changed somewhere below; own_differs: in the files directly inside."""
    a = before.select("folder", F.col("depth").alias("d0"), F.col("files").alias("files_before"), F.col("digest").alias("was"), F.col("own_digest").alias("own_was"))
    b = after.select("folder", F.col("depth").alias("d1"), F.col("files").alias("files_after"), F.col("digest").alias("is"), F.col("own_digest").alias("own_is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("files_before", "files_after")]
    return a.join(b, "folder", "full_outer").select("folder", F.coalesce("d0", "d1").alias("depth"), change.alias("change"), (~F.col("own_was").eqNullSafe(F.col("own_is"))).alias("own_differs"), *zero)


def topmost(compared: DataFrame) -> DataFrame:
    """Folders that were added or removed whole and whose parents weren't: what a report names."""
    whole = compared.where(F.col("change").isin("added", "removed"))
    parents = whole.select(F.col("folder").alias("parent"), F.col("change").alias("parent_change"))
    above = F.when(F.col("folder") != "", folder_of(F.col("folder"))).alias("above")
    rows = whole.select("*", above)
    return rows.join(parents, (rows["above"] == F.col("parent")) & (rows["change"] == F.col("parent_change")), "left_anti").drop("above")


def open_files(files: DataFrame, compared: DataFrame) -> DataFrame:
    """The files of a tree that have to be joined: those of folders that differ."""
    differing = compared.where("own_differs").select(F.col("folder").alias("_folder"))
    if differing.count() <= BROADCAST_FOLDERS:
        differing = F.broadcast(differing)
    rows = files.where(F.col("path").isNotNull()).select("path", F.col("hash").cast("string").alias("hash"), folder_of(F.col("path")).alias("_folder"))
    return rows.join(differing, "_folder", "left_semi").select("path", "hash")


def changes(before: DataFrame, after: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """(path, change): added, removed or changed files of two trees (path, hash).

    Folders that were compared already (kept digests of an earlier snapshot) are taken as they are; else both
    trees' folders are made, and the comparison is written, as both sides ask it."""
    if compared is None:
        compared = saved(compare(folders(before), folders(after)), "merkle")
    one = lambda tree, name: open_files(tree, compared).groupBy("path").agg(F.min("hash").alias(name), F.lit(True).alias(f"in_{name}"))
    both = one(before, "old").join(one(after, "new"), "path", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    differs = F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return both.where(differs).select("path", change.alias("change"))
