"""SimHash near-duplicates by pivot distance tables.

Fingerprint: 64 bits over word shingles, each hashed with XXH64 (seed 42); a bit is 1 if it is
set in over half of the shingles' hashes, repeats included.

Links (at most two differing bits) are found among the distinct fingerprints only:

1. Blocks of reference fingerprints that agree outside two of four 16-bit blocks have distances
   that determine, and are determined by, the bits of those two blocks. Two differing bits leave
   two blocks alike, so each linked pair meets in at least one of the six block pairs.
2. The pivot table holds the Hamming distances to 64 reference fingerprints, the rows of a
   Hadamard matrix. By the triangle inequality a pair whose coordinates differ by more than two
   at any pivot can't be a link and is discarded. The rows are orthogonal, so for m differing
   bits the mean square of the 64 differences is m: only pairs with m <= 4 survive.
3. Survivors are verified by exact distance.

A bucket with more than ``bucket_limit`` fingerprints isn't paired up. Its fingerprints are
linked through the 65 values within one bit of each: fingerprints that share such a value are
within two bits of each other, and any two within two bits share one. That is exact, and linear.

Components come from alternating large-star and small-star steps on tables in the shared folder.

Edge cases: null text counts as empty; without words the fingerprint is zero and links like any
other. Repeated rows and equal texts share a fingerprint, so they share a component. A null id
never becomes a component id unless all ids of the component are null. An empty table gives an
empty result. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.batches import sliced, small_batches
from folio.storage import discard, save, saved

SEED = 42
BITS = 64
BLOCK = 16
MAX_DISTANCE = 2
BUCKET_LIMIT = 64
_STEP = 1 << 15


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of one text in UTF-8."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and exactly the separators \\x20 \\x09-\\x0D
    if not words:
        return 0
    n = words_per_shingle
    if len(words) < n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total = np.zeros(BITS, np.int64), len(words) - n + 1
    for at in range(0, total, _STEP):
        part = words[at : at + _STEP + n - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(n)), strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8)).view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(x or b"", words_per_shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(own).mapInArrow(run, "id long, fp long")


def pivots() -> np.ndarray:
    """64 reference fingerprints: the rows of a Hadamard matrix as bit patterns."""
    index = np.arange(BITS)
    rows = np.bitwise_count(index[:, None] & index[None, :]) & 1
    return np.packbits(rows.astype(np.uint8), axis=1).view(np.uint64).ravel()


def with_pivot_distances(fps: DataFrame) -> DataFrame:
    """Adds `coords`: one byte for the Hamming distance to each pivot."""
    names = fps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = pivots()
        for batch in batches:
            fp = batch.column(names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.uint8)
            coords = pa.array([row.tobytes() for row in table], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, coords], [*names, "coords"])

    schema = ", ".join(f"{n} {t}" for n, t in fps.dtypes)
    return fps.mapInArrow(run, f"{schema}, coords binary")


def _block_keys(fp: Column) -> Column:
    """The six pairs of four 16-bit blocks; each key holds the pair's number and its 32 bits."""
    block = [F.shiftrightunsigned(fp, BLOCK * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.lit(n << 32) + F.shiftleft(block[i], 16) + block[j] for n, (i, j) in enumerate(pairs)])


def _survivors(pairs: DataFrame, distance: int) -> DataFrame:
    """Pairs that the pivot table doesn't discard and whose exact distance is small enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda col: np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BITS).astype(np.int8)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, left, right = batch.columns
            near = np.flatnonzero(np.abs(table(left) - table(right)).max(axis=1) <= distance)
            u, v = (x.to_numpy(zero_copy_only=False)[near] for x in (a, b))
            close = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= distance
            yield pa.RecordBatch.from_arrays([pa.array(u[close]), pa.array(v[close])], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> tuple[DataFrame, list[str]]:
    """Links (u, v) whose closure joins all fingerprints within two bits; fps: distinct `fp`.

    Also the paths of tables that can go when the links have been used."""
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met, met_at = save(with_pivot_distances(keyed.join(sizes, "key")), "simhash-buckets")
    small = met.where(F.col("n") <= bucket_limit)
    pairs = small.select("key", F.col("fp").alias("u"), F.col("coords").alias("cu")).join(small.select("key", F.col("fp").alias("v"), F.col("coords").alias("cv")), "key").where("u < v")
    paired = _survivors(pairs.select("u", "v", "cu", "cv"), MAX_DISTANCE)

    crowded = met.where(F.col("n") > bucket_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(np.int64(np.uint64(1 << i)).item()) for i in range(BITS)])
    balls = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    heads = balls.groupBy("centre").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    through = balls.join(heads, "centre").where("fp <> head").select(F.col("head").alias("u"), F.col("fp").alias("v"))
    out, out_at = save(paired.union(through).distinct(), "simhash-links")
    discard(fps.sparkSession, met_at)
    return out, [out_at]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges of two longs.

    Alternates large-star and small-star, each a partially aggregated minimum by node and a join
    that Spark may split on skew; no neighbour list is ever gathered."""
    spark = edges.sparkSession
    now, path = save(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = save(small, "cc")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = after, after_path
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of docs: id, fp (signed 64 bits), component_id (smallest id reachable)."""
    spark = docs.sparkSession
    rows = saved(with_fingerprints(docs, id_col, text_col, words_per_shingle), "simhash-rows")
    fps, fps_at = save(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-fps")
    edges, spent = links(fps.select("fp"), bucket_limit)
    roots = components(edges)
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = saved(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    discard(spark, fps_at, *spent)
    return rows.join(named, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
