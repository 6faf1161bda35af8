"""Near copies by Jaccard similarity of word shingles: exact, with prefix keys and pivot distances.

At a similarity of 0.8 SimHash fingerprints differ in about ten of 64 bits and prove nothing, so this
operator keeps the method of pivot distances but measures them between the shingle sets themselves,
where the triangle inequality gives a proven bound. No pair of at least the similarity is lost.

1. Sets: each row's distinct shingle hashes (XXH64, 64 bits) in order of size. Rows of equal sets are
   linked to the first of them, which alone goes on.
2. Keys: in any common order of all shingles, two sets A and B of similarity t or more share one among
   the first n - ceil(t * n) + 1 of each. The order puts hot shingles last, others by hash. A shingle
   is hot when more than ``bucket_limit`` rows have it as key; rows with hot ones send further shingles
   instead, and if some of these are hot, all they have. So a passage in any number of unlike texts is no key.
3. Buckets of up to PAIRED rows are paired up. In larger ones all rows are compared with one of them, and
   when the links found so far are closed, the rows outside the bucket's largest component with all rows
   of other components, in salted parts. Pairs inside one component need no comparison.
4. Buckets of keys that aren't hot hold at most ``bucket_limit`` rows. Rows that consist of hot shingles
   for the most part (large families of copies) have hot keys, too; the row that such a bucket's others
   are compared with is the one that has the fewest other shingles.
5. Pairs are discarded by pivot distances. The distance of sets is the size of their difference; it is at
   most (|A| + |B|) * (1 - t) / (1 + t) for linked ones. The 2**CLASSES references are the unions of
   classes of shingles (the lowest bits of the hash). As a row's distance to a reference is its size less
   twice what it shares, plus the reference's size, the largest coordinate difference of two rows over all
   references is the sum of |a_j - b_j| over their counts in the classes: that is the row's pivot table.
   A second table has more classes than the set has shingles and keeps one bit for each (odd or even
   counts); there the Hamming distance bounds the difference from below almost exactly.
6. Survivors are verified: the Jaccard similarity of their whole sets. Components of links are groups.
7. With ``fingerprints`` links by SimHash (at most two differing bits, found through that operator's pivot
   tables) are links, too. They come first, so rows that they join aren't compared again in crowded buckets.

Edge cases: null text counts as empty; a text without words has no shingles and no copies, one with fewer
words than a shingle is one shingle. Rows are judged one by one, so rows of one id may differ in their
groups, and rows of null id take part; a group's id is its smallest that isn't null. Of a group the row of
the smallest id stays, null ids last, and exactly one of repeated rows. Columns of docs are kept whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import simhash
from folio.llm.batches import sliced, small_batches
from folio.llm.exact_dedup import Filter
from folio.llm.simhash import SEED, components
from folio.storage import discard, release_memory, save

WORDS = 5
SIMILARITY = 0.8
BUCKET_LIMIT = 24
CLASSES = 64
MOST = 32767
#: Rows of a bucket up to which all its pairs are compared at once.
PAIRED = 4
#: Rows of a crowded bucket in one part.
PART_ROWS = 1024
#: Rows (of two longs) up to which a table is broadcast; beyond it it is joined by shuffle.
BROADCAST_IDS = 500_000
_TINY = 1e-9


def shingle_hashes(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of a text's shingles, in order of size."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n, digest, join = words_per_shingle, xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(n)), strict=False) if len(words) >= n else [words]
    return np.unique(np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64))


def _lists(made: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*made, np.empty(0, np.int64)]).astype(np.int64), kind))


def _hashed(batch: pa.RecordBatch, words_per_shingle: int) -> list[np.ndarray]:
    """The shingle hashes of a batch's second column."""
    return [shingle_hashes(x or b"", words_per_shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]


def key_count(n: int, similarity: float) -> int:
    """How many of a set's n shingles, first in a common order, hold one that any similar set has among its own."""
    return n - math.ceil(n * similarity - _TINY) + 1


def shingle_sets(texts: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame:
    """(row, n, digest, counts, keys) of rows with words; texts: row, text. keys: the first shingles by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches):
            found = [(row, s) for row, s in zip(batch.column(0).to_pylist(), _hashed(batch, words_per_shingle), strict=True) if len(s)]
            sets = [s for _, s in found]
            # no count over MOST: that only brings tables nearer
            counts = [np.minimum(np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), MOST) for s in sets]
            keys = [s[: key_count(len(s), similarity)].view(np.int64) for s in sets]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in found], pa.int64()), pa.array(map(len, sets), pa.int32()), digests, _lists(counts, pa.int16()), _lists(keys, pa.int64())], ["row", "n", "digest", "counts", "keys"])

    return small_batches(texts).mapInArrow(run, "row long, n int, digest binary, counts array<short>, keys array<long>")


def further_keys(texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """(row, n, start, keys): the shingles from `start` to before `stop` in the order of hashes; texts: row, text, start, stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = _hashed(batch, words_per_shingle)
            keys = [s[a:b].view(np.int64) for s, a, b in zip(sets, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int32()), batch.column(2), _lists(keys, pa.int64())], ["row", "n", "start", "keys"])

    return small_batches(texts.select("row", "text", "start", "stop")).mapInArrow(run, "row long, n int, start int, keys array<long>")


def fingerprint_bits(hashes: np.ndarray) -> bytes:
    """A bit for each class of shingles, 1 if the set has an odd number of them; 8 to 16 classes a shingle.

    A shingle more or less flips one bit, so the Hamming distance of two sets' bits is at most the size of
    their difference. Of a power of two of classes, half as many are the exclusive or of the halves."""
    size = max(64, 1 << (8 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    u, v = (np.frombuffer(b, np.uint64) for b in (x, y))
    while len(u) != len(v):
        long = u if len(u) > len(v) else v
        half = long[: len(long) // 2] ^ long[len(long) // 2 :]
        u, v = (half, v) if long is u else (u, half)
    return int(np.bitwise_count(u ^ v).sum())


def whole_sets(texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """(row, n, bits, tokens)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = _hashed(batch, words_per_shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int32()), pa.array(map(fingerprint_bits, sets), pa.binary()), _lists([s.view(np.int64) for s in sets], pa.int64())], ["row", "n", "bits", "tokens"])

    return small_batches(texts.select("row", "text")).mapInArrow(run, "row long, n int, bits binary, tokens array<long>")


def near_by_bits(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of pairs (a, b, n, m, x, y) whose fingerprints x, y are as near as sets of n and m shingles must be."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([bits_apart(x, y) <= (n + m) * share + _TINY for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


class _Tables:
    """Written tables of one run, and joins that broadcast only what is small."""

    def __init__(self, spark, broadcast_rows: int):
        self.spark, self.broadcast_rows, self.paths = spark, broadcast_rows, []

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        table, path = save(df, f"copies-{tag}", compression="zstd")
        self.paths.append(path)
        return table

    def small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= self.broadcast_rows else table

    def discard(self, since: int = 0, kept: int = 0) -> None:
        """Delete tables that nothing reads any more: those written from a point on, but the last `kept`."""
        gone = self.paths[since : len(self.paths) - kept]
        discard(self.spark, *gone)
        self.paths = [p for p in self.paths if p not in gone]


def _alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) >= F.greatest(x, y) * similarity - _TINY


def _listed(keys: DataFrame, start: Column) -> DataFrame:
    """(token, row, n, place) of rows with lists of keys from a place on."""
    return keys.select("row", "n", start.alias("start"), F.posexplode("keys").alias("at", "token")).select("token", "row", "n", (F.col("start") + F.col("at")).alias("place"))


def _keys(sets: DataFrame, texts: DataFrame, made: _Tables, words_per_shingle: int, similarity: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """((token, row, n) of keys that aren't hot; (token, row, n, others) of hot keys)."""
    p = (F.col("n") - F.ceil(F.col("n") * similarity - _TINY) + 1).cast("int")  # key_count
    shared = lambda rows: made.save(rows.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"), "shared")
    crowded = lambda counted: counted.where(F.col("rows") > limit).select("token")
    every, reached = _listed(sets, F.lit(0)), None
    several = shared(every)
    hot = made.save(crowded(several), "hot")
    several = several.select("token")
    while True:
        known = made.small(hot)
        hits = every.join(known, "token").groupBy("row").agg(F.count("*").alias("hot"), F.first("n").alias("n"))
        hits = made.save(hits.join(reached, "row", "left") if reached is not None else hits.withColumn("reach", F.lit(None).cast("int")), "hits")
        own = hits.select("row", "n", "hot", F.coalesce("reach", p).alias("reach"))
        # rows that are short again send all they have, so there are two rounds at most
        stop = F.least("n", p + 3 * F.col("hot") + 8).cast("int") if reached is None else F.col("n")
        short = made.save(own.where(F.least("n", p + F.col("hot")) > F.col("reach")).select("row", F.col("reach").alias("start"), stop.alias("stop")), "short")
        if short.isEmpty():
            break
        more = _listed(made.save(further_keys(texts.join(made.small(short), "row"), words_per_shingle), "keys"), F.col("start"))
        fresh = made.save(more.select("token").distinct(), "fresh")
        every = every.union(more)
        again = every.join(F.broadcast(fresh), "token", "left_semi") if fresh.count() <= made.broadcast_rows else every
        again = shared(again)  # only tokens that came again can be shared or hot by now
        hot = made.save(hot.union(crowded(again)).distinct(), "hot")
        several = several.union(again.select("token"))
        latest = short.select("row", F.col("stop").alias("reach"))
        reached = made.save((reached.union(latest) if reached is not None else latest).groupBy("row").agg(F.max("reach").alias("reach")), "reach")
        release_memory(made.spark)
    # most keys are a single row's: a filter of the others keeps them out of the shuffle
    several = made.save(several.distinct(), "several")
    asked = Filter.of(several.select(F.col("token").alias("digest")), several.count())
    made.paths.append(asked.path)
    cold = every.join(known, "token", "left_anti").select(F.col("token").alias("digest"), "row", "n")
    cold = (asked.passing(cold) if asked.is_small() else cold).withColumnRenamed("digest", "token")
    # rows that ran out of other shingles: the first hot ones fill up their keys
    quota = own.select("row", (F.col("n") - F.col("hot")).alias("others"), (p - F.col("n") + F.col("hot")).alias("quota")).where((F.col("reach") >= F.col("n")) & (F.col("quota") > 0))
    filled = every.join(known, "token").join(made.small(made.save(quota, "quota")), "row")
    filled = filled.groupBy("row", "n", "others", "quota").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("own"))
    filled = filled.select("row", "n", "others", F.explode(F.slice("own", F.lit(1), F.col("quota").cast("int"))).alias("key"))
    return cold, made.save(filled.select(F.col("key.token").alias("token"), "row", "n", "others"), "filled")


def _paired(keys: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of rows that share a key; keys: token, row, n, with few rows a token."""
    lists = keys.groupBy("token").agg(F.collect_list(F.struct("row", "n")).alias("rows"))
    two = lists.select(F.explode("rows").alias("x"), "rows").select("x", F.explode("rows").alias("y"))
    return two.where((F.col("x.row") < F.col("y.row")) & _alike(F.col("x.n"), F.col("y.n"), similarity)).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))


def _star(keys: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of each row and its bucket's lead; keys: token, row, n, lead."""
    other = keys.where((F.col("row") != F.col("lead.row")) & _alike(F.col("n"), F.col("lead.n"), similarity))
    return other.select(F.least("row", F.col("lead.row")).alias("a"), F.greatest("row", F.col("lead.row")).alias("b"))


def _near(n: Column, m: Column, counts: Column, others: Column, similarity: float) -> Column:
    """Whether the largest coordinate difference of two pivot tables allows a link."""
    apart = F.aggregate(F.zip_with(counts, others, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    return _alike(n, m, similarity) & (apart <= (n + m) * ((1 - similarity) / (1 + similarity)) + _TINY)


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, made: _Tables, words_per_shingle: int, similarity: float, discarded: bool = False) -> DataFrame:
    """(u, v) of pairs (a, b) that pass the pivot tables and then the comparison of their whole sets."""
    left, since = pairs, len(made.paths)
    if not discarded:
        named = lambda key, n, c: sets.select(F.col("row").alias(key), F.col("n").alias(n), F.col("counts").alias(c))
        met = pairs.join(named("a", "n", "x"), "a").join(named("b", "m", "y"), "b")
        left = made.save(met.where(_near(F.col("n"), F.col("m"), F.col("x"), F.col("y"), similarity)).select("a", "b"), "left")
    ids = made.save(left.select(F.col("a").alias("row")).union(left.select("b")).distinct(), "ids")
    wanted = made.save(whole_sets(texts.join(made.small(ids), "row", "left_semi"), words_per_shingle), "tokens")
    bits = lambda key, n, x: wanted.select(F.col("row").alias(key), F.col("n").alias(n), F.col("bits").alias(x))
    near = made.save(near_by_bits(left.join(bits("a", "n", "x"), "a").join(bits("b", "m", "y"), "b"), similarity), "near")
    release_memory(made.spark)
    tokens = wanted.select("row", "tokens")
    met = near.join(tokens.toDF("a", "x"), "a").join(tokens.toDF("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("both")
    links = made.save(met.where(F.col("both") >= union * similarity - _TINY).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    made.discard(since, kept=1)
    return links


def _rest(crowded: DataFrame, links: DataFrame, sets: DataFrame, made: _Tables, similarity: float, part_rows: int) -> DataFrame:
    """(a, b) that pass the pivot tables, of crowded buckets, in different components by the links so far."""
    roots = components(links)
    members = crowded.join(roots, crowded.row == roots.node, "left").select("token", "row", F.coalesce("root", "row").alias("root"))
    sizes = members.groupBy("token", "root").agg(F.count("*").alias("rows"))
    open_ = sizes.groupBy("token").agg(F.max(F.struct("rows", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.ceil(F.sum("rows") / part_rows).cast("int").alias("parts")).where("roots > 1").drop("roots")
    members = made.save(members.join(made.small(made.save(open_, "open")), "token").join(sets.select("row", "n", "counts"), "row"), "members")
    release_memory(made.spark)
    salt = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = members.where("root <> main").withColumn("part", salt).withColumn("turn", every_part).select("token", "part", "turn", F.col("row").alias("a"), F.col("root").alias("r"), F.col("n"), F.col("counts").alias("x"))
    two = members.withColumn("turn", salt).withColumn("part", every_part).select("token", "part", "turn", F.col("row").alias("b"), F.col("root").alias("s"), F.col("n").alias("m"), F.col("counts").alias("y"))
    met = one.join(two, ["token", "part", "turn"]).where((F.col("r") != F.col("s")) & _near(F.col("n"), F.col("m"), F.col("x"), F.col("y"), similarity))
    return made.save(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")


def _simhash_links(texts: DataFrame, made: _Tables) -> DataFrame:
    """(u, v) of rows with words whose SimHash fingerprints differ in at most two bits, by the operator's pivot
    distance tables: rows of one fingerprint are linked to the first of them, and the first ones of linked fingerprints."""
    some = texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    marked = made.save(simhash.with_fingerprints(some, "row", "text"), "fingerprints")
    firsts = made.save(marked.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    links, paths = simhash.links(firsts.select("fp"))
    made.paths += paths
    same = marked.join(firsts, "fp").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    named = lambda fp, row: firsts.select(F.col("fp").alias(fp), F.col("first").alias(row))
    near = links.withColumnsRenamed({"u": "x", "v": "y"}).join(named("x", "u"), "x").join(named("y", "v"), "y").select("u", "v")
    return made.save(same.union(near), "simhash")


def _groups(texts: DataFrame, made: _Tables, words_per_shingle: int, similarity: float, limit: int, part_rows: int, fingerprints: bool = False) -> DataFrame:
    """(node, root) of rows that have near copies; texts: row, text. fingerprints: those by SimHash, too."""
    release_memory(made.spark)
    marked = _simhash_links(texts, made) if fingerprints else None
    sets = made.save(shingle_sets(texts, words_per_shingle, similarity), "sets")
    release_memory(made.spark)
    same = made.save(sets.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "same")
    twins = made.save(sets.select("row", "digest").join(made.small(same), "digest").where("row <> rep").select(F.col("rep").alias("u"), F.col("row").alias("v")), "twins")
    n_twins = twins.count()
    if n_twins:
        others = twins.select(F.col("v").alias("row"))
        few = n_twins <= made.broadcast_rows
        alone = sets.join(F.broadcast(others) if few else others, "row", "left_anti")
        alone = alone if few else made.save(alone, "alone")
    else:
        alone = sets
    cold, filled = _keys(alone, texts, made, words_per_shingle, similarity, limit)
    by = Window.partitionBy("token")  # of at most `limit` rows
    cold = cold.withColumn("rows", F.count("*").over(by)).withColumn("lead", F.min(F.struct("row", "n")).over(by)).where("rows > 1")
    cold = made.save(cold, "cold")
    release_memory(made.spark)
    crowds = made.save(filled.groupBy("token").agg(F.count("*").alias("rows"), F.min(F.struct("others", "row", "n")).alias("first")).select("token", "rows", F.struct("first.row", "first.n").alias("lead")).where("rows > 1"), "crowds")
    met = filled.join(made.small(crowds), "token").select(*cold.columns)
    pairs = _paired(cold.where(F.col("rows") <= PAIRED), similarity).union(_paired(met.where(F.col("rows") <= PAIRED), similarity))
    crowded = cold.where(F.col("rows") > PAIRED).union(met.where(F.col("rows") > PAIRED))
    # links that are known already spare their buckets comparisons
    twins = twins if marked is None else twins.union(marked)
    links = twins.union(_links(made.save(pairs.union(_star(crowded, similarity)).distinct(), "pairs"), alone, texts, made, words_per_shingle, similarity))
    release_memory(made.spark)
    rest = _rest(crowded.select("token", "row"), links, alone, made, similarity, part_rows)
    release_memory(made.spark)
    links = links.union(_links(rest, alone, texts, made, words_per_shingle, similarity, discarded=True))
    found = components(links)
    return made.save(found.union(found.select("root", "root").distinct()), "groups")


def _numbered(docs: DataFrame, made: _Tables) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and that column's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return made.save(docs.withColumn(name, F.monotonically_increasing_id()), "docs"), name


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS, similarity: float = SIMILARITY, bucket_limit: int = BUCKET_LIMIT, part_rows: int = PART_ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(id, component_id) of each row that has near copies; component_id: the group's smallest id."""
    made = _Tables(docs.sparkSession, broadcast_ids)
    own, _ = save(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "copies-rows")
    found = _groups(own.select("row", "text"), made, words_per_shingle, similarity, bucket_limit, part_rows)
    named = found.join(own.select(F.col("row").alias("node"), "id"), "node")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    out, _ = save(named.join(least, "root").select("id", "component_id"), "copies-result")
    made.discard()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS, similarity: float = SIMILARITY, bucket_limit: int = BUCKET_LIMIT, part_rows: int = PART_ROWS, broadcast_ids: int = BROADCAST_IDS, fingerprints: bool = False) -> DataFrame:
    """docs without the near copies of rows that stay: of each group the row of the smallest id.

    fingerprints: rows with words whose SimHash fingerprints link are near copies, too, whatever their similarity."""
    made, held = _Tables(docs.sparkSession, broadcast_ids), _Tables(docs.sparkSession, broadcast_ids)
    own, row = _numbered(docs, held)
    found = _groups(own.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), made, words_per_shingle, similarity, bucket_limit, part_rows, fingerprints)
    key = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"), F.col("node"))
    named = found.join(own.select(F.col(row).alias("node"), id_col, text_col), "node").select("root", "node", key.alias("key"))
    stays = named.groupBy("root").agg(F.min("key")["node"].alias("stays"))
    gone = held.save(named.join(stays, "root").where("node <> stays").select(F.col("node").alias(row)), "gone")
    made.discard()
    return own.join(held.small(gone), row, "left_anti").select(*docs.columns)
