"""Exact duplicates by a log-structured merge index, in DataFrame operations only.

* Memtable: each input task digests its rows (SHA-256 of the normalised text) and flushes them as one
  file sorted by digest.
* Compaction merges a batch's memtables to a run: (digest, keep_id, group_size) in order of digest, with
  one identifier (smallest or largest) a digest, and a filter: SLOTS_PER_KEY bits for each digest, in
  blocks of 4 KB, of which a digest sets one. Hot digests are pre-aggregated by each task.
* Later batches look their digests up: the filters of older runs are asked first, and only digests that
  pass are joined to a run. More than FAN_OUT runs are merged into one; the newest entry of a digest
  holds its whole group, so the merged one has the largest size and the best identifier.
* Hits (digests of more than one row) receive byte verification: their rows' texts are grouped by
  digest *and* text, again pre-aggregated, so a group of any size costs one text a task. Texts come
  back through the hits or, if these are many, through a filter of them first, so that only rows of
  hits are shuffled with their text. Should two texts share a digest, each gets a group.

Normalisation lower-cases A-Z and nothing else.

Edge cases: null text counts as empty text. Equal rows, ids included, are one group and share its
decision; so all repetitions of the keeper's row have kept = true (`survivors` keeps one of them). Null
ids are never kept while the group has another; a group of null ids only has a null keep_id and keeps its
rows. An empty table gives an empty result. `exact_duplicates` reads the id and text columns only, and
`survivors` keeps all columns whatever their names. An index of several batches tells texts apart by
digest between batches, after comparing a hit's bytes with those of the row that its run keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.storage import discard, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests (32 bytes each) up to which the hits are broadcast; beyond it a filter of them is, if that is small.
BROADCAST_HITS = 10_000
#: Bits of a filter for each of its digests, and in a block; blocks (4 KB each) up to which a filter is broadcast.
SLOTS_PER_KEY = 16
BLOCK_BITS = 32768
BROADCAST_BLOCKS = 8192
#: Runs that an index holds at most before they are merged.
FAN_OUT = 4


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # one byte a character: lower() changes A-Z only, and is fast
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def flush_runs(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> tuple[DataFrame, str]:
    """The memtables' sorted runs: (id, digest), a file for each input task."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), digest(normalised(F.col(text_col).cast("string"))).alias("digest"))
    return save(own.sortWithinPartitions("digest", "id"), "lsm-runs")


def _best(keep: str):
    return F.min if keep == "smallest" else F.max


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Merge memtables: (digest, keep_id, group_size), in order of digest within a partition."""
    merged = runs.groupBy("digest").agg(_best(keep)("id").alias("keep_id"), F.count("*").alias("group_size"))
    return merged.sortWithinPartitions("digest")


@dataclass(frozen=True)
class Filter:
    """Blocks (block, bits) over `slots` bits in all."""

    blocks: DataFrame
    slots: int
    path: str

    @classmethod
    def of(cls, keys: DataFrame, count: int) -> Filter:
        """keys: digest."""
        slots = max(BLOCK_BITS, 1 << (SLOTS_PER_KEY * count - 1).bit_length()) if count else BLOCK_BITS
        slot = _slot(slots)
        marks = keys.select(F.bitmap_bucket_number(slot).alias("block"), F.bitmap_bit_position(slot).alias("bit"))
        blocks, path = save(marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "lsm-filter")
        return cls(blocks, slots, path)

    def is_small(self) -> bool:
        return self.slots // BLOCK_BITS + 1 <= BROADCAST_BLOCKS

    def passing(self, rows: DataFrame, inside: bool = True) -> DataFrame:
        """Those of rows whose digest may be in, all that are in among them; or the others."""
        slot = _slot(self.slots)
        blocks = F.broadcast(self.blocks) if self.is_small() else self.blocks
        asked = rows.withColumn("block", F.bitmap_bucket_number(slot)).join(blocks, "block", "inner" if inside else "left")
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        bit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")), F.lit(0)) == 1
        return asked.where(bit if inside else ~bit).select(*rows.columns)


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(slots))


def _own(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(id, text, digest), the text normalised."""
    text = normalised(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), digest(text).alias("digest"))


def _narrowed(rows: DataFrame, hits: DataFrame, broadcast_hits: int) -> tuple[DataFrame, bool]:
    """Rows that may be of hits, without a shuffle where possible; and whether others may be among them."""
    n = hits.count()
    if n <= broadcast_hits:
        return rows.join(F.broadcast(hits), "digest", "left_semi"), False
    asked = Filter.of(hits, n)
    return (asked.passing(rows), True) if asked.is_small() else (rows.join(hits, "digest", "left_semi"), False)


def _rows_of(hits: DataFrame, docs: DataFrame, id_col: str, text_col: str, digest, broadcast_hits: int) -> DataFrame:
    """(id, text, digest) of the rows of docs whose digest is among hits."""
    rows, more = _narrowed(_own(docs, id_col, text_col, digest), hits.select("digest"), broadcast_hits)
    return rows.join(hits.select("digest"), "digest", "left_semi") if more else rows


def verify(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, keep: str, digest=sha256, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """Groups of hits by equal bytes: (digest, text, keep_id, group_size)."""
    rows, more = _narrowed(_own(docs, id_col, text_col, digest), hits.select("digest"), broadcast_hits)
    groups = rows.groupBy("digest", "text").agg(_best(keep)("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.join(hits.select("digest"), "digest", "left_semi") if more else groups


@dataclass(frozen=True)
class Run:
    """(digest, keep_id, group_size) in order of digest, and its filter."""

    table: DataFrame
    filter: Filter
    path: str


class Index:
    """Runs of digests, oldest first. `add` decides a batch against itself and all earlier ones."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", digest=sha256, broadcast_hits: int = BROADCAST_HITS):
        self.spark, self.keep, self.digest, self.broadcast_hits, self.runs = spark, keep, digest, broadcast_hits, []

    def entries(self) -> DataFrame:
        """(digest, keep_id, group_size) of all batches."""
        every = self.runs[0].table
        for run in self.runs[1:]:
            every = every.union(run.table)
        return every.groupBy("digest").agg(_best(self.keep)("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(digest, old_id, old_size) of those keys that a run holds; filters first."""
        found = [run.filter.passing(keys.select("digest")).join(run.table, "digest") for run in self.runs]
        every = found[0]
        for here in found[1:]:
            every = every.union(here)
        return every.groupBy("digest").agg(_best(self.keep)("keep_id").alias("old_id"), F.max("group_size").alias("old_size"))

    def _run(self, entries: DataFrame) -> Run:
        table, path = save(entries.sortWithinPartitions("digest"), "lsm-run")
        return Run(table, Filter.of(table.select("digest"), table.count()), path)

    def _append(self, entries: DataFrame) -> None:
        self.runs.append(self._run(entries))
        if len(self.runs) > FAN_OUT:
            old, self.runs = self.runs, [self._run(self.entries())]
            discard(self.spark, *(p for r in old for p in (r.path, r.filter.path)))

    def decide(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows as `add` gives them, entries of the batch's digests)."""
        runs, _ = flush_runs(docs, id_col, text_col, self.digest)
        batch, _ = save(compact(runs, self.keep), "lsm-batch")
        hits = batch.where("group_size > 1").select("digest")
        if not self.runs:
            checked = verify(docs, hits, id_col, text_col, self.keep, self.digest, self.broadcast_hits)
        else:
            if earlier is None:
                raise ValueError("an index of several batches compares bytes with the rows of earlier ones")
            old, _ = save(self.lookup(batch), "lsm-old")
            hits, _ = save(hits.union(old.select("digest")).distinct(), "lsm-hits")
            met = _rows_of(hits, docs, id_col, text_col, self.digest, self.broadcast_hits).select("digest", "text", "id", F.lit(1).cast("long").alias("size"))
            held = _rows_of(old, earlier, id_col, text_col, self.digest, self.broadcast_hits).join(old, "digest").where(F.col("id").eqNullSafe(F.col("old_id")))
            held = held.groupBy("digest", "text").agg(F.min("id").alias("id"), F.max("old_size").alias("size"))
            checked = met.union(held).groupBy("digest", "text").agg(_best(self.keep)("id").alias("keep_id"), F.sum("size").alias("group_size"))
        groups, _ = save(checked.select("digest", F.sha2("text", 512).alias("bytes"), "keep_id", "group_size"), "lsm-verified")
        known = groups.drop("bytes")
        clashing = groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
        decided = lambda rows: rows.select("id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
        if clashing.isEmpty():
            out, entries = decided(runs.join(known, "digest", "left")), known
        else:  # different texts of one digest: told apart by another digest, after their bytes were
            clashing, _ = save(clashing, "lsm-clashing")
            plain = decided(runs.join(clashing, "digest", "left_anti").join(known, "digest", "left"))
            own = _rows_of(clashing, docs, id_col, text_col, self.digest, 0).withColumn("bytes", F.sha2("text", 512))
            out = plain.union(decided(own.join(groups, ["digest", "bytes"])))
            entries = known.groupBy("digest").agg(_best(self.keep)("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        out = out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
        return out, batch.join(entries.select("digest"), "digest", "left_anti").union(entries)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", earlier: DataFrame | None = None) -> DataFrame:
        """One row per row of docs: id, digest, keep_id, group_size, kept, over this batch and all before.

        earlier: the rows of the batches before, whose kept rows' bytes are compared with hits; not read for the first."""
        out, entries = self.decide(docs, id_col, text_col, earlier)
        self._append(entries)
        return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept. keep: "smallest" or "largest"."""
    return Index(docs.sparkSession, keep, digest, broadcast_hits).decide(docs, id_col, text_col)[0]


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """docs with one row of each text: that of the smallest or largest id, null ids last.

    Rows are judged by text and not by id: rows of one id that differ in their texts don't share a fate.
    Of several rows with the text and id to keep, the first in the order of all columns stays."""
    mark = "digest"
    runs, runs_at = flush_runs(docs, id_col, text_col)
    hits, _ = save(compact(runs, keep).where("group_size > 1").select("digest"), "lsm-hits")
    discard(docs.sparkSession, runs_at)
    text = F.col(f"own.{text_col}").cast("string")
    own = docs.select(F.struct(*docs.columns).alias("own")).withColumn(mark, sha256(normalised(text)))
    n = hits.count()
    if n <= broadcast_hits:
        alone, some = own.join(F.broadcast(hits), mark, "left_anti"), own.join(F.broadcast(hits), mark, "left_semi")
    elif (asked := Filter.of(hits, n)).is_small():  # rows that pass without being of hits are groups of one
        alone, some = asked.passing(own, inside=False), asked.passing(own)
    else:
        alone, some = own.join(hits, mark, "left_anti"), own.join(hits, mark, "left_semi")
    number = F.col(f"own.{id_col}").cast("long")
    order = F.struct(number.isNull().alias("nameless"), (number if keep == "smallest" else F.bitwise_not(number)).alias("order"), F.col("own"))
    groups = some.groupBy(mark, normalised(text).alias("bytes")).agg(F.min(order)["own"].alias("own"))
    return alone.select("own.*").union(groups.select("own.*"))
