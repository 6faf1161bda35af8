"""The lexical index: immutable segments of postings, with bounds by block, so that a query reads little.

A segment is a folder: `docs` (a row a document: length, facets, hash), `blocks` (a row a term and range: the
postings' ids, frequencies and lengths as arrays), `terms` (term, its change of document frequency), `totals`
and `dead`. Blocks lie in folders by a bucket of the term's hash, in order of term and range, so a query for a
few terms opens few folders and skips most of their row groups. Buckets and tasks follow the number of postings.

Ranges are about RANGE_DOCS documents of like length. Each block has the largest f and the smallest size of its
postings (a range may have several blocks of a term), so a score that no document of the range exceeds is known
from these columns alone, for any statistics. They are made where the postings are sorted, in the same pass.

A later segment names the documents that it removes from earlier ones (`dead`) and takes their terms out
of the statistics, so frequencies and lengths are exact over all segments, and nothing old is rewritten.
Segments are merged by their rows: dead ones go, lengths and terms are not computed again.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import text
from folio.storage import discard, release_shuffles, save

RANGE_DOCS = 16
#: Postings that a writing task gets on average; buckets at most, parts of a bucket at least (by the ranges' hash).
TASK_POSTINGS = 500_000
BUCKETS = 4096
PARTS = 4
#: Rows whose terms are counted at a time, postings that are sorted at a time, and blocks that are handed on together.
COUNTED_ROWS = 256
SORTED_POSTINGS = 2_000_000
HANDED_BLOCKS = 20_000
#: Texts with other characters than these are cut by text.terms; its result for these is a table.
_USUAL_LETTERS, _USUAL = 0x250, 0x2070
_UNUSUAL = "[^\\x00-\\u024F\\u2000-\\u206F]"
#: Ids of dead documents, or ranges up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_DEAD = 1_000_000
BROADCAST_RANGES = 1_000_000
#: Ids of neighbours are alike, and a segment is written once and read often.
PACKED = {"compression": "zstd"}
FACETS = ("namespace", "book", "type", "tags", "language", "category")


def bucket_of(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def buckets_of(terms: list[str], buckets: int) -> list[int]:
    return sorted({zlib.crc32(t.encode()) % buckets for t in terms})


def layout(postings: int) -> tuple[int, int]:
    """(buckets, parts of each) of so many postings."""
    tasks = -(-postings // TASK_POSTINGS)
    if tasks <= 1:
        return 1, 1
    buckets = min(BUCKETS, 1 << max(0, math.ceil(math.log2(tasks / PARTS))))
    return buckets, max(PARTS, -(-tasks // buckets))


@lru_cache(1)
def _usual_letters() -> np.ndarray:
    """By code point below _USUAL: what text.terms makes of a character, 0 between words."""
    table, plain = np.zeros(_USUAL, np.uint16), dict(zip(*text._accented(), strict=True))
    for c in range(_USUAL_LETTERS):
        small = plain.get(chr(c), chr(c)).lower()
        table[c] = ord(small) if unicodedata.category(small)[0] in "LN" else 0
    return table


def usual_words(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """(number of words of each text, all words) of texts without unusual characters; null: none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    rows = offsets - offsets[0]
    chars = data
    if len(data) and data.max() >= 0x80:
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[rows]
    small = _usual_letters()[chars]
    inside = small != 0
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[rows[:-1][rows[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    letters = small[inside]
    ends = np.append(np.cumsum(inside)[starts] - 1, len(letters))
    if len(letters) and letters.max() >= 0x80:
        ends = np.concatenate([[0], np.cumsum(1 + (letters >= 0x80) + (letters >= 0x800))])[ends]
        letters = np.frombuffer(letters.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters.astype(np.uint8)))
    return np.diff(np.searchsorted(starts, rows)), words


def counted_terms(rows: DataFrame) -> DataFrame:
    """rows with size and counts (array of term, f, in order of terms) for _text; counted within each row, so without a shuffle.

    Texts of usual characters are cut by a table in Arrow batches, others by text.terms, with equal results."""
    kept = [c for c in rows.columns if c != "_text"]
    whole_text = F.coalesce("_text", F.lit(""))
    unusual = whole_text.rlike(_UNUSUAL)
    cut = rows.select(*kept, F.when(~unusual, whole_text).alias("_usual"), F.when(unusual, text.terms(whole_text)).alias("_terms"))
    counts = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("f", T.LongType())]))
    schema = T.StructType([*cut.select(*kept).schema, T.StructField("size", T.IntegerType()), T.StructField("counts", counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED_ROWS):
                batch = whole.slice(at, COUNTED_ROWS)
                lists = batch.column(len(kept) + 1)
                usual_sizes, words = usual_words(batch.column(len(kept)))
                other_sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                numbers = np.arange(batch.num_rows)
                rows_ = np.repeat(numbers, usual_sizes)
                if other_sizes.any():
                    words = pa.concat_arrays([words, lists.flatten().cast(pa.string())])
                    rows_ = np.concatenate([rows_, np.repeat(numbers, other_sizes)])
                words = words.dictionary_encode()
                order = pc.array_sort_indices(words.dictionary).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                own = place[words.indices.to_numpy(zero_copy_only=False)] + rows_ * max(1, len(order))
                found, f = np.unique(own, return_counts=True)
                row, term = np.divmod(found, max(1, len(order)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
                pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(order[term])), pa.array(f.astype(np.int64))], ["term", "f"])
                sizes = (usual_sizes + other_sizes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)], [*kept, "size", "counts"])

    return cut.mapInArrow(run, schema)


def blocks_schema(id_type: str) -> str:
    return f"term string, range long, f long, size int, n int, ids array<{id_type}>, fs array<int>, sizes array<int>, bucket int"


def packed_blocks(postings: DataFrame) -> DataFrame:
    """Blocks of postings (id, term, f, size, range, bucket), each task's in order of bucket, term and range.

    A task sorts SORTED_POSTINGS at a time; a range of more than one such part has several blocks of a term."""
    id_type = dict(postings.dtypes)["id"]

    def blocks(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, f, size, range_, bucket = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(6))
        f, size, range_, bucket = (x.to_numpy(zero_copy_only=False) for x in (f, size, range_, bucket))
        words = terms.dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        by_term = pc.array_sort_indices(words.dictionary).to_numpy()
        own_bucket = np.empty(len(by_term), np.int64)
        own_bucket[codes] = bucket
        by_place = by_term[np.argsort(own_bucket[by_term], kind="stable")]
        place = np.empty(len(by_place), np.int32)
        place[by_place] = np.arange(len(by_place), dtype=np.int32)
        keys = (range_, place[codes])
        order = np.lexsort((ids.to_numpy(zero_copy_only=False), *keys) if pa.types.is_integer(ids.type) and not ids.null_count else keys)
        f, size, range_, codes = f[order], size[order], range_[order], codes[order]
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (range_[1:] != range_[:-1])]))
        ends = pa.array(np.append(starts, len(order)).astype(np.int32))
        most, least = np.maximum.reduceat(f, starts).astype(np.int64), np.minimum.reduceat(size, starts)
        lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(order)), pa.array(f), pa.array(size))]
        first = codes[starts]
        plain = [pa.array(x) for x in (range_[starts], most, least, np.diff(np.append(starts, len(order))).astype(np.int32))]
        made = pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(first)), *plain, *lists, pa.array(own_bucket[first].astype(np.int32))], ["term", "range", "f", "size", "n", "ids", "fs", "sizes", "bucket"])
        for at in range(0, made.num_rows, HANDED_BLOCKS):
            yield made.slice(at, HANDED_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                n += batch.num_rows
            if n >= SORTED_POSTINGS:
                yield from blocks(parts)
                parts, n = [], 0
        if parts:
            yield from blocks(parts)

    return postings.select("id", "term", "f", "size", "range", "bucket").mapInArrow(run, blocks_schema(id_type))


def _unpacked(blocks: DataFrame) -> DataFrame:
    """A row for each posting of blocks: id, term, f, size, range, bucket, segment."""
    each = blocks.select("term", "range", "bucket", "segment", F.inline(F.arrays_zip("ids", "fs", "sizes")))
    return each.select(F.col("ids").alias("id"), "term", F.col("fs").cast("long").alias("f"), F.col("sizes").alias("size"), "range", "bucket", "segment")


def range_bounds(postings: DataFrame) -> DataFrame:
    """(term, range, f, size, bucket): the largest f and smallest size of neighbouring postings of a term and range.

    Postings are read in order of term and range, so nothing is shuffled; where a batch ends inside a range,
    the range has two rows, and the larger bound of them holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            term, range_, f, size, bucket = batch.columns
            new = np.ones(batch.num_rows, bool)
            spans = range_.to_numpy(zero_copy_only=False)
            new[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (spans[1:] != spans[:-1])
            starts = np.flatnonzero(new)
            first = pa.array(starts)
            most, least = np.maximum.reduceat(f.to_numpy(zero_copy_only=False), starts), np.minimum.reduceat(size.to_numpy(zero_copy_only=False), starts)
            yield pa.RecordBatch.from_arrays([term.take(first), range_.take(first), pa.array(most), pa.array(least), bucket.take(first)], ["term", "range", "f", "size", "bucket"])

    return postings.select("term", "range", "f", "size", "bucket").mapInArrow(run, "term string, range long, f long, size int, bucket int")


def _size_class(size: Column) -> Column:
    """Eight classes to each doubling of a length: 250 at most."""
    return F.floor(F.log2(size + 1.0) * 8).cast("long")


@dataclass(frozen=True)
class Segment:
    path: str
    #: Place in the order of segments: removes from those of smaller numbers.
    seq: int = 0
    #: Ids that it removes.
    dead: int = 0


class Postings:
    """The index of one segment below `path`, or of several."""

    def __init__(self, spark: SparkSession, path: str | None = None, segments: list[Segment] | None = None):
        self.spark = spark
        self.segments = sorted(segments or [Segment(path.rstrip("/"))], key=lambda s: s.seq)

    @cached_property
    def _facts(self) -> dict[int, tuple[int, int, int]]:
        """By segment: its change of the number of documents and words, and its buckets."""
        read = [self.spark.read.schema("n long, words long, buckets int").parquet(f"{s.path}/totals").withColumn("seq", F.lit(s.seq)) for s in self.segments]
        return {r.seq: (r.n, r.words, r.buckets) for r in reduce(DataFrame.unionByName, read).collect()}

    @cached_property
    def _id_type(self) -> str:
        return dict(self.spark.read.parquet(f"{self.segments[0].path}/docs").dtypes)["id"]

    def _read(self, name: str, schema: str | None = None, terms: list[str] | None = None) -> DataFrame:
        """All segments' rows, with the segment; terms: only the buckets of these are read."""
        out = []
        for s in self.segments:
            rows = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{s.path}/{name}")
            if terms is not None:
                rows = rows.where(F.col("bucket").isin(buckets_of(terms, self._facts[s.seq][2])) & F.col("term").isin(terms))
            out.append(rows.withColumn("segment", F.lit(s.seq)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows (id, segment) whose document no later segment removes."""
        removing = [s for s in self.segments if s.dead and s.seq > self.segments[0].seq]
        if not removing:
            return rows
        read = [self.spark.read.schema(f"id {self._id_type}").parquet(f"{s.path}/dead").select("id", F.lit(s.seq).alias("_until")) for s in removing]
        dead = reduce(DataFrame.union, read).groupBy("id").agg(F.max("_until").alias("_until")).withColumnRenamed("id", "_id")
        dead = F.broadcast(dead) if sum(s.dead for s in removing) <= BROADCAST_DEAD else dead
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_until")), "left_anti")

    @property
    def docs(self) -> DataFrame:
        return self._alive(self._read("docs"))

    @property
    def postings(self) -> DataFrame:
        return self._alive(_unpacked(self._read("blocks", blocks_schema(self._id_type))))

    @property
    def terms(self) -> DataFrame:
        """(term, df) over all segments."""
        rows = self._read("terms", "term string, df long, own long, bucket int")
        return rows.select("term", "df") if len(self.segments) == 1 else rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(self) -> tuple[int, float]:
        """(documents, their mean length in terms)"""
        n, words = (sum(f[i] for f in self._facts.values()) for i in (0, 1))
        return n, words / max(n, 1)

    def of(self, wanted: list[str], ranges: DataFrame | None = None) -> DataFrame:
        """Postings of these terms; with ranges (segment, range) those of these ranges."""
        found = self._read("blocks", blocks_schema(self._id_type), wanted)
        if ranges is not None:
            # of like lengths, so mostly neighbours: the scan skips what lies outside their span
            span = ranges.agg(F.min("range").alias("low"), F.max("range").alias("high"), F.count("*").alias("n")).first()
            few = F.broadcast(ranges.select("segment", "range")) if span.n <= BROADCAST_RANGES else ranges.select("segment", "range")
            found = found.where(F.col("range").between(span.low or 0, span.high or 0)).join(few, ["segment", "range"], "left_semi")
        return self._alive(_unpacked(found))

    def bounds(self, wanted: list[str]) -> DataFrame:
        """(segment, range, term, f, size): what bounds the scores of each range."""
        return self._read("blocks", "term string, range long, f long, size int, bucket int", wanted).select("segment", "range", "term", "f", "size")

    def frequencies(self, wanted: list[str]) -> dict[str, int]:
        """Documents that hold each term: a row for each of a query's few terms."""
        rows = self._read("terms", "term string, df long, own long, bucket int", wanted).groupBy("term").agg(F.sum("df").alias("df"))
        return {r.term: r.df for r in rows.collect()}

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "id", text_cols: tuple[str, ...] = ("text",), gone: DataFrame | None = None) -> Postings:
        """A segment of docs below path; text_cols: the fields that are searched, as one text.

        gone: documents of earlier segments that it removes, with the same columns."""
        facets = [c for c in FACETS if c in docs.columns]
        whole = F.concat_ws(" ", *(F.col(c) for c in text_cols))
        staged, at = save(counted_terms(docs.select(F.col(id_col).alias("id"), *facets, F.sha2(whole, 256).alias("text_hash"), whole.alias("_text"))), "postings-staged", **PACKED)
        lost = None
        if gone is not None:
            lost, lost_at = save(counted_terms(gone.select(F.col(id_col).alias("id"), whole.alias("_text"))), "postings-gone", **PACKED)
        own = cls(docs.sparkSession, path)
        postings = staged.select("id", "size", F.explode("counts").alias("c")).select("id", "c.term", "c.f", "size")
        minus = None if lost is None else lost.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        own._write(staged.drop("counts"), postings, minus, lost, spent=at)
        if gone is not None:
            discard(docs.sparkSession, lost_at)
        release_shuffles(docs.sparkSession)
        return own

    @classmethod
    def merge(cls, index: Postings, path: str, first: bool) -> Postings:
        """One segment of all of index's; first: there is none before them, so what they remove is settled."""
        own = cls(index.spark, path)
        changes = index._read("terms", "term string, df long, own long, bucket int").groupBy("term").agg(F.sum("df").alias("df"))
        n, words = (sum(f[i] for f in index._facts.values()) for i in (0, 1))
        removed = None
        if not first and any(s.dead for s in index.segments):
            removed = reduce(DataFrame.union, [index.spark.read.schema(f"id {index._id_type}").parquet(f"{s.path}/dead") for s in index.segments if s.dead]).distinct()
        own._write(index.docs.drop("segment", "range"), index.postings.select("id", "term", "f", "size"), None, removed, changes, (n, words))
        return own

    def _write(self, docs: DataFrame, postings: DataFrame, minus: DataFrame | None, dead: DataFrame | None, changes: DataFrame | None = None, totals: tuple[int, int] | None = None, spent: str | None = None) -> None:
        """docs: id, size, facets, text_hash; postings: id, term, f, size; minus: (term, df) of dead documents; changes and totals: known statistics;
        spent: where docs and postings lie, deleted when they are written."""
        path, read = self.segments[0].path, self.spark.read
        classes = docs.groupBy(_size_class(F.col("size")).alias("c")).agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()
        n, words = sum(r.n for r in classes), sum(r.words or 0 for r in classes)
        buckets, parts = layout(words)
        counts_of = {r.c: -(-r.n // RANGE_DOCS) for r in classes}
        ranges = F.array(*(F.lit(counts_of.get(c, 1)).cast("long") for c in range(max(counts_of, default=0) + 1)))  # by place: asked for each posting
        own_class = _size_class(F.col("size"))
        range_ = F.shiftleft(own_class, 40) + F.pmod(F.xxhash64("id"), F.coalesce(F.get(ranges, own_class.cast("int")), F.lit(1).cast("long")))
        ranged = docs.withColumn("range", range_)
        tasks = max(1, -(-n // 500_000))
        ranged.repartitionByRange(tasks, "range", "id").sortWithinPartitions("range", "id").write.options(**PACKED).mode("overwrite").parquet(f"{path}/docs")
        # what follows from a row's other columns isn't shuffled
        narrow = postings.select("id", "term", F.col("f").cast("int").alias("f"), "size")
        dealt = narrow.repartition(buckets * parts, bucket_of(F.col("term"), buckets), F.pmod(F.xxhash64(range_), F.lit(parts)))
        dealt = packed_blocks(dealt.select("id", "term", "f", "size", range_.alias("range"), bucket_of(F.col("term"), buckets).alias("bucket")))
        # they come in this order: the sort only tells the writer so
        dealt.sortWithinPartitions("bucket", "term", "range").write.options(**PACKED).mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        del dealt, narrow
        if spent:
            discard(self.spark, spent)
        release_shuffles(self.spark)
        written = read.schema("term string, n int, bucket int").parquet(f"{path}/blocks")
        counts = written.groupBy("bucket", "term").agg(F.sum("n").alias("own"))
        plus = counts.select("term", F.col("own").alias("df"), "own")
        if changes is not None:
            change = changes.withColumn("own", F.lit(0).cast("long")).unionByName(plus.withColumn("df", F.lit(0).cast("long")))
        else:
            change = plus if minus is None else plus.unionByName(minus.select("term", (-F.col("df")).alias("df"), F.lit(0).cast("long").alias("own")))
        if changes is not None or minus is not None:
            change = change.groupBy("term").agg(F.sum("df").alias("df"), F.sum("own").alias("own")).where("df <> 0 OR own <> 0")
        change = change.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition(buckets, "bucket")
        change.sortWithinPartitions("bucket", "term").write.options(**PACKED).mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        lost_n, lost_words = 0, 0
        if dead is not None:
            dead.select("id").coalesce(max(1, -(-n // 500_000))).write.options(**PACKED).mode("overwrite").parquet(f"{path}/dead")
            if totals is None:
                row = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
                lost_n, lost_words = row.n, row.words
        sums = totals or (n - lost_n, words - lost_words)
        self.spark.range(1).select(F.lit(sums[0]).cast("long").alias("n"), F.lit(sums[1]).cast("long").alias("words"), F.lit(buckets).alias("buckets")).write.options(**PACKED).mode("overwrite").parquet(f"{path}/totals")
        self.__dict__.pop("_facts", None)

    def drop(self) -> None:
        discard(self.spark, *(s.path for s in self.segments))
