"""Importance resampling of a corpus towards a target distribution, over hashed n-gram features.

A feature is a run of 1 to n consecutive words joined by one space; its bucket is the CRC-32 of its
bytes modulo the number of buckets. No such run is ever put together: a worker computes each word's CRC
once, and CRCs of runs are composed from them. CRC-32 is linear over GF(2), so

    crc(a + b) = Z(len(b)) crc(a) ^ crc(b)

where Z(m) appends m zero bytes, a 32 x 32 matrix. Z(1), Z(2), Z(4), ... are squares of each other, kept
as lookup tables of four bytes; Z(m) is the product of those at the bits of m.

1. Counts: a task adds up the buckets of its documents and hands on one row a bucket. The sums of both
   corpora are all that the driver gets: ``buckets`` numbers each, whatever the size of the corpora.
2. A bucket's gain is floor(1000 ln of its smoothed share in the target over that in the corpus); a
   document's weight is the floored mean of its features' gains.
3. The score adds Gumbel noise that hangs on the document's id alone, so the highest scores are a draw
   without replacement in proportion to exp(weight / 1000). Ranks come from a range sort and the sizes of
   its partitions; no task sees more than its range.

Words are runs of characters from [0-9a-z] and beyond ASCII, after lower-casing A-Z.

Edge cases: null and empty texts have no features and weight 0. Repeated rows are counted, scored and
drawn each for itself, with the same noise. A null id has the noise of an empty one and comes last among ties. Fewer
documents than ``least_words`` allow: none is drawn. An empty corpus gives no rows; an empty target makes
all gains those of an even target. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import sliced
from folio.storage import saved

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
SEED = 7
#: Words that a worker remembers the CRC of at most, and bytes of a text that are split together.
REMEMBERED = 400_000
SLICE_BYTES = 1 << 20
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _product(matrix: list[int], vector: int) -> int:
    out, at = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[at]
        vector >>= 1
        at += 1
    return out


@cache
def _zeros(power: int) -> list[int]:
    """Images of the 32 single bits under appending 2**power zero bytes."""
    if power < 0:
        bit = [POLYNOMIAL, *(1 << i for i in range(31))]  # one zero bit: -3; each square doubles it
        for _ in range(power + 3):
            bit = [_product(bit, x) for x in bit]
        return bit
    half = _zeros(power - 1)
    return [_product(half, x) for x in half]


@cache
def _tables(power: int) -> np.ndarray:
    """The same matrix as four tables, one for each byte of a CRC."""
    columns = _zeros(power)
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            out[place, 1 << bit : 2 << bit] = out[place, : 1 << bit] ^ np.uint32(columns[8 * place + bit])
    return out


def _applied(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return table[0][crcs & 255] ^ table[1][(crcs >> 8) & 255] ^ table[2][(crcs >> 16) & 255] ^ table[3][crcs >> 24]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Z(length) of each CRC."""
    out = crcs.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> power) & 1)
        out[at] = _applied(_tables(power), out[at])
    return out


def run_crcs(words: np.ndarray, lengths: np.ndarray, room: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where they start, CRCs) of all runs of 1, 2, ... longest words; room: words from each one to its text's end."""
    space = np.uint32(zlib.crc32(b" "))
    start, crcs = np.arange(len(words)), words
    yield start, crcs
    for n in range(2, longest + 1):
        on = room[start] >= n
        start, crcs = start[on], crcs[on]
        last = start + n - 1
        crcs = shifted(_applied(_tables(0), crcs) ^ space, lengths[last]) ^ words[last]
        yield start, crcs


class _Known(dict):
    """A word's CRC, and its length above it, remembered."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = zlib.crc32(word) | len(word) << 32
        return out


class Features:
    """Buckets of the features of texts."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest, self.known = buckets, longest, _Known()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text; text and bucket of each feature)"""
        if len(self.known) > REMEMBERED:
            self.known = _Known()
        found = []
        for text in texts:
            words = text.translate(_WORDS).split()
            found.append(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        both = np.concatenate([*found, np.empty(0, np.uint64)])
        crcs, lengths = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        room = np.cumsum(sizes)[text] - np.arange(len(text))
        runs = list(run_crcs(crcs, lengths, room, self.longest))
        return sizes, np.concatenate([text[at] for at, _ in runs]), np.concatenate([c for _, c in runs]) % np.uint32(self.buckets)


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [x or b"" for x in batch.column(at).to_pylist()]


def _own(docs: DataFrame, text_col: str) -> Column:
    return F.col(text_col).cast("string").cast("binary").alias("text")


def count(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = Features(buckets, longest), np.zeros(buckets, np.int64)
        for part in sliced(batches):
            sums += np.bincount(made.of(_texts(part, 0))[2], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(_own(docs, text_col)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold logarithms of the buckets' smoothed shares in the target over those in the corpus, floored."""
    size = len(corpus)
    share = (target + 1) * float(corpus.sum() + size) / ((corpus + 1) * float(target.sum() + size))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    own = docs.select(F.col(id_col).alias("id"), _own(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(len(gain), longest)
        for part in sliced(batches):
            sizes, text, bucket = made.of(_texts(part, 1))
            n = np.bincount(text, minlength=len(sizes))
            order = np.argsort(text, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in (sizes, n, weight))], ["id", "n_words", "n_features", "weight"])

    kinds = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    return own.mapInArrow(run, T.StructType([T.StructField("id", own.schema["id"].dataType), *kinds]))


def noise(identifier: Column, seed: int = SEED) -> Column:
    """Gumbel noise, thousandfold and floored, by the first 32 bits of the SHA-256 of seed:identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, percent: int, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed with score and rank: the given share of the documents with enough words, highest scores first; others have no rank."""
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("at", F.monotonically_increasing_id())
    scored = saved(scored, "resample-scored")
    able = scored.where(F.col("n_words") >= least_words)
    taken = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("at")]  # at: so that repeated rows don't share a place
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resample-sorted")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each of the sort's partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= taken, rank))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionAll(rest.select(*out))
