"""Removal of repeated byte strings by difference-cover blockwise suffix sorting.

Every byte that lies in a string of ``length`` bytes which also starts earlier (smaller id, or the
same document further left) is removed. Strings never cross documents and are judged on the input.

1. Whole copies. Texts are grouped by digest; of equal ones only the first goes on. In the others
   every string starts earlier.
2. Buckets. A string's bucket is its *anchor*: the leftmost of the smallest hashes of its k-grams.
   The anchor depends on the string only, so equal strings share a bucket. Neighbouring strings of
   one anchor form a *piece* (at most 2 * length bytes). Pieces of equal content are settled by
   hash: the first stays, the others' strings all start earlier. Each task settles its own pieces
   first, many documents' at a time, so a passage in any number of them sends few rows to the shuffle. Buckets
   with one piece left hold nothing repeated; only pieces of the other buckets fetch their bytes.
3. Blocks. A task gathers whole buckets into blocks of bounded size and sorts their suffixes one
   bucket (of first bytes) at a time: by their first PERIOD bytes, and long ties by the ranks of a
   difference-cover sample, computed once a block. Any two suffixes reach sampled positions by one
   common step of less than PERIOD, whose ranks decide. Neighbours in this order that agree in
   `length` bytes are equal strings; all but the first start earlier.
4. A bucket with more than ``bucket_pieces`` pieces isn't gathered but split: its strings are dealt to
   ranges of the place that the anchor has in them, of half the width each time, and within a range to
   buckets by the bytes that all its strings cover. Equal strings stay together. Parts of equal bytes are
   settled, byte by byte, in each batch and after the shuffle, and what is left goes to blocks (3) unless
   it is still too many and is split again. A range of one place leaves equal strings only.
5. Removed runs are merged by document and cut out.

Equal content of pieces (2) is judged by 128 bits of hash (64 of the bucket and 64 of the piece) and by
size; all else is compared byte by byte.

Edge cases: null text counts as empty. Texts shorter than `length` are left alone. A null id comes
before all others. Equal rows are one document. Rows of one id with different texts are taken one
after another, in the order of their digests. Empty tables give an empty result. Only the id and
text columns are read, so others can't clash. Long texts are read in overlapping slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.batches import small_batches
from folio.storage import discard, release_shuffles, save

LENGTH = 100
GRAM = 32
PERIOD = 32
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
BUCKET_PIECES = 512
#: Pieces that a task settles at a time before the shuffle.
SETTLED = 400_000
#: Exceptional rows (copies, ids with several texts) up to which they are broadcast.
BROADCAST_ROWS = 500_000
NULL_ID = -(1 << 63)
#: A document's bytes lie at its rank among texts of its id, times this (more than any text has), plus the offset.
STRIDE = 1 << 31


# --- anchors -------------------------------------------------------------------------------------


@lru_cache(1)
def _byte_hashes() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position on (gram: a power of 2)."""
    out, base, width = _byte_hashes()[data], 0x9E3779B97F4A7C15 | 1, 1
    while width < gram:
        out = out[:-width] * np.uint64(base) + out[width:]
        base, width = base * base % 2**64, 2 * width
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out


def window_minimum(values: np.ndarray, window: int) -> np.ndarray:
    out, width = values, 1
    while 2 * width <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = window - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first start, last start, anchor) of the runs of strings with one anchor."""
    values = np.frombuffer(data, np.uint8)
    if len(values) < length:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    hashes = gram_hashes(values, gram)
    low = np.uint64((1 << 24) - 1)  # a slice is shorter than that: ties of the upper bits go to the left
    least = window_minimum(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    at = anchor[first]
    return hashes[at], first, last, at


def slices(data: bytes, length: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) such that each string of `length` bytes starts in one slice and lies in it."""
    for at in range(0, max(len(data) - length + 1, 0), size):
        yield at, data[at : at + size + length - 1]


ROWS = "kind int, bucket long, piece long, shape long, id long, start long, stop long"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
REMOVED, PIECE = 0, 1


def _batch(kind: int, bucket, piece, shape, ids, start, stop) -> pa.RecordBatch:
    n = len(ids)
    signed = lambda x: pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(signed, (bucket, piece, shape, ids, start, stop))], _NAMES)


def merged(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of [start, stop) by id."""
    if not len(ids):
        return ids, start, stop
    order = np.lexsort((start, ids))
    ids, start, stop = ids[order], start[order], stop[order]
    fresh = np.r_[True, ids[1:] != ids[:-1]]
    group = np.cumsum(fresh) - 1
    # the furthest stop so far within the id: stops are shifted by the group to keep groups apart
    reach = np.empty_like(stop)
    bounds = np.r_[np.flatnonzero(fresh), len(ids)]
    for g in range(len(bounds) - 1) if len(bounds) < len(ids) + 1 else ():
        a, b = bounds[g], bounds[g + 1]
        reach[a:b] = np.maximum.accumulate(stop[a:b])
    if len(bounds) == len(ids) + 1:
        reach = stop
    begin = np.flatnonzero(np.r_[True, (start[1:] > reach[:-1]) | (group[1:] != group[:-1])])
    end = np.r_[begin[1:], len(ids)] - 1
    return ids[begin], start[begin], reach[end]


def _settle(bucket, piece, shape, ids, start, stop) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the first row of each (bucket, piece, shape), indices of the others)."""
    order = np.lexsort((start, ids, shape, piece, bucket))
    b, p, s = bucket[order], piece[order], shape[order]
    first = np.ones(len(order), bool)
    first[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    return order[first], order[~first]


def _removed_and_rest(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Settles what one batch holds."""
    if not rows:
        return
    bucket, piece, shape, ids, start, stop = (np.concatenate(x) for x in zip(*rows, strict=True))
    stay, go = _settle(bucket, piece, shape, ids, start, stop)
    if len(go):
        i, a, b = merged(ids[go], start[go], stop[go] + length)
        yield _batch(REMOVED, i, np.zeros(len(i)), np.zeros(len(i)), i, a, b)
    yield _batch(PIECE, bucket[stay], piece[stay], shape[stay], ids[stay], start[stay], stop[stay])


def piece_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """ROWS: pieces by bucket, and runs that a batch could settle itself. docs: id, base, text (binary).

    start and stop of a PIECE are its first and last string's start; shape tells apart where in the
    piece the anchor lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        rows, held = [], 0
        for batch in batches:
            for key, base, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = raw.as_py()
                for at, part in slices(text, length):
                    bucket, first, last, anchor = pieces(part, length, gram)
                    view = memoryview(part)
                    piece = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
                    rows.append((bucket, piece, (last - first) << 20 | anchor - first, np.full(len(first), key), base + at + first, base + at + last))
                    held += len(first)
                if held > SETTLED:
                    yield from _removed_and_rest(rows, length)
                    rows, held = [], 0
        yield from _removed_and_rest(rows, length)

    return small_batches(docs.select("id", "base", "text")).mapInArrow(run, ROWS)


def settle(rows: DataFrame, length: int) -> DataFrame:
    """ROWS of the shuffle: removed runs, and the pieces of buckets with several."""
    dealt = rows.repartition("bucket").sortWithinPartitions("kind", "bucket", "piece", "shape", "id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, last_bucket = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, bucket, piece, shape, ids, start, stop = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            done = kind == REMOVED
            own = np.flatnonzero(~done)
            b, p, s = bucket[own], piece[own], shape[own]
            first = np.ones(len(own), bool)
            first[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1])
            if len(own):
                first[0] = (b[0], p[0], s[0]) != key
                key = (b[-1], p[-1], s[-1])
            go = own[~first]
            i, x, y = merged(np.r_[ids[done], ids[go]], np.r_[start[done], start[go]], np.r_[stop[done], stop[go] + length])
            if len(i):
                yield _batch(REMOVED, i, np.zeros(len(i)), np.zeros(len(i)), i, x, y)
            stay = own[first]
            table = np.stack([bucket[stay], piece[stay], shape[stay], ids[stay], start[stay], stop[stay]], axis=1)
            if waiting is not None:
                table = np.concatenate([waiting, table])
            if not len(table):
                continue
            same = table[1:, 0] == table[:-1, 0]
            before = np.r_[table[0, 0] == last_bucket, same]
            after = np.r_[same, False]
            # the last piece waits for the next batch, unless its bucket is known to hold another
            waiting = None if before[-1] else table[-1:]
            sent = before | after
            if waiting is not None:
                sent[-1] = False
            last_bucket = table[-1, 0] if before[-1] else None
            if sent.any():
                yield _batch(PIECE, *table[sent].T)

    return dealt.mapInArrow(run, ROWS)


# --- difference-cover blockwise sorting ------------------------------------------------------------


@lru_cache(4)
def difference_cover(period: int) -> tuple[int, ...]:
    """Residues whose differences give every residue: greedily, the one that adds most differences."""
    cover, reached = [0, 1], {0, 1, period - 1}
    while len(reached) < period:
        gain = lambda r: len({(r - c) % period for c in cover} | {(c - r) % period for c in cover} | reached)
        cover.append(max((r for r in range(period) if r not in cover), key=lambda r: (gain(r), -r)))
        reached = {(a - b) % period for a in cover for b in cover}
    return tuple(sorted(cover))


def _heads(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first `width` bytes from each position as big-endian numbers of 8 bytes, a row each."""
    return text[at[:, None] + np.arange(width)].view(">u8").astype(np.uint64)


def _rank(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows, equal rows alike; the first column is the most significant."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), np.int64)
    for c in columns:
        x = c[order]
        fresh[1:] |= x[1:] != x[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


class CoverSample:
    """Ranks of the suffixes at sampled positions, right to `depth` bytes at least."""

    def __init__(self, text: np.ndarray, depth: int, period: int = PERIOD):
        self.period, cover = period, difference_cover(period)
        self.size = len(text)
        residues = np.zeros(period, bool)
        residues[list(cover)] = True
        padded = np.concatenate([text, np.zeros(2 * period, np.uint8)])
        positions = np.flatnonzero(residues[np.arange(self.size) % period])
        ranks = _rank(list(_heads(padded, positions, period).T)) + 1
        self.rank = np.zeros(self.size + period + 1, np.int64)  # beyond the end: 0, less than all
        self.rank[positions] = ranks
        step = period
        while step < depth:  # position + step is sampled as position is
            ranks = _rank([self.rank[positions], self.rank[np.minimum(positions + step, self.size)]]) + 1
            self.rank[positions] = ranks
            step *= 2
        # the step, below period, that takes residues i and j both to the sample
        self.step = np.array([[next(d for d in range(period) if residues[(i + d) % period] and residues[(j + d) % period]) for j in range(period)] for i in range(period)])
        self.padded = padded

    def compare(self, i: int, j: int) -> int:
        """Of two suffixes that agree in their first `period` bytes."""
        d = self.step[i % self.period, j % self.period]
        a, b = self.rank[min(i + d, self.size)], self.rank[min(j + d, self.size)]
        return int(a > b) - int(a < b)


def blockwise_order(text: np.ndarray, starts: np.ndarray, depth: int, period: int = PERIOD, bucket_suffixes: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes in order, whether each equals its predecessor to `depth` bytes), a bucket at a time.

    Buckets are ranges of first bytes with at most bucket_suffixes suffixes, where these differ."""
    if not len(starts):
        return
    sample = CoverSample(text, depth, period)
    text = np.concatenate([sample.padded, np.zeros(depth, np.uint8)])
    lead = (text[starts].astype(np.int32) << 8) | text[starts + 1]
    starts, lead = starts[order := np.argsort(lead, kind="stable")], lead[order]
    edges = np.r_[np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]), len(starts)]
    at = 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + bucket_suffixes, "right")) - 1)
        yield _sorted_bucket(text, starts[edges[at] : edges[end]], sample, depth)
        at = end


def _sorted_bucket(text: np.ndarray, own: np.ndarray, sample: CoverSample, depth: int) -> tuple[np.ndarray, np.ndarray]:
    period = sample.period
    heads = list(_heads(text, own, period).T)
    tie = _rank(heads)
    # within a residue, one step leads to the sample: its rank orders the suffixes at once
    residue = own % period
    reached = sample.rank[np.minimum(own + sample.step[residue, residue], sample.size)]
    order = np.lexsort((reached, residue, tie))
    own, tie, residue, reached = own[order], tie[order], residue[order], reached[order]
    alike = np.zeros(len(own), bool)
    alike[1:] = (tie[1:] == tie[:-1]) & (residue[1:] == residue[:-1]) & (reached[1:] == reached[:-1])
    lead = np.flatnonzero(~alike)  # one suffix for all that are equal within a residue
    size = np.diff(np.r_[lead, len(own)])
    group = tie[lead]
    edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(lead)]
    rows = np.arange(len(lead))
    several = np.flatnonzero(np.diff(edges) > 1)
    key = cmp_to_key(lambda a, b: sample.compare(own[lead[a]], own[lead[b]]))
    for g in several:
        a, b = edges[g], edges[g + 1]
        if residue[lead[a]] != residue[lead[b - 1]]:  # of one residue: in order already
            rows[a:b] = sorted(range(a, b), key=key)
    equal = np.zeros(len(lead), bool)
    near = np.flatnonzero(group[rows[1:]] == group[rows[:-1]]) + 1
    for at in range(0, len(near), 4096):
        some = near[at : at + 4096]
        span = np.arange(period, depth)
        left, right = own[lead[rows[some - 1]]], own[lead[rows[some]]]
        equal[some] = (text[left[:, None] + span] == text[right[:, None] + span]).all(axis=1)
    out = np.concatenate([np.arange(lead[r], lead[r] + size[r]) for r in rows])
    same = np.ones(len(out), bool)
    same[np.cumsum(size[rows]) - size[rows]] = equal
    return own[out], same


def repeated(data: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of the strings in a block of pieces that also start earlier."""
    sizes = np.array([len(x) for x in data], np.int64)
    text = np.frombuffer(b"".join(data), np.uint8)
    offset = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(data)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offset[owner] + inside
    piece_of = np.zeros(len(text), np.int64)
    piece_of[offset] = 1
    piece_of = np.cumsum(piece_of) - 1
    late_ids, late_starts = [], []
    for order, same in blockwise_order(text, at, length):
        group = np.cumsum(~same)
        p = piece_of[order]
        i, s = ids[p], starts[p] + order - offset[p]
        by = np.lexsort((s, i, group))
        first = np.r_[True, group[by][1:] != group[by][:-1]]
        # a string at the very place of the first one is the same string, met in another piece
        head = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
        late = by[(i[by] != i[head]) | (s[by] != s[head])]
        late_ids.append(i[late])
        late_starts.append(s[late])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *late_ids]), np.concatenate([none, *late_starts])


def sorted_blocks(found: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ROWS of removed runs. found: bucket, id, start, bytes (of a piece)."""
    dealt = found.select("bucket", "id", "start", "bytes").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def settled() -> Iterator[pa.RecordBatch]:
            if held:
                data = [x[3] for x in held]
                i, s = repeated(data, np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64), length)
                i, a, b = merged(i, s, s + length)
                yield _batch(REMOVED, i, np.zeros(len(i)), np.zeros(len(i)), i, a, b)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > block_bytes and row[0] != held[-1][0]:
                    yield from settled()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield from settled()

    return dealt.mapInArrow(run, ROWS)


PARTS = "kind int, bucket long, id long, start long, stop long, anchor int, bytes binary"
_PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]


def _part_batch(removed: tuple[np.ndarray, np.ndarray, np.ndarray], rows: list[tuple[int, int, int, int, int, bytes]]) -> pa.RecordBatch:
    """A batch of PARTS; rows: bucket, id, start, stop, anchor, bytes."""
    i, a, b = (x.tolist() for x in removed)
    none = [None] * len(i)
    columns = [[REMOVED] * len(i) + [PIECE] * len(rows), i + [r[0] for r in rows], i + [r[1] for r in rows], a + [r[2] for r in rows], b + [r[3] for r in rows], [0] * len(i) + [r[4] for r in rows], none + [r[5] for r in rows]]
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _PART_NAMES)


def _runs_of(rows: list[tuple[int, int, int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, start, stop = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
    return merged(ids, start, stop + length)


def split_piece(anchor: int, text: bytes, length: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first start, last start) of the parts of a piece: runs of strings whose anchor lies in one range of places."""
    import xxhash

    last = len(text) - length
    for g in range((anchor - last) // width, anchor // width + 1):
        core = text[anchor - g * width : anchor - (g + 1) * width + 1 + length]  # what all strings of the range cover
        yield xxhash.xxh3_64_intdigest(core, g) - (1 << 63), max(0, anchor - (g + 1) * width + 1), min(last, anchor - g * width)


def split_pieces(found: DataFrame, length: int, width: int) -> DataFrame:
    """PARTS: pieces (bucket, id, start, anchor, bytes) cut up, those of equal bytes settled in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[tuple[int, bytes], tuple] = {}
            go: list[tuple] = []
            for key, start, anchor, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for bucket, a, b in split_piece(anchor, text, length, width):
                    row = (bucket, key, start + a, start + b, anchor - a, text[a : b + length])
                    held = first.setdefault((bucket, row[5]), row)
                    if held is not row:
                        if row[1:3] < held[1:3]:
                            first[bucket, row[5]], row = row, held
                        go.append(row)
            yield _part_batch(_runs_of(go, length), list(first.values()))

    return found.select("id", "start", "anchor", "bytes").mapInArrow(run, PARTS)


def settle_parts(parts: DataFrame, length: int) -> DataFrame:
    """PARTS: removed runs, and the first of all parts of equal bytes in a bucket."""
    dealt = parts.repartition("bucket", "bytes").sortWithinPartitions("kind", "bucket", "bytes", "id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            stay, go, done = [], [], []
            for kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == REMOVED:
                    done.append(row)
                    continue
                (stay if (row[0], row[5]) != last else go).append(row)
                last = row[0], row[5]
            i, a, b = _runs_of(go, length)
            more = [np.array([r[c] for r in done], np.int64) for c in (1, 2, 3)]
            yield _part_batch(merged(np.r_[i, more[0]], np.r_[a, more[1]], np.r_[b, more[2]]), stay)

    return dealt.mapInArrow(run, PARTS)


# --- the whole job ---------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_pieces: int = BUCKET_PIECES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (binary)."""
    if gram & (gram - 1) or not gram <= length:
        raise ValueError("gram must be a power of 2, and not more than length")
    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} at least")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    own = own.withColumn("id", F.coalesce("doc", F.lit(NULL_ID))).withColumn("digest", F.unhex(F.sha2("text", 256)))

    # copies of a whole text, and ids with several texts: the exceptions, known by (id, digest)
    texts = own.groupBy("id", "digest").agg(F.count("*").alias("n"))
    texts, texts_at = save(texts, "suffix-texts")
    first, first_at = save(texts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("ids")).where("ids > 1").select("digest", "first"), "suffix-firsts")
    copies = texts.join(F.broadcast(first) if first.count() <= broadcast_rows else first, "digest").where("id > first").select("id", "digest", F.lit(True).alias("copy"))
    turns = _turns(texts)
    odd, odd_at = save(copies.join(turns, ["id", "digest"], "full").select("id", "digest", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn")), "suffix-odd")
    few = odd.count() <= broadcast_rows
    marked = own.join(F.broadcast(odd) if few else odd, ["id", "digest"], "left")
    marked = marked.select("doc", "id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), (F.coalesce("turn", F.lit(0)) * STRIDE).cast("long").alias("base"), F.col("digest"))
    alone = marked.where(~F.col("copy") & (F.octet_length("text") >= length)).select("id", "base", "text")

    runs, runs_at = save(settle(piece_rows(alone, length, gram), length), "suffix-runs")
    release_shuffles(spark)
    removed = [runs.where(F.col("kind") == REMOVED).select("id", "start", "stop")]
    wanted = runs.where(F.col("kind") == PIECE).select("id", "bucket", "start", "stop", F.col("shape").bitwiseAND((1 << 20) - 1).cast("int").alias("anchor"))
    sizes, sizes_at = save(wanted.groupBy("bucket").agg(F.count("*").alias("pieces")).where(F.col("pieces") > bucket_pieces).select("bucket", F.lit(True).alias("crowded")), "suffix-crowded")
    wanted = wanted.join(F.broadcast(sizes) if sizes.count() <= broadcast_rows else sizes, "bucket", "left")
    found, found_at = save(_with_bytes(alone, wanted, length), "suffix-pieces")
    release_shuffles(spark)
    crowded = F.col("crowded").isNotNull()
    paths = [first_at, sizes_at]

    def sort(pieces: DataFrame) -> None:
        table, path = save(sorted_blocks(pieces, length).select("id", "start", "stop"), "suffix-runs")
        removed.append(table)
        paths.append(path)

    sort(found.where(~crowded))
    todo, width = found.where(crowded), length - gram + 1
    while not todo.isEmpty():
        width = -(-width // 2)
        parts, parts_at = save(settle_parts(split_pieces(todo, length, width), length), "suffix-parts")
        removed.append(parts.where(F.col("kind") == REMOVED).select("id", "start", "stop"))
        own_parts = parts.where(F.col("kind") == PIECE)
        several, several_at = save(own_parts.groupBy("bucket").agg(F.count("*").alias("pieces")).where("pieces > 1"), "suffix-crowded")
        met = own_parts.join(F.broadcast(several) if several.count() <= broadcast_rows else several, "bucket")
        sort(met.where(F.col("pieces") <= bucket_pieces) if width > 1 else met)
        todo = met.where(F.col("pieces") > bucket_pieces) if width > 1 else met.limit(0)
        paths += [parts_at, several_at]
    cuts = removed[0]
    for more in removed[1:]:
        cuts = cuts.union(more)
    base = _base(F.col("start"))
    spans, _ = save(cuts.groupBy("id", base.alias("base")).agg(F.collect_list(F.struct((F.col("start") - base).alias("start"), (F.col("stop") - base).alias("stop"))).alias("cuts")), "suffix-cuts")
    discard(spark, found_at, runs_at, texts_at, *paths)
    release_shuffles(spark)
    return _cut(marked.join(spans, ["id", "base"], "left").select("doc", "text", "copy", "cuts"), length)


def _base(place: Column) -> Column:
    """Where the text begins that a place lies in."""
    return place.bitwiseAND(-STRIDE)


def _turns(texts: DataFrame) -> DataFrame:
    """(id, digest, turn) of ids with several texts: 0, 1, ... in the order of digests. Counted by the digests'
    first bytes, so that one id, or null, may have any number of texts."""
    several = texts.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select("id")
    own = texts.join(several, "id").select("id", "digest", F.substring("digest", 1, 2).alias("lead"))
    before = Window.partitionBy("id").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    leads = own.groupBy("id", "lead").agg(F.count("*").alias("n")).select("id", "lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = own.withColumn("at", F.row_number().over(Window.partitionBy("id", "lead").orderBy("digest")))
    return ranked.join(leads, ["id", "lead"]).select("id", "digest", (F.col("ahead") + F.col("at") - 1).cast("long").alias("turn"))


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Pieces (bucket, id, start, anchor, crowded, bytes) cut from the documents' texts."""
    grouped = wanted.withColumn("base", _base(F.col("start"))).groupBy("id", "base").agg(F.collect_list(F.struct("bucket", "start", "stop", "anchor", "crowded")).alias("pieces"))
    met = docs.join(grouped, ["id", "base"]).select("id", "base", "text", F.explode("pieces").alias("p"))
    at = (F.col("p.start") - F.col("base") + 1).cast("int")
    size = (F.col("p.stop") - F.col("p.start") + length).cast("int")
    return met.select(F.col("p.bucket").alias("bucket"), "id", F.col("p.start").alias("start"), F.col("p.anchor").alias("anchor"), F.col("p.crowded").alias("crowded"), F.substring("text", at, size).alias("bytes"))


def cut_out(text: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)"""
    left, at, spans, removed = [], 0, 0, 0
    end = None
    for a, b in sorted(cuts):
        if end is None or a > end:
            if end is not None:
                at = end
            left.append(text[at:a])
            spans += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    if end is None:
        return text, 0, 0
    left.append(text[end:])
    return b"".join(left), removed, spans


def _cut(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copy, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if copy and len(text) >= length:
                    out.append((b"", len(text), 1, len(text)))
                else:
                    kept, removed, spans = cut_out(text, [(c["start"], c["stop"]) for c in cuts or ()])
                    out.append((kept, removed, spans, len(text)))
            kept, removed, spans, size = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
