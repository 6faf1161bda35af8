"""Document scoring by cross-entropy difference of two matched bigram models.

Both models are counted over whole corpora: the background over all documents, the target over those
that are marked. They are matched: one vocabulary, one order, one smoothing. Words, contexts and word
pairs are told apart by 62 bits of hash (XXH64), each has a counter of its own, and the table of
counts grows with the corpus: nothing is out of it, dropped or cut by rank.

1. A task counts the n-grams of a chunk of texts and hands on the distinct keys in order of size with
   their counts, packed, by ranges of keys ("parts"). Parts are added up into a written table.
2. To score, documents are written in chunks. Each chunk asks for its distinct keys by part, where the
   table's part answers with the counts in the order asked. So a common n-gram is a row of a chunk and
   not of every document, and only one part or chunk at a time is held by a task.
3. A chunk with its answers gives the losses of its documents.

    p1(w)   = (c(w) + ALPHA) / (N + ALPHA * V)          V = distinct words + 1 (any other)
    p(w|h)  = (c(h, w) + MU * p1(w)) / (c(h) + MU)
    loss    = mean over the document's words of -ln p(w|h)
    score   = target's loss - background's loss            (lower: more like the target)

Words are what white space (ASCII) separates, A-Z lower-cased; a text's first word follows a mark.

Edge cases: null text counts as empty; a text without words has n_tokens 0 and no losses or score.
Without target documents the target model is uniform. Repeated rows count each time. All columns of
docs are kept; like-named result columns are replaced. Long texts are counted and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import sliced, small_batches
from folio.storage import release_shuffles, save

ALPHA = 0.1
MU = 200.0
SEED = 42
#: Words that a worker remembers the hash of at most.
REMEMBERED = 400_000
#: Bytes of text that are counted or scored together, and bytes of the corpus for each part; parts at least.
CHUNK_BYTES = 3 << 20
PART_BYTES = 12 << 20
PARTS = 512
#: Parts that a task adds up and answers for, one after the other.
TASK_PARTS = 4
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_KIND = np.uint64(3)


class _Hashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return out


class Keys:
    """Keys of words, contexts and pairs of a batch of texts; the lowest two bits tell the kind."""

    def __init__(self) -> None:
        self.known = _Hashes()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes of the texts in words; keys of all words, then of their contexts, then of the pairs)"""
        if len(self.known) > REMEMBERED:
            self.known = _Hashes()
        hashed, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.lower().split()
            sizes[i] = len(words)
            hashed.append(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
        word = np.concatenate([*hashed, np.empty(0, np.uint64)])
        before = np.empty_like(word)
        before[1:] = word[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts[sizes > 0]] = np.uint64(self.known[b""])
        pair = (before * _PAIR) ^ word
        pair = (pair ^ (pair >> np.uint64(31))) * _MIX
        pair ^= pair >> np.uint64(29)
        return sizes, np.concatenate([(x & ~_KIND) | np.uint64(kind) for kind, x in enumerate((word, before, pair))])


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, the bytes of each place together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order of size."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def packed_counts(background: np.ndarray, target: np.ndarray) -> bytes:
    return packed(np.concatenate([background, target]).astype("<i8"))


def unpacked_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    background, target = unpacked(data).view(np.int64).reshape(2, -1)
    return background, target


def split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(part, its place) of the parts that keys, in order of size, are in."""
    ends = np.searchsorted(((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24), np.arange(parts + 1, dtype=np.uint64)).tolist()
    return ((p, slice(ends[p], ends[p + 1])) for p in range(parts) if ends[p] < ends[p + 1])


def chunked(batches: Iterator[pa.RecordBatch], at: int, chunk_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in sliced(batches, 100):
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= chunk_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[list]]]:
    """Rows by their first column, in whose order they are; of long columns one row at a time is taken out."""
    rows = ([c[i].as_py() for c in batch.columns] for batch in batches for i in range(batch.num_rows))
    return groupby(rows, key=lambda row: row[0])


def _tallied(made: Keys, columns: list[tuple[pa.Array, pa.Array]], parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part, keys, counts) of the distinct n-grams of texts, marked or not."""
    found, chosen = [], []
    for texts, marks in columns:
        sizes, keys = made.of(_texts(texts))
        found.append(keys)
        chosen.append(keys[np.tile(np.repeat(np.array(marks.to_pylist(), bool), sizes), 3)])
    keys, background = np.unique(np.concatenate(found), return_counts=True)
    marked, times = np.unique(np.concatenate(chosen), return_counts=True)
    target = np.zeros_like(background)
    target[np.searchsorted(keys, marked)] = times
    return [(p, packed_keys(keys[at]), packed_counts(background[at], target[at])) for p, at in split(keys, parts)]


def _added(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys and their sums over rows of keys and counts, and each row's places among them."""
    keys, counts = [unpacked_keys(k) for k, _ in rows], [unpacked_counts(c) for _, c in rows]
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    first = np.flatnonzero(new)
    background, target = (np.add.reduceat(np.concatenate([c[i] for c in counts])[order], first) for i in (0, 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return every[first], background, target, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


@dataclass(frozen=True)
class Model:
    """Counts of both models by key: part, keys, counts (the background's, then the target's)."""

    table: DataFrame
    parts: int
    words: int
    background: int
    target: int


def by_part(rows: DataFrame, parts: int) -> DataFrame:
    """rows dealt by part; once there are more than the least number of parts, tasks follow them."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // TASK_PARTS if parts > PARTS else 1), "part")


def count(docs: DataFrame, text_col: str, target_col: str, parts: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(part, keys, counts, words, background, target): a row a part; the last three are its distinct words and the sums of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Keys()
        for held in chunked(batches, 0, chunk_bytes):
            out = _tallied(made, [(b.column(0), b.column(1)) for b in held], parts)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "keys", "counts", "words", "background", "target"]
        for part, rows in _grouped(batches):
            every, background, target, _ = _added([(k, c) for _, k, c in rows])
            words = (every & _KIND) == 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, (part, packed_keys(every), packed_counts(background, target), int(words.sum()), int(background[words].sum()), int(target[words].sum())), strict=True))], pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.int64()), ("background", pa.int64()), ("target", pa.int64())]))

    own = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("target"))
    counted = small_batches(own).mapInArrow(run, "part int, keys binary, counts binary")
    return by_part(counted, parts).sortWithinPartitions("part").mapInArrow(add, "part int, keys binary, counts binary, words long, background long, target long")


def _parts(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(PARTS, -(-size // PART_BYTES))


def fit(docs: DataFrame, text_col: str = "text", target_col: str = "target", chunk_bytes: int = CHUNK_BYTES) -> Model:
    """Both models, in a written table; the driver gets three sums only."""
    parts = _parts(docs, text_col)
    table, _ = save(count(docs, text_col, target_col, parts, chunk_bytes), "bigrams")
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "background", "target"))).first()
    release_shuffles(docs.sparkSession)
    return Model(table.select("part", "keys", "counts"), parts, *sums)


def _opened(data: bytes) -> list[pa.RecordBatch]:
    return pa.ipc.open_stream(data).read_all().to_batches()


ADDED = ["n_tokens", "target_loss", "background_loss", "score"]


def _chunks(own: DataFrame, at: int, chunk_bytes: int) -> DataFrame:
    """(chunk, data): the rows in Arrow's stream format, written; at: the texts' column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for held in chunked(batches, at, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for batch in held:
                    to.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])
            chunk += 1

    return save(small_batches(own).mapInArrow(pack, "chunk long, data binary"), "score-chunks")[0]


def _losses(chunks: DataFrame, answers: DataFrame, own: DataFrame, at: int, totals: tuple[int, int], vocabulary: int) -> DataFrame:
    """own with its losses; answers: chunk, part, data (counts in the order of the chunk's keys); totals: words of target and background."""
    names = own.columns

    def losses(sizes: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
        """Mean of -ln p of each text by one model; counts: of words, contexts, pairs."""
        word, before, pair = counts.reshape(3, -1)
        mean, some = np.full(len(sizes), np.nan), sizes > 0
        if some.any():
            loss = -np.log((pair + MU * (word + ALPHA) / (total + ALPHA * vocabulary)) / (before + MU))
            mean[some] = np.add.reduceat(loss, (np.cumsum(sizes) - sizes)[some]) / sizes[some]
        return mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Keys()
        for _, rows in _grouped(batches):
            held = _opened(next(rows)[2])
            counts = [unpacked_counts(row[2]) for row in rows]
            background, target = (np.concatenate([*(c[i] for c in counts), np.empty(0, np.int64)]) for i in (0, 1))
            found = [made.of(_texts(x.column(at))) for x in held]
            _, place = np.unique(np.concatenate([keys for _, keys in found]), return_inverse=True)
            ends = np.cumsum([len(keys) for _, keys in found])
            for batch, (sizes, keys), end in zip(held, found, ends.tolist(), strict=True):
                own_place = place[end - len(keys) : end]
                means = [losses(sizes, c[own_place], n) for c, n in zip((target, background), totals, strict=True)]
                out = [pa.array(x, from_pandas=True) for x in (*means, means[0] - means[1])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), *out], [*names, *ADDED])

    both = chunks.select("chunk", F.lit(-1).alias("part"), "data").union(answers)
    kinds = [T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    return both.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, T.StructType([*own.schema.fields, *map(T.StructField, ADDED, kinds)]))


def score(docs: DataFrame, model: Model, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns of docs with n_tokens, target_loss, background_loss and score."""
    own = docs.drop(*ADDED)
    at, parts = own.columns.index(text_col), model.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Keys()
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.column(0)[i].as_py()
                keys = np.unique(np.concatenate([made.of(_texts(x.column(at)))[1] for x in _opened(batch.column(1)[i].as_py())]))
                out = [(p, packed_keys(keys[place])) for p, place in split(keys, parts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([k for _, k in out], pa.binary()), pa.nulls(len(out), pa.binary())], ["part", "chunk", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            known, background, target = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
            for _, chunk, keys, counts in rows:
                if chunk is None:
                    known, (background, target) = unpacked_keys(keys), unpacked_counts(counts)
                    continue
                asked = unpacked_keys(keys)
                place = np.searchsorted(known, asked)
                hit = np.flatnonzero(place < len(known))
                hit = hit[known[place[hit]] == asked[hit]]
                found = np.zeros((2, len(asked)), np.int64)
                found[0, hit], found[1, hit] = background[place[hit]], target[place[hit]]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([packed_counts(*found)], pa.binary())], ["chunk", "part", "data"])

    chunks = _chunks(own, at, chunk_bytes)
    asked = chunks.mapInArrow(ask, "part int, chunk long, keys binary, counts binary")
    met = asked.union(model.table.select("part", F.lit(None).cast("long").alias("chunk"), "keys", "counts"))
    answers, _ = save(by_part(met, parts).sortWithinPartitions("part", F.col("chunk").asc_nulls_first()).mapInArrow(answer, "chunk long, part int, data binary"), "score-answers")
    release_shuffles(docs.sparkSession)
    return _losses(chunks, answers, own, at, (model.target, model.background), model.words + 1)


def fit_and_score(docs: DataFrame, text_col: str = "text", target_col: str = "target", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """score(docs, fit(docs)) with half of the shuffles: chunks ask and count at once, parts add up and answer."""
    own = docs.drop(*ADDED)
    at, mark, parts = own.columns.index(text_col), own.columns.index(target_col), _parts(docs, text_col)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Keys()
        for batch in batches:
            for i in range(batch.num_rows):
                out = _tallied(made, [(x.column(at), x.column(mark)) for x in _opened(batch.column(1)[i].as_py())], parts)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(out), pa.int64()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2))], ["part", "chunk", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _grouped(batches):
            rows = list(group)
            keys, background, target, places = _added([(k, c) for _, _, k, c in rows])
            words = (keys & _KIND) == 0
            sums = [int(words.sum()), int(background[words].sum()), int(target[words].sum())]
            for (_, chunk, _, _), place in zip(rows, places, strict=True):
                data = packed_counts(background[place], target[place])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary()), *(pa.array([x], pa.int64()) for x in sums)], ["chunk", "part", "data", "words", "background", "target"])
                sums = [0, 0, 0]  # once a part

    chunks = _chunks(own, at, chunk_bytes)
    asked = chunks.mapInArrow(ask, "part int, chunk long, keys binary, counts binary")
    answers, _ = save(by_part(asked, parts).sortWithinPartitions("part").mapInArrow(answer, "chunk long, part int, data binary, words long, background long, target long"), "score-answers")
    words, background, target = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "background", "target"))).first()
    release_shuffles(docs.sparkSession)
    return _losses(chunks, answers.select("chunk", "part", "data"), own, at, (target, background), words + 1)
