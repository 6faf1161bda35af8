"""Packing of documents into token sequences of a fixed capacity, by harmonic classes.

A document's tokens are those of a tokenizers file, then one end id. It is cut into full sequences and
a rest. A piece of length n belongs to the class k = capacity // n of reciprocal capacities: exactly k
pieces of a class make a sequence, whatever their lengths, so a class has one open sequence at a time
and nothing is searched. A rest whose class would leave more than ``slack`` tokens free is cut to the
next reciprocal, capacity // (k + 1), and what is left of it is classed anew.

Each task packs its own documents and fills its classes alone: there is no shuffle. Sequence ids hold
the partition's number, so a task that is run again gives the same rows. What is left in open sequences
when a task ends, less than one capacity a class, is put together in the order of documents and cut at
the capacity, the last sequences at powers of two, which need no padding.

Ids: white space (ASCII) ends every token of such a tokenizer and gives none itself, so texts are encoded
by the stretches between. A worker remembers their ids; a new one is put together from the runs in it that the
tokenizer's own pattern finds (letters, single digits, marks, contractions), whose ids are remembered, too.
Stretches beyond Latin letters and ASCII, and those with a special token, are one run and go to the tokenizer. Other
runs are merged by tiktoken over the same merges, which is several times faster: every token of the file is what
its own symbols merge to, so merging whatever two neighbours make a token, lowest rank first, gives what
merging the listed pairs gives. Whole texts are encoded, in slices that end at white space; a document's
ids (4 bytes each) are held at once.

Edge cases: null text counts as empty and is the end id alone. Repeated rows and null ids are documents
like others. An empty table gives no rows. Only the two named columns are read, so others can't clash.
Strings of special tokens inside a text become their ids, as tokenizers does by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import sliced

CAPACITY = 2048
SLACK = 32
END_ID = 1
#: Stretches, and runs, that a worker remembers the ids of at most (about), and bytes of a text that are encoded together.
REMEMBERED = 400_000
SLICE_BYTES = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_STRETCH = rb"[^\x20\x09-\x0D]"
#: Letters up to U+017F but U+0130, whose lower case is two characters; what else is beyond ASCII.
_LETTERS = rb"(?:[A-Za-z]+|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|\xC4[\x80-\xAF\xB1-\xBF]|\xC5[\x80-\xBF])+"
_FAR = rb"(?:[\xC2\xC6-\xFF]|\xC3[\x97\xB7]|\xC4\xB0)"
#: The pattern of the tokenizer's file, for these and ASCII. (Fixed values.)
_NEAR_RUNS = rb"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|%b|[0-9]|[^A-Za-z0-9\x20\x09-\x0D\x80-\xFF]+" % _LETTERS
#: Runs of stretches that end with line feeds, and these.
_RUNS = re.compile(rb"(?<!%b)%b*%b%b*|%b|\n" % (_STRETCH, _STRETCH, _FAR, _STRETCH, _NEAR_RUNS))
_IS_FAR = re.compile(_FAR)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself, if it is printed, else one of a row from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printed else next(others)) for b in range(256)]


class Merges:
    """The merges of a tokenizers file with word ends, as ranks of byte strings for tiktoken. The mark of a word's
    end is a line feed, which no run holds: a last byte and the mark are merged first of all."""

    def __init__(self, path: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab, self.pairs, end = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], model["end_of_word_suffix"]
        symbols = byte_symbols()
        byte_of = {c: bytes([b]) for b, c in enumerate(symbols)}

        def plain(token: str) -> bytes:
            return b"".join(byte_of[c] for c in token.removesuffix(end)) + (b"\n" if token.endswith(end) else b"")

        names = [*symbols, *(c + end for c in symbols), *(a + b for a, b in self.pairs)]
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + b"\n": 256 + b for b in range(256)}
        ranks |= {plain(name): rank for rank, name in enumerate(names[512:], 512)}
        self.coder = tiktoken.Encoding("merges", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array([self.vocab.get(name, 0) for name in names], np.uint32)
        self.ends = np.array([i >= 256 and name.endswith(end) for i, name in enumerate(names)])

    def encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of runs in lower case, one after the other; how many each has)"""
        found = np.array(self.coder.encode_ordinary("".join(run + "\n" for run in runs)), np.int64)
        return self.ids[found], np.diff(np.flatnonzero(self.ends[found]), prepend=-1)


class _Ids:
    """Ids by name: one array, with the place and number of each name's."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, names: list[bytes]) -> np.ndarray:
        """-1 for those that aren't known."""
        return np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))

    def add(self, names: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def taken(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the names at places, one after the other; how many each has)"""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class Coder:
    """Ids of texts by a tokenizers file that lower-cases and cuts as _RUNS does."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.remembered = Tokenizer.from_file(path), Merges(path), remembered
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stretches, self.runs = _Ids(), _Ids()

    def _learn_runs(self, runs: list[bytes]) -> None:
        plain = [r for r in runs if r != b"\n" and not _IS_FAR.search(r) and not any(s in r for s in self.special)]
        self.runs.add(plain, *self.merges.encode([r.decode().lower() for r in plain]))
        others = sorted(set(runs).difference(plain))
        made = [x.ids for x in self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in others], add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        self.runs.add(others, np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes)

    def _learn(self, stretches: list[bytes]) -> None:
        """New stretches, each once."""
        if len(self.runs.known) > self.remembered:
            self.runs = _Ids()
        joined = b"\n".join(stretches)
        if any(s in joined for s in self.special):
            runs = [r for x in stretches for r in (*([x] if any(s in x for s in self.special) else _RUNS.findall(x)), b"\n")]
        else:
            runs = [*_RUNS.findall(joined), b"\n"]
        places = self.runs.places(runs)
        if (places < 0).any():
            self._learn_runs(list(dict.fromkeys(runs[i] for i in np.flatnonzero(places < 0).tolist())))
            places = self.runs.places(runs)
        ids, sizes = self.runs.taken(places)  # a line feed has none
        ends = np.cumsum(sizes)[places == self.runs.known[b"\n"]]
        self.stretches.add(stretches, ids, np.diff(ends, prepend=0))

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The parts' ids, one after the other, and how many each has."""
        if len(self.stretches.known) > self.remembered:
            self.stretches = _Ids()
        cut = pc.ascii_split_whitespace(pa.array(parts, pa.binary()).view(pa.string()))
        found = cut.flatten().dictionary_encode()
        names = found.dictionary.view(pa.binary()).to_pylist()
        at = self.stretches.places(names)
        new = [names[i] for i in np.flatnonzero(at < 0).tolist() if names[i]]
        if b"" not in self.stretches.known:  # at a text's ends
            self.stretches.add([b""], np.empty(0, np.uint32), np.zeros(1, np.int64))
        if new:
            self._learn(new)
        if (at < 0).any():
            at = self.stretches.places(names)
        ids, sizes = self.stretches.taken(at[found.indices.to_numpy(zero_copy_only=False)])
        ends = np.concatenate([[0], np.cumsum(sizes)])[cut.offsets.to_numpy()]
        return ids, np.diff(ends)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Short texts are encoded together, long ones slice by slice."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0

        def settle() -> None:
            ids, sizes = self._encoded([part for _, part in held])
            for (i, _), own in zip(held, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = np.concatenate([out[i], own]) if len(out[i]) else own
            held.clear()

        for i, text in enumerate(texts):
            for part in _parts(text):
                held.append((i, part))
                size += len(part)
                if size >= SLICE_BYTES:
                    settle()
                    size = 0
        if held:
            settle()
        return out


@lru_cache(2)
def coder_of(path: str) -> Coder:
    """A worker's coder, kept from task to task."""
    return Coder(path)


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE_BYTES)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def cuts(total: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of so many tokens."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        out.append(rest if capacity - k * rest <= slack else capacity // (k + 1))
        rest -= out[-1]
    return out


def tail_sizes(total: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the sequences that hold what is left in a task's open ones."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        out.append(rest if capacity - rest <= slack else 1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


class Packer:
    """Sequences of one task. A piece is (document's place in the task, start, ids); place() and finish()
    give the pieces of each sequence that is complete."""

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK) -> None:
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def place(self, document: int, ids: np.ndarray) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        start = 0
        for n in cuts(len(ids), self.capacity, self.slack):
            k = self.capacity // n
            own = self.open.setdefault(k, [])
            own.append((document, start, ids[start : start + n]))
            start += n
            if len(own) == k:
                yield self.open.pop(k)

    def finish(self) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        joined: list[tuple[int, int, np.ndarray]] = []
        for document, start, ids in sorted((p for own in self.open.values() for p in own), key=lambda p: p[:2]):
            if joined and joined[-1][0] == document and joined[-1][1] + len(joined[-1][2]) == start:
                joined[-1] = (document, joined[-1][1], np.concatenate([joined[-1][2], ids]))
            else:
                joined.append((document, start, ids))
        self.open = {}
        joined.reverse()
        for size in tail_sizes(sum(len(ids) for _, _, ids in joined), self.capacity, self.slack):
            own = []
            while size:
                document, start, ids = joined.pop()
                own.append((document, start, ids[:size]))
                if len(ids) > size:
                    joined.append((document, start + size, ids[size:]))
                size -= len(own[-1][2])
            yield own


ADDED = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids): a row for each piece; ids are unsigned numbers of 32 bits, lowest byte first.

    path: a tokenizers file that every executor has, of the kind that Coder takes."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    arrow = pa.schema([(name, pa.binary() if name == "ids" else pa.int64()) for name, _ in ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores have their own tasks
        coder, packer, sequence = coder_of(path), Packer(capacity, slack), TaskContext.get().partitionId() << 33
        held: dict[int, tuple[pa.Scalar, int]] = {}  # documents that have pieces in open sequences
        document = 0

        def rows(sequences: Iterator[list[tuple[int, int, np.ndarray]]]) -> Iterator[tuple]:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for doc, start, ids in pieces:
                    yield held[doc][0], start, len(ids), held[doc][1], sequence, offset, ids.astype("<u4").tobytes()
                    offset += len(ids)
                sequence += 1

        def batch(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            ids = pa.array([x.as_py() for x in columns[0]], kind)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns[1:], arrow, strict=True))], ["id", *arrow.names])

        kind = None
        for part in sliced(batches):
            kind, made = part.column(0).type, []
            for doc_id, ids in zip(part.column(0), coder.encode(part.column(1).to_pylist()), strict=True):
                whole = np.append(ids, np.uint32(end_id))
                held[document] = (doc_id, len(whole))
                made += rows(packer.place(document, whole))
                document += 1
            still = {d for pieces in packer.open.values() for d, _, _ in pieces}
            for doc in [d for d in held if d not in still]:
                del held[doc]
            if made:
                yield batch(made, kind)
        made = list(rows(packer.finish()))
        if made:
            yield batch(made, kind)

    return own.mapInArrow(run, T.StructType([T.StructField("id", own.schema["id"].dataType), *(T.StructField(n, t) for n, t in ADDED)]))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids, documents): the sequences themselves, padded to the capacity but at powers of two.

    documents: (offset, length, id) of each piece, for masks. A group is one sequence, so at most capacity pieces."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "length", "id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), pieces.alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda held, p: F.concat(held, p["ids"]))
    power = F.bit_count("length") == 1
    whole = F.when(power, joined).otherwise(F.rpad(joined, F.lit(4 * capacity), F.lit(pad_id.to_bytes(4, "little"))))
    return grouped.select("sequence_id", "length", whole.alias("ids"), F.transform("pieces", lambda p: F.struct(p["offset"], p["length"], p["id"])).alias("documents"))
