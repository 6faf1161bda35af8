"""Byte-level BPE by a sentencepiece model that is serialised from the vocabulary.

No tokenizer is trained: the vocabulary's ranks are written as a sentencepiece BPE model in
protobuf's wire format. Each token's bytes become characters of the 256 Braille patterns (one for
each byte, none of them a space), its score is its negative rank, and normalisation is the
identity, so sentencepiece merges the pair of lowest rank first, leftmost first, as the byte-level
BPE of the same ranks does. Pieces stand in rank order, so a piece's index is its rank.

Texts are cut into pre-tokens by the pattern, each encoded separately; decoding maps ids to pieces
and their characters back to bytes.

Edge cases: null text counts as empty and gives no ids, whose decoding is empty. Bytes that aren't
UTF-8 become replacement characters, as in any decoding to text. Strings that look like special
tokens are ordinary text. Rows repeat as given, and all other columns are kept; like-named result
columns are replaced. Texts of any length are encoded whole, and no row is looked at twice.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.batches import sliced, small_batches

#: Code points with the Unicode property White_Space. (Fixed values.)
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0                　"
BRAILLE = 0x2800
#: Characters of cut texts whose ids a worker remembers at most.
REMEMBERED = 1_500_000
GROUP_CHARS = 500_000
#: Ranges of letters in Latin-1, and common punctuation. (Fixed values.)
LATIN_LETTERS = "À-ÖØ-öø-ÿ"
PUNCTUATION = ".,;:!?-()[]\"'/*#&%$"
_TO_PIECE = {b: BRAILLE + b for b in range(256)}
_TO_PIECE_BY_LINE = {b: p for b, p in _TO_PIECE.items() if b != 10}
_TO_BYTE = {BRAILLE + b: b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_PIECE)


def as_bytes(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + np.float32(x).tobytes()


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto; its field numbers are those of sentencepiece_model.proto."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, ... without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_bytes(1, _bytes(1, as_piece(t).encode()) + _float(2, -rank) + _number(3, normal)) for rank, t in enumerate(order)]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + _float(2, -len(order)) + _number(3, unknown)))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(order))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Coder:
    """Encodes and decodes in one Python worker.

    by_stretch: for patterns whose pre-tokens have white space within only if they are all white space, and
    else begin with one space at most, and whose letters end where a character follows that is certainly
    none, as the usual byte-level patterns do. Such texts are cut at these places first, which is faster.
    Without it any pattern will do: its own matches are remembered."""

    def __init__(self, model: bytes, pattern: str, by_stretch: bool = False):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        # \s as White_Space, whatever the regular-expression library holds it to be
        inside, space = re.escape(WHITE_SPACE), f"[{re.escape(WHITE_SPACE)}]"
        explicit = pattern.replace("[^\\s", f"[^{inside}").replace("\\S", f"[^{inside}]").replace("\\s", space)
        self.cut = regex.compile(explicit).findall
        word = f" ?[A-Za-z{LATIN_LETTERS}]+(?=[{inside}{re.escape(PUNCTUATION)}]|\\Z)"
        self.by_stretch = by_stretch
        self.stretches = re.compile(f"{word}| ?[^{inside}]+|{space}+(?![^{inside}])|{space}+").findall if by_stretch else self.cut
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each text of Braille patterns, as 32-bit numbers."""
        lists = self.pieces.encode(pieces, out_type=int, num_threads=1)
        flat = np.fromiter(chain.from_iterable(lists), np.int32).tobytes()
        ends = (np.cumsum([len(x) for x in lists]) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, stretches: set[str]) -> None:
        self.held += sum(map(len, stretches))
        if not self.by_stretch:
            every = list(stretches)
            self.known.update(zip(every, self._ids([as_piece(t.encode()) for t in every]), strict=True))
            return
        whole = [s for s in stretches if s.lstrip(" ").isalpha() and s[:2] != "  "]  # one pre-token each
        if whole:
            pieces = "\n".join(whole).encode().decode("latin-1").translate(_TO_PIECE_BY_LINE).split("\n")
            self.known.update(zip(whole, self._ids(pieces), strict=True))
        if len(whole) < len(stretches):
            cut = {s: self.cut(s) for s in stretches.difference(whole)}
            ids = iter(self._ids([as_piece(t.encode()) for tokens in cut.values() for t in tokens]))
            for s, tokens in cut.items():
                self.known[s] = b"".join(next(ids) for _ in tokens)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. New stretches are learned together for about GROUP_CHARS of text."""
        at = 0
        while at < len(texts):
            found, size = [], 0
            while at < len(texts) and size < GROUP_CHARS:
                found.append(self.stretches(texts[at]))
                size += len(texts[at])
                at += 1
            if self.held > REMEMBERED:
                self.known, self.held = {}, 0
            if new := set(chain.from_iterable(found)).difference(self.known):
                self.learn(new)
            known = self.known.__getitem__
            for stretches in found:
                yield np.frombuffer(b"".join(map(known, stretches)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    @cached_property
    def _bytes(self) -> list[bytes]:
        return [as_bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id, from the model's pieces; the last, unknown, piece has none."""
        return self._bytes


@lru_cache(2)
def coder(model: bytes, pattern: str, by_stretch: bool) -> Coder:
    """One for all tasks of a Python worker, so that what it remembers serves the next task."""
    return Coder(model, pattern, by_stretch)


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    df = df.drop(name)
    return df, T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, model: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", by_stretch: bool = False) -> DataFrame:
    """The columns of docs with the ids of each whole text. by_stretch: see Coder."""
    docs, schema = _with(docs, ids_col, T.ArrayType(T.IntegerType()))
    names, at = docs.columns, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary: about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = coder(shared.value, pattern, by_stretch).encode_all
        for batch in sliced(batches):
            ids = list(encoded([(raw or b"").decode("utf-8", "replace") for raw in batch.column(at).cast(pa.binary()).to_pylist()]))
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, ids_col])

    return small_batches(docs).mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded", by_stretch: bool = False) -> DataFrame:
    """The columns of rows with the bytes that the ids stand for; null ids give null. by_stretch: as for the
    encoding, so that a worker has one coder for both."""
    rows, schema = _with(rows, bytes_col, T.BinaryType())
    names, at = rows.columns, rows.columns.index(ids_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = coder(shared.value, pattern, by_stretch).token_bytes().__getitem__
        for batch in sliced(batches):
            out = [b"".join(map(piece, x.values.to_pylist())) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, bytes_col])

    return small_batches(rows).mapInArrow(run, schema)
