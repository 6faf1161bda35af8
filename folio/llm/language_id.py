"""Language identification by compression with zstandard raw-content dictionaries.

For each language a dictionary of raw text is cut from a bounded sample of labelled documents
(``dictionary_bytes`` a language, from documents in the order of a hash of their id, each from a
place in its text that the hash chooses). A text is compressed once with each dictionary, in blocks,
and gets the language of the smallest total. The score is the relative lead over the runner-up.

A decision is rejected when its margin is narrow: below MARGIN_SHARE of the score that all but
MARGIN_TAIL of the rightly predicted documents of about that length reach, of all labelled documents.
In texts of no learned language the dictionaries come out almost alike. Texts too short to tell, and
lengths with few labelled documents, have no margin.

Blocks are cut between characters and all of a text is compressed: in a long frame the text's own
beginning would serve as dictionary, so the blocks keep the dictionary decisive to the end.

Edge cases: a null text, or one without any letter, is `und` with score 0 and rejected. Ties go to
the language first in alphabetical order, with score 0 (rejected where there is a margin). Without a learned language all is `und`.
Rows repeat as given. Null ids are used for prediction like others, but not for learning. Only the
named columns are read, so others can't clash; lang and id are inputs of learning only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.batches import sliced, small_batches
from folio.storage import discard, save, saved

DICTIONARY_BYTES = 96 * 1024
#: Rightly predicted documents that a length needs for a margin.
MARGIN_ROWS = 30
MARGIN_TAIL = 0.01
MARGIN_SHARE = 0.25
EXCERPT = 1024
BLOCK_CHARS = 2048
LEVEL = 9
UNDETERMINED = "und"
#: Columns of tables between prediction and verdict.
_LENGTH, _RIGHT = "__length_class", "__right"


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary of at most dictionary_bytes for each language, from excerpts of EXCERPT characters
    that lie anywhere in their texts.

    The ranking within a language is pruned by each task before the shuffle, so a language of any
    size sends a bounded number of excerpts."""
    wanted = max(1, dictionary_bytes // EXCERPT)
    lettered = F.col("text").rlike(r"\p{L}")
    own = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & lettered)
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.char_length("text") - EXCERPT + 1, F.lit(1)))
    keyed = own.select("lang", F.substring("text", (place + 1).cast("int"), F.lit(EXCERPT)).alias("excerpt"), F.xxhash64("id").alias("key"))
    order = Window.partitionBy("lang").orderBy("key", "excerpt")
    rows = keyed.withColumn("at", F.row_number().over(order)).where(F.col("at") <= 2 * wanted).drop("at").collect()
    out: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.key, r.excerpt)):
        held = out.get(row.lang, b"")
        if len(held) < dictionary_bytes:
            out[row.lang] = held + row.excerpt.encode()[: dictionary_bytes - len(held)] + b"\n"
    return out


def decoded(raw: bytes | None) -> str | None:
    """A string column may hold bytes that aren't UTF-8; those become replacement characters."""
    return None if raw is None else raw.decode("utf-8", "replace")


class Classifier:
    """Compressors of all languages; made once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.names = sorted(dictionaries)
        self.made = []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.made.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.made]

    def predict(self, text: str | None) -> tuple[str, float]:
        import regex

        if not self.names or text is None or not regex.search(r"\p{L}", text):
            return UNDETERMINED, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        if len(order) == 1:
            return self.names[0], 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.names[order[0]], (second - best) / second


def length_class(chars: int) -> int:
    """Texts of 2**(c-1) to 2**c - 1 characters are of class c."""
    return chars.bit_length()


def _predicted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str, level: int) -> DataFrame:
    """The columns of docs with lang_pred, score and the text's length class; like-named ones are replaced."""
    own = docs.drop("lang_pred", "score", _LENGTH)
    names = own.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: dictionary_bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value, level)
        for batch in sliced(batches):
            texts = [decoded(x) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            got = [model.predict(x) for x in texts]
            pred, score = pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())
            length = pa.array([length_class(len(t or "")) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pred, score, length], [*names, "lang_pred", "score", _LENGTH])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField(_LENGTH, T.IntegerType())]
    return small_batches(own).mapInArrow(run, T.StructType([*own.schema.fields, *added]))


def _judged(predicted: DataFrame, margins: dict[int, float] | None) -> DataFrame:
    """Predicted rows with rejected, without their length class."""
    least = F.lit(0.0)
    if margins:
        by_length = F.create_map(*(F.lit(x) for c in sorted(margins) for x in (c, float(margins[c]))))
        least = F.coalesce(F.try_element_at(by_length, F.col(_LENGTH)), least)
    return predicted.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least)).drop(_LENGTH)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = LEVEL, margins: dict[int, float] | None = None) -> DataFrame:
    """The columns of docs with lang_pred, score (0 to 1) and rejected; like-named ones are replaced.

    margins: the least score by the text's length class, as `calibrate` gives them; none: only `und` is rejected."""
    return _judged(_predicted(docs.drop("rejected"), dictionaries, text_col, level), margins)


def _margins(right: DataFrame) -> dict[int, float]:
    """Margins by the length class of rightly predicted documents: of a written table, it is read twice.

    The low score is exact: an approximate bound of twice its rank, wide enough for its error, leaves few scores to be counted."""
    sizes = right.groupBy(_LENGTH).agg(F.count("*").alias("n"), F.percentile_approx("score", 2 * MARGIN_TAIL, 1000).alias("bound")).where(F.col("n") >= MARGIN_ROWS)
    of = {r[_LENGTH]: (math.ceil(MARGIN_TAIL * r.n), r.bound) for r in sizes.collect()}  # a row for each length class
    if not of:
        return {}
    rank, bound = (F.try_element_at(F.create_map(*(F.lit(x) for c in sorted(of) for x in (c, of[c][i]))), F.col(_LENGTH)) for i in (0, 1))
    counted = right.where(F.col("score") <= bound).groupBy(_LENGTH, "score").count()
    upto = counted.withColumn("upto", F.sum("count").over(Window.partitionBy(_LENGTH).orderBy("score")))
    low = upto.where(F.col("upto") >= rank).groupBy(_LENGTH).agg(F.min("score").alias("low")).collect()
    return {r[_LENGTH]: MARGIN_SHARE * r.low for r in low if r.low > 0}


def calibrate(labelled: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: int = LEVEL) -> dict[int, float]:
    """The least score of each length class that has enough rightly predicted documents, of all labelled ones."""
    own = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = _predicted(own.where("id is not null and lang is not null").drop("id"), dictionaries, "text", level)
    table, path = save(found.where("lang_pred = lang").select(_LENGTH, "score"), "margins")
    margins = _margins(table)
    discard(labelled.sparkSession, path)
    return margins


def judge(docs: DataFrame, learned: Column, keep: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: int = LEVEL) -> DataFrame:
    """Columns of docs with lang_pred, score and rejected: learned from, and calibrated on, all rows where `learned`.

    What `learn`, `calibrate` and `identify` give one after another, but each text is compressed once: the
    predictions are written, and margins and verdicts come from these."""
    dictionaries = learn(docs.where(learned), id_col, text_col, lang_col)
    counts = learned & F.col(id_col).isNotNull() & (F.col(lang_col).cast("string") == F.col("lang_pred"))
    found = _predicted(docs, dictionaries, text_col, level).withColumn(_RIGHT, F.coalesce(counts, F.lit(False)))
    found = saved(found.select(*keep, "lang_pred", "score", _LENGTH, _RIGHT), "languages", compression="zstd")
    return _judged(found, _margins(found.where(_RIGHT).select(_LENGTH, "score"))).drop(_RIGHT)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo folds; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))
