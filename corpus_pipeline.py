"""Corpus preparation: language ID, exact and near-duplicate removal, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; docs has the
columns of `documents`, and all stages but the last return these columns. Other columns of docs are
left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import exact_dedup, language_id, mixing, near_copies
from folio.llm.queries import bpe_digests
from folio.storage import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin. Dictionaries and margins come from all labelled rows of
    docs outside the held-out fold, which op8's contract keeps from learning.

    Null, empty and letterless texts have no language and go. So do texts whose lead is narrow for their
    length; lengths with few labelled documents have no margin, so nothing of these is rejected, ties
    included. Repeated rows and rows of null id are judged like others; null lang is not learned from.
    Without labelled rows nothing has a language and all go."""
    found = language_id.judge(docs.select(*COLUMNS), ~language_id.held_out(F.col("doc_id")), keep=COLUMNS)
    return found.where("not rejected").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z lower-cased, the row with the largest doc_id stays; null counts as an empty text.

    Rows are judged by their texts: rows of one doc_id, or of a null one, with different texts all stay.
    Null doc_ids come last; of repeated rows one stays, the first in the order of all columns."""
    return exact_dedup.survivors(docs.select(*COLUMNS), keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays: texts whose SimHash fingerprints differ in at most
    two bits (found by pivot distance tables), and what these miss at a similarity of 0.8 (five words a shingle).

    Texts without words (null, empty, white space) are no copies of anything and stay. Null doc_ids come
    last in a group; of repeated rows with words one stays."""
    return near_copies.keep_one(docs.select(*COLUMNS), fingerprints=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to shares by the square root of their size, in a global shuffle.

    A null source is a source. The number of copies hangs on doc_id only, so repeated rows, and rows of
    null doc_id, share it; texts are not looked at."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's number of tokens, and digests of its ids and of their decoding.

    A null or empty text has no tokens. One row for each row of docs, repeated ones and null ids included."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: zstandard's sizes, XXH64 and BPE merges have no SQL form: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and reread as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
