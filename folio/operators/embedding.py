"""Embedding providers: what turns texts into vectors, on the document side and on the query side.

A provider names its model, which must change with its weights, and its width. An index holds vectors of
one model only, so the name and the width go into its description. Models that want an instruction
before queries put it there and never before documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text, vectors

#: The width's name for an index without vectors.
LEXICAL_ONLY = "lexical-only"
BATCH = 64


class EmbeddingProvider(Protocol):
    model_id: str
    width: int

    def embed(self, rows: DataFrame, text_col: str, out: str) -> DataFrame:
        """rows with a vector of each text."""

    def embed_query(self, spark: SparkSession, query: str) -> list[float] | None:
        """The query's vector; None: the model has none, and searches are lexical."""


class LexicalOnly:
    """No vectors: an index that it builds is searched by words alone."""

    model_id, width = LEXICAL_ONLY, 0

    def embed(self, rows: DataFrame, text_col: str, out: str) -> DataFrame:
        return rows.withColumn(out, F.array().cast("array<double>"))

    def embed_query(self, spark: SparkSession, query: str) -> list[float] | None:
        return None


class Hashed:
    """Hashed terms: deterministic, without weights, inside the JVM."""

    def __init__(self, width: int = 128):
        self.model_id, self.width = f"hashed-terms-{width}", width

    def embed(self, rows: DataFrame, text_col: str, out: str) -> DataFrame:
        return rows.withColumn(out, vectors.hashed_embedding(text.terms(F.col(text_col)), self.width))

    def embed_query(self, spark: SparkSession, query: str) -> list[float] | None:
        one = spark.createDataFrame([(query,)], "query string")
        return list(self.embed(one, "query", "v").first().v)


class Model:
    """A model of the caller's: `load` makes, once in each task, a function from texts to vectors.

    query_prefix is put before queries and never before documents."""

    def __init__(self, model_id: str, width: int, load: Callable[[], Callable[[list[str]], list[list[float]]]], query_prefix: str = ""):
        self.model_id, self.width, self.load, self.query_prefix = model_id, width, load, query_prefix

    def _checked(self, found: list[list[float]], n: int) -> list[list[float]]:
        if len(found) != n or any(len(v) != self.width for v in found):
            raise ValueError(f"{self.model_id} must give a vector of {self.width} numbers for each text")
        return found

    def embed(self, rows: DataFrame, text_col: str, out: str) -> DataFrame:
        own = rows.drop(out)
        names, at = own.columns, own.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = self.load()
            for batch in batches:
                for n in range(0, batch.num_rows, BATCH):
                    part = batch.slice(n, BATCH)
                    found = self._checked(model([x or "" for x in part.column(at).to_pylist()]), part.num_rows)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float64()))], [*names, out])

        return own.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in own.dtypes) + f", `{out}` array<double>")

    def embed_query(self, spark: SparkSession, query: str) -> list[float] | None:
        return self._checked(self.load()([self.query_prefix + query]), 1)[0]


def embed_new(units: DataFrame, provider: EmbeddingProvider, text_col: str = "passage", out: str = "embedding") -> DataFrame:
    """units with vectors: those that have one keep it, the others get the provider's."""
    if out not in units.columns:
        return provider.embed(units, text_col, out)
    missing = units.where(F.col(out).isNull()).drop(out)
    return units.where(F.col(out).isNotNull()).unionByName(provider.embed(missing, text_col, out))
