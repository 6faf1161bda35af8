"""What was computed from files, kept until they change: written tables and indexes by a signature of their source."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.storage import discard, save

KEPT = 8


def signature(files: DataFrame) -> tuple[int, int]:
    """(number of files, digest of their names, sizes and last changes); files: path, length, modificationTime."""
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.lit(0)).alias("digest")).first()
    return row.n, int(row.digest)


class Table:
    """A written table that can be dropped."""

    def __init__(self, df: DataFrame, tag: str):
        self.df, self.path = save(df, tag)

    def drop(self) -> None:
        discard(self.df.sparkSession, self.path)


class Memo:
    """At most `kept` values by name, each with the signature of what it was made from. A value of another
    signature is dropped and made again; of too many the one used least recently goes."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.held = max(1, kept), OrderedDict()

    @staticmethod
    def _drop(value: Any) -> None:
        if hasattr(value, "drop"):
            value.drop()

    def get(self, name: Hashable, version: Hashable, make: Callable[[], Any]) -> Any:
        if name in self.held:
            known, value = self.held[name]
            if known == version:
                self.held.move_to_end(name)
                return value
            del self.held[name]
            self._drop(value)
        value = make()
        self.held[name] = version, value
        while len(self.held) > self.kept:
            self._drop(self.held.popitem(last=False)[1][1])
        return value
