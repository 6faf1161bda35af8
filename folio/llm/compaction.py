"""Bin-packed compaction of a table's Parquet files, planned and executed in place.

write_files() writes a table below a folder, one file for each (day, lot, piece); compact() joins the
small ones of each day into larger files there.

Planning. The files of a day, largest first, go to the earliest-opened group that still has room for
them. Groups are nodes of a treap whose keys are the order of opening; each node stores the largest room
of its subtree, so the earliest group with enough room is found by one descent that prefers the left,
and taking room updates that path only. A day is one group of rows, a row for each file: lots hold
about a 200th of the table at least, so a day has at most some 800 files, whatever the table's size.

Execution. A task a group streams the batches of the sources' row groups into one writer below a hidden
folder (by attempt, then renamed); when all are written and the list of them is saved, a second step
moves them in and deletes their sources. Both steps may run again for the same group. Files that join no
other are not touched. The driver plans nothing file by file: listings, plans and reports are tables.

Files are opened by the tasks through Arrow's file systems (local and shared folders, HDFS, S3, GCS).

Edge cases: rows with a null time are a day of their own, without number; a null id counts as an empty
text; rows that agree in time and id are ordered by the other columns (maps aside). Null and non-finite
values count as 0 cents. An empty table gives an empty folder and no rows. Added columns take names that the table
doesn't have, and never get into a file.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.storage import discard, save, saved

#: Shares of the table's rows: of a day's lots, under which a file is small, that a group holds at most.
LOT, SMALL, FULL = 200, 750, 300
PIECES = 4
#: Days up to which their numbers of rows are broadcast (16 bytes each); beyond it they are joined by shuffle, each day SALTS times.
BROADCAST_DAYS = 100_000
SALTS = 64
#: Rows that a writing task gets on average, at least; files are as large as their lots are.
TASK_ROWS = 2_000_000
BATCH_ROWS = 65_536
_NO_DAY = -(1 << 40)
_PLACE = re.compile(r"=(-?\d+)/[^/=]+=(\d+)/[^/=]+=(\d+)/[^/]+$")


def share(rows: int, part: int) -> int:
    return 1 + rows // part


class OpenGroups:
    """Room of groups in the order of their opening, as a treap with the largest room of each subtree."""

    def __init__(self) -> None:
        self.left: list[int] = []
        self.right: list[int] = []
        self.room: list[int] = []
        self.most: list[int] = []
        self.spine: list[int] = []  # from the root to the right

    @staticmethod
    def _priority(node: int) -> int:
        x = (node + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return x ^ x >> 32

    def _update(self, node: int) -> None:
        self.most[node] = max(self.room[node], *(self.most[x] for x in (self.left[node], self.right[node]) if x >= 0), -1)

    def open(self, room: int) -> int:
        """A new last group."""
        node, below = len(self.room), -1
        while self.spine and self._priority(self.spine[-1]) < self._priority(node):
            below = self.spine.pop()
        for column, value in ((self.left, below), (self.right, -1), (self.room, room), (self.most, room)):
            column.append(value)
        self._update(node)
        if self.spine:
            self.right[self.spine[-1]] = node
        for above in reversed(self.spine):
            self._update(above)
        self.spine.append(node)
        return node

    def join(self, size: int) -> int | None:
        """The earliest group with room for size, which it takes; None if there is none."""
        path: list[int] = []
        node = self.spine[0] if self.spine else -1
        if node < 0 or self.most[node] < size:
            return None
        while True:
            path.append(node)
            if self.left[node] >= 0 and self.most[self.left[node]] >= size:
                node = self.left[node]
            elif self.room[node] >= size:
                break
            else:
                node = self.right[node]
        self.room[node] -= size
        for above in reversed(path):
            self._update(above)
        return node


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of sizes by group, each joining the earliest one that holds it within the capacity, in the order given."""
    groups, out = OpenGroups(), []
    for at, size in enumerate(sizes):
        found = groups.join(size)
        if found is None:
            groups.open(capacity - size)
            out.append([at])
        else:
            out[found].append(at)
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, so that Spark and Arrow mean the same place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:///", where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString())


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if ":" not in uri.split("/")[0]:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _there(uri: str) -> bool:
    fs, path = opened(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def _moved(source: str, target: str) -> None:
    """Move a file; nothing is done if an earlier attempt has moved it."""
    if _there(source):
        fs, path = opened(source)
        fs.move(path, opened(target)[1])
    elif not _there(target):
        raise FileNotFoundError(source)


def _deleted(uri: str) -> None:
    fs, path = opened(uri)
    with contextlib.suppress(FileNotFoundError):
        if _there(uri):
            fs.delete_file(path)


def _free(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _ordered(df: DataFrame, first: list[str]) -> list[str]:
    def sortable(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return sortable(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(sortable(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [*first, *(f.name for f in df.schema.fields if f.name not in first and sortable(f.dataType))]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _day(df: DataFrame, time_col: str) -> F.Column:
    time = F.col(_quoted(time_col))
    if isinstance(df.schema[time_col].dataType, T.TimestampType):
        return F.floor(F.unix_micros(time) / F.lit(86_400_000_000)).cast("long")
    return F.unix_date(time.cast("date")).cast("long")


FILE = "day long, lot long, piece long, n_rows long, path string"


def write_files(df: DataFrame, folder: str, time_col: str, id_col: str) -> tuple[DataFrame, int]:
    """Write df below a new folder, a file for each (day, lot, piece), rows by time, then id; return a table of the files, and the number of rows."""
    spark, rows = df.sparkSession, df.count()
    folder = qualified(spark, folder)
    day, lot, piece, crc, n, salt = _free(df, "day", "lot", "piece", "crc", "day_rows", "salt")
    dealt = df.withColumns({day: F.coalesce(_day(df, time_col), F.lit(_NO_DAY)), crc: F.crc32(F.coalesce(F.col(_quoted(id_col)).cast("string"), F.lit("")).cast("binary"))})
    days = saved(dealt.groupBy(day).agg(F.count("*").alias(n)), "compact-days")
    if days.count() <= BROADCAST_DAYS:
        sized = dealt.join(F.broadcast(days), day)
    else:
        sized = dealt.withColumn(salt, F.col(crc) % SALTS).join(days.withColumn(salt, F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, SALTS - 1))))), [day, salt])
    h = F.col(crc)
    lots = 1 + F.floor(F.col(n) / F.lit(share(rows, LOT)))
    put = sized.withColumns({lot: F.floor(h / (PIECES * PIECES)) % lots, piece: F.least(h % PIECES, F.floor(h / PIECES) % PIECES)})
    keys = [day, lot, piece]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    put = put.select(*(_quoted(c) for c in df.columns), *keys).repartition(tasks, *keys)
    incoming = f"{folder}/_incoming"
    put.sortWithinPartitions(*keys, *map(_quoted, _ordered(df, [time_col, id_col]))).write.partitionBy(*keys).option("maxRecordsPerFile", 0).parquet(incoming)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                where = [int(x) for x in _PLACE.search(path).groups()]
                target = f"{folder}/{'none' if where[0] == _NO_DAY else where[0]}-{where[1]}-{where[2]}.parquet"
                _moved(path, target)
                fs, local = opened(target)
                made.append([*where, pq.read_metadata(local, filesystem=fs).num_rows, target])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["day", "lot", "piece", "n_rows", "path"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(incoming).select("path")
    files = saved(listed.mapInArrow(settle, FILE), "compact-files")
    files.count()
    discard(spark, incoming)
    return files, rows


PLAN = "day long, lot long, piece long, n_rows long, sources array<string>, paths array<string>"


def plan(files: DataFrame, rows: int) -> DataFrame:
    """The final files: what each consists of, in joining order."""
    small, full = share(rows, SMALL), share(rows, FULL)

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n_rows", "lot", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = own["n_rows"].tolist()
        large = [i for i, n in enumerate(sizes) if n >= small]
        rest = [i for i, n in enumerate(sizes) if n < small]
        groups = [[i] for i in large] + [[rest[i] for i in g] for g in first_fit([sizes[i] for i in rest], full)]
        name = own["lot"].astype(str) + "-" + own["piece"].astype(str)
        made = [(*own.loc[g[0], ["day", "lot", "piece"]], sum(sizes[i] for i in g), name[g].tolist(), own["path"][g].tolist()) for g in groups]
        return pd.DataFrame(made, columns=["day", "lot", "piece", "n_rows", "sources", "paths"])

    return files.groupBy("day").applyInPandas(packed, PLAN)


def _merge(paths: list[str], target: str, attempt: str) -> None:
    """One file of the rows of all paths in order: batches of their row groups go to one writer."""
    fs, local = opened(target)
    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
    own, writer = f"{local}.{attempt}", None
    try:
        for path in paths:
            source_fs, source = opened(path)
            with source_fs.open_input_file(source) as data, pq.ParquetFile(data, coerce_int96_timestamp_unit="us") as held:
                if writer is None:
                    # INT96 holds instants; Arrow reads it without a zone
                    old = {held.schema.column(i).path for i in range(len(held.schema)) if held.schema.column(i).physical_type == "INT96"}
                    schema = pa.schema([f.with_type(pa.timestamp("us", "UTC")) if f.name in old else f for f in held.schema_arrow], held.schema_arrow.metadata)
                    writer = pq.ParquetWriter(own, schema, filesystem=fs, store_schema=False, compression="snappy")
                for group in range(held.num_row_groups):
                    for batch in held.iter_batches(BATCH_ROWS, row_groups=[group]):
                        writer.write_batch(batch.cast(schema) if old else batch)
    finally:
        if writer is not None:
            writer.close()
    fs.move(own, local)


FINAL = "day long, lot long, piece long, n_rows long, sources string, path string, rewritten boolean"


def compact(files: DataFrame, rows: int, folder: str) -> DataFrame:
    """Join small files as planned; return the final files, a written table. files: of write_files(), which are in folder."""
    spark = files.sparkSession
    folder = qualified(spark, folder)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    planned = saved(plan(files, rows), "compact-plan").repartition(tasks, "day", "lot", "piece")
    hidden = f"{folder}/_merged"

    def name(first: str) -> str:
        return first.rsplit("/", 1)[1].removesuffix(".parquet") + "-merged.parquet"

    def execute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for paths in batch.column(batch.schema.get_field_index("paths")).to_pylist():
                if len(paths) > 1:
                    _merge(paths, f"{hidden}/{name(paths[0])}", attempt)
            yield batch

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, final = batch.to_pylist(), []
            for row in rows:
                final.append(row["paths"][0] if len(row["paths"]) == 1 else f"{folder}/{name(row['paths'][0])}")
                if len(row["paths"]) > 1:
                    _moved(f"{hidden}/{name(row['paths'][0])}", final[-1])
                    for path in row["paths"]:
                        _deleted(path)
            joined = [",".join(row["sources"]) for row in rows]
            day = pa.array([None if row["day"] == _NO_DAY else row["day"] for row in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([day, *(batch.column(batch.schema.get_field_index(c)) for c in ("lot", "piece", "n_rows")), pa.array(joined, pa.string()), pa.array(final, pa.string()), pa.array([len(row["paths"]) > 1 for row in rows], pa.bool_())], ["day", "lot", "piece", "n_rows", "sources", "path", "rewritten"])

    written = saved(planned.mapInArrow(execute, PLAN), "compact-written")  # all are there before a source goes
    final, _ = save(written.mapInArrow(settle, FINAL), "compact-final")
    discard(spark, hidden)
    return final


DIGESTS = [("min_id", T.LongType()), ("max_id", T.LongType()), ("cents", T.LongType()), ("ids_sha256", T.StringType()), ("columns", T.StringType())]


def digests(final: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """final with smallest and largest id, cents, a digest of the ids in file order and the columns' names, read back from each file in batches."""

    def read(path: str) -> tuple[int | None, int | None, int, str, str]:
        fs, local = opened(path)
        least, most, cents, sha, first = None, None, 0, hashlib.sha256(), True
        with fs.open_input_file(local) as data, pq.ParquetFile(data) as held:
            for batch in held.iter_batches(BATCH_ROWS, columns=[id_col, value_col]):
                ids, values = batch.column(0), batch.column(1)
                low, high = (pc.min(ids).as_py(), pc.max(ids).as_py())
                least = low if least is None or (low is not None and low < least) else least
                most = high if most is None or (high is not None and high > most) else most
                found = np.asarray(values.cast(pa.float64()).fill_null(0.0), np.float64)
                cents += int(np.floor(100 * np.where(np.isfinite(found), found, 0.0) + 0.5).astype(np.int64).sum())
                text = ",".join(ids.cast(pa.string()).fill_null("").to_pylist())
                sha.update((text if first else "," + text).encode())
                first = False
            names = ",".join(held.schema_arrow.names)
        return least, most, cents, sha.hexdigest(), names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [read(path) for path in batch.column(batch.schema.get_field_index("path")).to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(zip(*made, strict=True)))], [*batch.schema.names, *(n for n, _ in DIGESTS)])

    tasks = int(final.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return final.repartition(tasks, "path").mapInArrow(run, T.StructType([*final.schema.fields, *(T.StructField(n, t) for n, t in DIGESTS)]))
