"""The passage index: content hashes, staleness, incremental reconciliation, and its table.

A table is a folder of immutable segments and numbered commits. A build writes what is new or changed as
a new segment, with the concepts that it removes from earlier ones, and then a commit that lists the
segments; a commit's file is put in place at once and never replaced, and the highest number counts, so
readers see all of a build or nothing. Reading leaves out removed rows. Small segments are merged with
their neighbours, each row a logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators.postings import BROADCAST_DEAD, PACKED, Postings, Segment
from folio.operators.retrieval import Filter, IndexStale, depth, fuse, lexical_leg, vector_leg
from folio.storage import discard, release_shuffles, save, saved

SCHEMA_VERSION = 4
#: Neighbouring segments of like size that are merged into one.
FANOUT = 4
#: Rows of a segment's file on average.
FILE_ROWS = 500_000
KEY = ["book", "namespace", "concept_id"]


def unit_id() -> Column:
    """A unit's name: its concept and the passage's number in it."""
    return F.concat_ws("/", "book", "namespace", F.concat_ws("#", "concept_id", "ordinal"))


def concept_hashes(passages: DataFrame, key: list[str] | None = None, ordinal: str = "ordinal", passage: str = "passage") -> DataFrame:
    """(key, text_hash): SHA-256 over the passages in order, each after its length in 8 bytes, lowest first."""
    key = key or KEY
    parts = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("n"), F.col(passage).alias("t"))))
    grouped = passages.groupBy(*key).agg(parts.alias("parts"))
    return grouped.select(*key, content_hash(F.transform("parts", lambda p: p["t"])).alias("text_hash"))


def content_hash(texts: Column) -> Column:
    """SHA-256 over length-prefixed texts of an array."""
    hexed = F.transform(texts, lambda t: F.concat(F.hex(text.length_prefix(t)), F.hex(t)))
    return F.sha2(F.unhex(F.array_join(hexed, "")), 256)


def staleness(stored: DataFrame, current: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, state): added, changed, removed or unchanged; both sides: key, text_hash."""
    key = key or KEY
    s, c = stored.select(*key, F.col("text_hash").alias("old")), current.select(*key, F.col("text_hash").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return s.join(c, key, "full_outer").select(*key, state.alias("state"))


def reconcile(stored: DataFrame, current: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The units after reconciliation; both sides: passages with key and text_hash.

    Units of concepts that are still there with the same hash stay as they are (with what was
    computed for them); units of new and changed concepts come from `current`."""
    key = key or KEY
    same = [*key, "text_hash"]
    now, before = current.select(*same).distinct(), stored.select(*same).distinct()
    return stored.join(now, same, "left_semi").unionByName(current.join(before, same, "left_anti"), allowMissingColumns=True)


def run_to_merge(sizes: list[int], fanout: int = FANOUT) -> int | None:
    """Where the run of last segments starts that should become one; None if there are too few of like size."""
    start, total = len(sizes), 0
    for at in reversed(range(len(sizes))):
        if total and sizes[at] > fanout * total:
            break
        start, total = at, total + sizes[at]
    return start if len(sizes) - start >= fanout else None


class Conflict(RuntimeError):
    """Another build has committed meanwhile; running this one again is safe."""


class Store:
    """Segments of a units table with their postings, and the model's name and width."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        """Numbers of the commits there are, lowest first: two at most stay, and those of running builds."""
        fs, where = self._fs(), self._path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit() and n.endswith(".json"))

    def meta(self) -> dict | None:
        numbers = self._commits()
        if not numbers:
            return None
        found = json.loads(self.spark.read.text(f"{self.root}/commits/{numbers[-1]:012d}.json", wholetext=True).first().value)
        if found["schema_version"] > SCHEMA_VERSION:
            raise IndexStale("the index is of a newer version")
        return found

    def _segments(self) -> list[dict] | None:
        """Those of the last commit, oldest first; None if there is none or it is of an older version."""
        found = self.meta()
        return found["segments"] if found and found["schema_version"] == SCHEMA_VERSION else None

    def _units(self, segments: list[dict]) -> DataFrame:
        removing = [s for s in segments if s["removed"] and s["seq"] > segments[0]["seq"]]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self.spark.read.parquet(f"{self.root}/{s['name']}/units").withColumn("_segment", F.lit(s["seq"])) for s in segments))
        if removing:
            read = reduce(DataFrame.union, (self.spark.read.parquet(f"{self.root}/{s['name']}/removed").select(*KEY, F.lit(s["seq"]).alias("_until")) for s in removing))
            gone = read.groupBy(*KEY).agg(F.max("_until").alias("_until"))
            gone = F.broadcast(gone) if sum(s["removed"] for s in removing) <= BROADCAST_DEAD else gone
            rows = rows.alias("u").join(gone.alias("g"), [F.col(f"u.{c}") == F.col(f"g.{c}") for c in KEY] + [F.col("_segment") < F.col("_until")], "left_anti")
        return rows.drop("_segment")

    def units(self) -> DataFrame | None:
        """The rows of the last commit; None if there is none or it is of an older version."""
        segments = self._segments()
        return None if segments is None else self._units(segments)

    def _postings(self, segments: list[dict]) -> Postings:
        return Postings(self.spark, segments=[Segment(f"{self.root}/{s['name']}/lexical", s["seq"], s["removed"]) for s in segments])

    def lexical(self) -> Postings | None:
        """Postings of the last commit, over passages and concept ids; their ids are unit_id()."""
        segments = self._segments()
        return self._postings(segments) if segments and all(s["lexical"] for s in segments) else None

    def search(self, query: str, k: int, vector: list[float] | None = None, where: Filter | None = None) -> DataFrame:
        """(id, score): hybrid search in the last commit, whose units have the vectors in `embedding`."""
        found = self.meta()
        index = self.lexical()
        if found is None or index is None:
            raise IndexStale("there is no index: build it")
        legs = [lexical_leg(index, query, depth(k), where)]
        if vector is not None:
            self.check_width(len(vector))
            legs.insert(0, vector_leg(self.units().withColumn("unit", unit_id()), vector, depth(k), where, "unit", width=found["width"]))
        return fuse(legs, k)

    def remove(self, concepts: DataFrame, key: list[str] | None = None) -> dict:
        """Commit without these concepts (key columns); concepts that aren't there are no error."""
        found, units = self.meta(), self.units()
        if units is None:
            raise IndexStale("there is no index: build it")
        gone = units.join(concepts.select(*(key or KEY)).distinct(), key or KEY, "left_semi")
        return self._commit(found, found["segments"], units.limit(0), gone, found["model_id"], found["width"])

    def clear(self) -> None:
        """Commit an index without rows, of the same model."""
        found, units = self.meta(), self.units()
        if units is not None:
            self._commit(found, [], units.limit(0), None, found["model_id"], found["width"])

    def commit(self, units: DataFrame, model_id: str, width: int) -> dict:
        """Commit exactly these units, as one segment."""
        return self._commit(self.meta(), [], units, None, model_id, width)

    def _commit(self, before: dict | None, segments: list[dict], fresh: DataFrame, gone: DataFrame | None, model_id: str, width: int) -> dict:
        """Commit `segments` without the units `gone`, and with `fresh` in a segment of their own."""
        number = 1 + max([before["number"] if before else 0, *self._commits()])
        segments = [*segments, self._write(number, fresh, gone)]
        start = run_to_merge([s["rows"] + s["removed"] for s in segments])
        if start is not None:
            segments = [*segments[:start], self._merged(number, segments[start:], start == 0)]
        meta = {"schema_version": SCHEMA_VERSION, "number": number, "model_id": model_id, "width": width, "segments": segments}
        self._put(meta)
        self._tidy(number)
        return meta

    def _described(self, name: str, seq: int, removed: int, columns: list[str]) -> dict:
        rows = self.spark.read.parquet(f"{self.root}/{name}/units").count()
        return {"name": name, "seq": seq, "rows": rows, "removed": removed, "lexical": {"passage", "ordinal", *KEY} <= set(columns)}

    def _write(self, number: int, fresh: DataFrame, gone: DataFrame | None) -> dict:
        name = f"segment-{number:012d}-{uuid.uuid4().hex[:8]}"
        path, removed = f"{self.root}/{name}", 0
        fresh.write.options(**PACKED).parquet(f"{path}/units")
        written = self.spark.read.schema(fresh.schema).parquet(f"{path}/units")
        release_shuffles(self.spark)
        if gone is not None:
            gone, gone_at = save(gone, "index-gone", **PACKED)
            gone.select(*KEY).distinct().write.parquet(f"{path}/removed")
            removed = gone.count()
        if {"passage", "ordinal", *KEY} <= set(fresh.columns):
            lost = gone.withColumn("unit", unit_id()) if removed else None
            Postings.build(written.withColumn("unit", unit_id()), f"{path}/lexical", id_col="unit", text_cols=("passage", "concept_id"), gone=lost)
        if gone is not None:
            discard(self.spark, gone_at)
        return self._described(name, number, removed, fresh.columns)

    def _merged(self, number: int, run: list[dict], first: bool) -> dict:
        name = f"segment-{number:012d}-{uuid.uuid4().hex[:8]}"
        path, removed = f"{self.root}/{name}", 0
        units = self._units(run)
        units.repartition(max(1, -(-sum(s["rows"] for s in run) // FILE_ROWS))).write.parquet(f"{path}/units")
        if not first and any(s["removed"] for s in run):
            gone = reduce(DataFrame.union, (self.spark.read.parquet(f"{self.root}/{s['name']}/removed") for s in run if s["removed"])).distinct()
            gone.write.parquet(f"{path}/removed")
            removed = sum(s["removed"] for s in run)
        if all(s["lexical"] for s in run):
            Postings.merge(self._postings(run), f"{path}/lexical", first)
        return self._described(name, number, removed, units.columns)

    def _put(self, meta: dict) -> None:
        """The commit's file is written aside and renamed to a name that must be free."""
        jvm, fs = self.spark._jvm, self._fs()
        target, aside = self._path(f"{self.root}/commits/{meta['number']:012d}.json"), self._path(f"{self.root}/commits/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(f"commit {meta['number']} is there already") from e

    def _tidy(self, number: int) -> None:
        """Delete commits before the last but one, and segments that neither of these two names (readers of the last but one go on)."""
        fs = self._fs()
        kept = [n for n in self._commits() if n <= number][-2:]
        named = {s["name"] for n in kept for s in json.loads(self.spark.read.text(f"{self.root}/commits/{n:012d}.json", wholetext=True).first().value).get("segments", [])}
        for n in self._commits():
            if n < kept[0]:
                fs.delete(self._path(f"{self.root}/commits/{n:012d}.json"), False)
        for f in fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith("segment-") and int(name.split("-")[1]) <= number and name not in named:
                fs.delete(f.getPath(), True)

    def build(self, current: DataFrame, model_id: str, width: int, key: list[str] | None = None) -> dict:
        """Reconcile with `current` (passages with key and text_hash) and commit; returns a report.

        What is written is in proportion to what is new, changed or removed. Another model, or units of an
        unknown one, rebuild everything. Running it again changes nothing."""
        key = key or KEY
        meta, before = self.meta(), self.units()
        rebuilt = before is not None and (meta["model_id"], meta["width"]) != (model_id, width)
        if before is None or rebuilt:
            counts = {"added": current.select(*key, "text_hash").distinct().count()}
            self._commit(meta, [], current, None, model_id, width)
        else:
            states = saved(staleness(before.select(*key, "text_hash").distinct(), current.select(*key, "text_hash").distinct(), key).where("state <> 'unchanged'"), "index-states")
            counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
            counts["unchanged"] = before.select(*key).distinct().count() - counts.get("changed", 0) - counts.get("removed", 0)
            some = F.broadcast(states) if sum(counts.values()) - counts["unchanged"] <= BROADCAST_DEAD else states
            if set(counts) - {"unchanged"}:
                fresh = current.join(some.where("state <> 'removed'").select(*key), key, "left_semi")
                gone = before.join(some.where("state <> 'added'").select(*key), key, "left_semi")
                self._commit(meta, meta["segments"], fresh, gone, model_id, width)
        return {"rebuilt": rebuilt, "upserted": counts.get("added", 0) + counts.get("changed", 0), "removed": counts.get("removed", 0), "unchanged": counts.get("unchanged", 0), "model_id": model_id}

    def check_width(self, width: int) -> None:
        meta = self.meta()
        if meta and meta["width"] != width:
            raise IndexStale(f"the index has vectors of {meta['width']} components, the provider {width}: rebuild it")
