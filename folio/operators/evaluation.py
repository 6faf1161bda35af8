"""Labelled evaluation of rankings: recall at k, reciprocal rank, absent windows, floors, label hygiene."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.storage import saved

EPSILON = 1e-6
#: Words of a probe, and probes up to which they are broadcast; beyond it they are joined by shuffle.
PROBE_WORDS = 5
BROADCAST_PROBES = 200_000


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _runs(n: int) -> Column:
    """Hashes of all runs of n words in _words."""
    return F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("_words", i, F.lit(n)), " ")))


def _short(own: DataFrame, items: DataFrame, together: int) -> DataFrame:
    """(_item, _id) of texts that contain items without inner words, found by one automaton for `together` of them."""
    spark, out, items = own.sparkSession, None, items.distinct()
    total = items.count()
    blocks = max(1, 2 * -(-total // together) - 1)
    dealt = saved(items.withColumn("_block", F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks))), "evaluation-short")
    kind = own.schema["_id"]

    def finder(texts: dict[str, list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text, numbers in texts.items():
                if text:
                    automaton.add_word(text, numbers)
            if len(automaton):
                automaton.make_automaton()
            for batch in batches:
                for i in range(batch.num_rows):  # one text at a time
                    body = batch.column(1)[i].as_py()
                    if body is None:
                        continue
                    found = {id(n): n for _, n in automaton.iter(body)} if len(automaton) else {}
                    numbers = [n for held in found.values() for n in held] + texts.get("", [])
                    for at in range(0, len(numbers), 10_000):
                        part = pa.array(numbers[at : at + 10_000], pa.int32())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part), pa.int32())), part], ["_id", "_number"])

        return run

    for block in range(blocks if total else 0):
        rows = dealt.where(F.col("_block") == block).select("_item", "_text").collect()  # about `together` or half of it
        texts: dict[str, list[int]] = {}
        for n, r in enumerate(rows):
            texts.setdefault(r["_text"], []).append(n)
        if rows:
            numbered = spark.createDataFrame([(n, r["_item"]) for n, r in enumerate(rows)], T.StructType([T.StructField("_number", T.IntegerType()), items.schema["_item"]]))
            found = own.select("_id", "_body").mapInArrow(finder(texts), T.StructType([kind, T.StructField("_number", T.IntegerType())]))
            found = found.join(F.broadcast(numbered), "_number").select("_item", "_id")
            out = found if out is None else out.union(found)
    return out if out is not None else items.select("_item").limit(0).crossJoin(own.select("_id").limit(0))


def containing(docs: DataFrame, items: DataFrame, id_col: str = "uri", text_col: str = "body", item_col: str = "query", item_text: str = "text", together: int = BROADCAST_PROBES) -> DataFrame:
    """(item, id) of the documents whose text contains an item's whole text.

    An item's inner words stand as whole words in a text that contains it. A run of them, its probe, is
    looked up among the runs of each text, of all probes' lengths in one pass; only texts that hold it are
    searched. Items of less than three words have no inner words: an automaton finds them in the texts,
    a bounded number at a time. An empty item is in every text, a null one in none."""
    split = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text"), _words(F.col(item_text)).alias("_words"))
    inner = F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 2, F.lit(0)))
    run = F.slice(inner, (F.floor((F.size(inner) - F.least(F.size(inner), F.lit(PROBE_WORDS))) / 2) + 1).cast("int"), F.least(F.size(inner), F.lit(PROBE_WORDS)))
    probes = saved(split.select("_item", "_text", F.least(F.size(inner), F.lit(PROBE_WORDS)).alias("_n"), F.xxhash64(F.array_join(run, " ")).alias("_probe")), "evaluation-probes")
    some = probes.where("_n > 0")
    sizes = [r["_n"] for r in some.select("_n").distinct().collect()]  # at most PROBE_WORDS
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    found = _short(own, probes.where("_n = 0").select("_item", "_text"), together)
    if sizes:
        words = own.select("_id", _words(F.col("_body")).alias("_words"))
        runs = [F.when(F.size("_words") >= n, _runs(n)).otherwise(F.array().cast("array<bigint>")) for n in sorted(sizes)]
        wanted = some.select("_probe", "_item", "_text")
        each = words.select("_id", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("_probe"))
        hits = saved(each.join(F.broadcast(wanted) if some.count() <= BROADCAST_PROBES else wanted, "_probe").select("_id", "_item", "_text"), "evaluation-hits")
        met = own.join(F.broadcast(hits) if hits.count() <= BROADCAST_PROBES else hits, "_id")
        found = found.union(met.where(F.expr("contains(_body, _text)")).select("_item", "_id"))
    return found.select(F.col("_item").alias(item_col), F.col("_id").alias(id_col)).distinct()


def score_queries(expected: DataFrame, ranking: DataFrame, ks: list[int]) -> DataFrame:
    """(query, recall_<k> ..., rr). expected: query, uri; ranking: query, uri, rank (from 1), unique by uri."""
    met = expected.join(ranking, ["query", "uri"], "left")
    total = F.count("*")
    return met.groupBy("query").agg(
        *((F.count_if(F.col("rank") <= k) / total).alias(f"recall_{k}") for k in ks),
        F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("rr"),
    )


def summary(scores: DataFrame, ks: list[int]) -> DataFrame:
    """One row: the means over all queries."""
    return scores.agg(F.count("*").alias("queries"), *(F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks), F.avg("rr").alias("mrr"))


def absent_violations(absent: DataFrame, ranking: DataFrame, window: int) -> DataFrame:
    """(query, uri, rank) of labels that should not appear among the first `window`."""
    return absent.join(ranking, ["query", "uri"]).where(F.col("rank") <= window).select("query", "uri", "rank")


def checks(totals: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(metric, observed, floor, passed) of each floor; totals, one row, are made once for all of them."""
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("observed"), F.lit(f).alias("floor"), (F.col(m) + EPSILON >= f).alias("passed")) for m, f in floors.items()]
    return totals.select(F.explode(F.array(*each)).alias("c")).select("c.*")


def unknown_labels(labels: DataFrame, indexed: DataFrame) -> DataFrame:
    """Labels that the index doesn't hold; an evaluation with any is refused."""
    return labels.select("uri").distinct().join(indexed.select("uri"), "uri", "left_anti")


def parse_floors(specs: list[str]) -> dict[str, float]:
    """`recall_5=0.95` and the like; each floor between 0 and 1, each metric once."""
    out: dict[str, float] = {}
    for spec in specs:
        name, mark, value = spec.partition("=")
        if not mark or name in out or not 0 <= float(value) <= 1:
            raise ValueError(f"not a floor: {spec}")
        out[name] = float(value)
    return out


def read_dataset(data: dict) -> dict:
    """Checks an evaluation dataset's shape; unknown fields are refused."""
    unknown = set(data) - {"k", "absent_window", "min", "queries"}
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    ks = data.get("k") or []
    if not ks or any(not isinstance(k, int) or k < 1 for k in ks) or len(set(ks)) != len(ks):
        raise ValueError("k must be distinct positive numbers")
    if not data.get("queries"):
        raise ValueError("no queries")
    seen = set()
    for q in data["queries"]:
        if set(q) - {"query", "expected", "absent"}:
            raise ValueError(f"unknown fields in a query: {sorted(q)}")
        if not str(q.get("query", "")).strip() or not q.get("expected") or q["query"] in seen:
            raise ValueError(f"a query needs a text of its own and expected labels: {q}")
        if set(q["expected"]) & set(q.get("absent") or []):
            raise ValueError(f"a label is both expected and absent: {q}")
        seen.add(q["query"])
    return data


def load_dataset(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(settings, expected, absent) of a JSON dataset in any store: query and uri rows; its shape is checked first."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"{path} is empty")
    data = read_dataset(json.loads(text.value))
    rows = lambda field: spark.createDataFrame([(q["query"], uri) for q in data["queries"] for uri in q.get(field) or []], "query string, uri string")
    return {n: data.get(n) for n in ("k", "absent_window", "min")}, rows("expected"), rows("absent")
