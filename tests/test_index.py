import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from folio.operators import index
from folio.operators.retrieval import IndexStale
from folio.streaming.sessions import reconcile_stream, sessions, windowed_counts

KEY = "book string, namespace string, concept_id string, ordinal int, passage string"


def units(spark, *rows):
    df = spark.createDataFrame([("b", "document", c, n, t) for c, n, t in rows], KEY)
    return df.join(index.concept_hashes(df), index.KEY)


def test_hash_is_over_length_prefixed_texts(spark):
    (row,) = index.concept_hashes(units(spark, ("c", 1, "zwei"), ("c", 0, "é"))).collect()
    data = b"".join(struct.pack("<Q", len(x)) + x for x in ("é".encode(), b"zwei"))
    assert row.text_hash == hashlib.sha256(data).hexdigest()


def test_staleness(spark):
    got = index.staleness(units(spark, ("a", 0, "1"), ("b", 0, "1"), ("c", 0, "1")), units(spark, ("a", 0, "1"), ("b", 0, "2"), ("d", 0, "1")))
    assert {r.concept_id: r.state for r in got.collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}


def test_store_is_incremental_idempotent_and_rebuilds_for_another_model(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "ix"))
    first = units(spark, ("a", 0, "one"), ("b", 0, "two"), ("b", 1, "more"))
    assert store.build(first, "m", 4) == {"rebuilt": False, "upserted": 2, "removed": 0, "unchanged": 0, "model_id": "m"}
    number = store.meta()["number"]
    assert store.build(first, "m", 4)["unchanged"] == 2 and store.meta()["number"] == number
    report = store.build(units(spark, ("b", 0, "two"), ("b", 1, "more"), ("c", 0, "x")), "m", 4)
    assert (report["upserted"], report["removed"], report["unchanged"]) == (1, 1, 1)
    assert {(r.concept_id, r.passage) for r in store.units().collect()} == {("b", "two"), ("b", "more"), ("c", "x")}
    assert store.build(first, "other", 4)["rebuilt"]
    store.check_width(4)
    with pytest.raises(IndexStale):
        store.check_width(5)


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_what_is_written_follows_what_changes(spark, tmp_path):
    """One of 10,000 concepts: under a hundredth of the bytes."""
    store, root = index.Store(spark, str(tmp_path / "ix")), tmp_path / "ix"
    made = spark.range(10_000).select(F.lit("b").alias("book"), F.lit("document").alias("namespace"), F.col("id").cast("string").alias("concept_id"), F.lit(0).alias("ordinal"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i) % 5000)), " ").alias("passage"))
    hashed = lambda df: df.withColumn("text_hash", F.sha2("passage", 256))
    store.build(hashed(made), "m", 0)
    whole = size_of(root)
    changed = made.withColumn("passage", F.when(F.col("concept_id") == "77", "entirely new words").otherwise(F.col("passage")))
    report = store.build(hashed(changed), "m", 0)
    assert (report["upserted"], report["removed"], report["unchanged"]) == (1, 0, 9999)
    assert size_of(root) - whole < whole / 100
    assert [r.id for r in store.search("entirely", 3).collect()] == ["b/document/77#0"]
    assert store.units().count() == 10_000 == store.lexical().docs.count()


def test_many_builds_equal_the_last_state(spark, tmp_path):
    """Segments are merged on the way; every commit equals a build of its state alone."""
    store, merged = index.Store(spark, str(tmp_path / "ix")), 0
    for step in range(5):
        state = [(f"c{i}", 0, f"word{i} common step{step if i == step % 4 else i}") for i in range(6) if (i + step) % 5]
        now = units(spark, *state)
        store.build(now, "m", 0)
        segments = store.meta()["segments"]
        merged += len(segments) == 1 and step > 0
        assert len(segments) < 8 and sorted(r.passage for r in store.units().collect()) == sorted(t for _, _, t in state)
        if step in (2, 4):
            alone = index.Store(spark, str(tmp_path / f"alone{step}"))
            alone.build(now, "m", 0)
            one, other = store.lexical(), alone.lexical()
            assert one.totals() == other.totals() and sorted(map(tuple, one.terms.collect())) == sorted(map(tuple, other.terms.collect()))
            assert store.search("common step2 word3", 4).collect() == alone.search("common step2 word3", 4).collect()
    assert merged and len(list((tmp_path / "ix" / "commits").glob("*.json"))) == 2
    named = {s["name"] for s in store.meta()["segments"]}
    assert named <= {p.name for p in (tmp_path / "ix").iterdir()}


def test_runs_to_merge():
    assert index.run_to_merge([10_000, 1, 1, 1]) is None and index.run_to_merge([10_000, 1, 1, 1, 1]) == 1
    assert index.run_to_merge([9, 3, 2, 1]) == 0 and index.run_to_merge([100, 4, 1, 1]) is None and index.run_to_merge([]) is None


def test_a_commit_is_never_replaced(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "ix"))
    store.build(units(spark, ("a", 0, "one")), "m", 0)
    held = store.meta()
    with pytest.raises(index.Conflict):
        store._put(held)
    (tmp_path / "ix" / "commits" / "_half").write_text("{")
    assert store.meta() == held


def test_stream_folds_batches_and_survives_a_restart(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "ix"))
    source = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame([("b", "document", c, n, t) for c, n, t in r], KEY)
    rows(("a", 0, "one"), ("b", 0, "two")).coalesce(1).write.parquet(source)
    run = lambda: reconcile_stream(spark.readStream.schema(KEY).parquet(source), store, "m", 4, str(tmp_path / "cp")).awaitTermination()
    run()
    rows(("b", 0, "changed")).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert {(r.concept_id, r.passage) for r in store.units().collect()} == {("a", "one"), ("b", "changed")}


def test_sessions_in_a_stream(spark, tmp_path):
    made = spark.createDataFrame([(1, "2024-01-01 00:00:00", "x", 1.0), (1, "2024-01-01 00:20:00", "x", 2.0), (1, "2024-01-01 02:00:00", "y", 4.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    made.write.parquet(str(tmp_path / "e"))
    stream = sessions(spark.readStream.schema(made.schema).parquet(str(tmp_path / "e")), delay="1 minute")
    q = stream.writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.events for r in spark.table("held").collect()] == [2]
    assert sorted(r.events for r in sessions(made).collect()) == [1, 2]
    assert sorted((r.event_type, r.n, r.total) for r in windowed_counts(made, "1 hour").collect()) == [("x", 2, 3.0), ("y", 1, 4.0)]
    assert windowed_counts(made, "1 hour", "30 minutes").count() == 4
