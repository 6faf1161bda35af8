import hashlib

import pytest
from pyspark.sql import functions as F

from folio.llm import exact_dedup
from tests.llm.cases import ROWS, frame


def brute(rows, keep):
    groups = {}
    for i, text in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(t, []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known, default=None)
        out += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def run(spark, rows, keep="largest", **more):
    got = exact_dedup.exact_duplicates(frame(spark, rows), keep=keep, **more)
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.digest) for r in got.collect()), key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("broadcast_hits", [0, 1000])
def test_edge_cases(spark, keep, broadcast_hits):
    got = [(*x[:4], bytes(x[4]).hex()) for x in run(spark, ROWS, keep, broadcast_hits=broadcast_hits)]
    assert sorted(got, key=str) == brute(ROWS, keep)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("broadcast_hits", [0, 1000])
def test_equal_digests_of_different_texts_are_told_apart(spark, broadcast_hits):
    weak = lambda text: F.substring(exact_dedup.sha256(text), 1, 0)
    rows = ROWS + [(20 + i, f"text {i % 3}") for i in range(9)]
    got = [x[:4] for x in run(spark, rows, digest=weak, broadcast_hits=broadcast_hits)]
    assert sorted(got, key=str) == sorted((x[:4] for x in brute(rows, "largest")), key=str)


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [(*x[:4], bytes(x[4]).hex()) for x in run(spark, rows)]
    assert sorted(got, key=str) == brute(rows, "largest")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_batches_added_one_by_one(spark, keep):
    rows = [r for r in ROWS if r[0] is not None] + [(100 + i, f"Text {i % 5}") for i in range(20)] + [(200 + i, f"text {i}") for i in range(20)]
    index, seen = exact_dedup.Index(spark, keep, broadcast_hits=2), []
    for n in range(6):  # more batches than runs are held
        batch = rows[n::6]
        earlier = frame(spark, seen) if seen else None
        got = sorted(((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in index.add(frame(spark, batch), earlier=earlier).collect()), key=str)
        seen = seen + batch
        want, ids = brute(seen, keep), [x for x in brute(batch, keep)]
        assert {x[4]: x[1:3] for x in got} == {x[4]: x[1:3] for x in want if x[4] in {y[4] for y in ids}} and len(got) == len(batch)
        assert len(index.runs) <= exact_dedup.FAN_OUT
    assert {bytes(r.digest).hex(): (r.keep_id, r.group_size) for r in index.entries().collect()} == {x[4]: x[1:3] for x in brute(rows, keep)}
    with pytest.raises(ValueError):
        index.add(frame(spark, rows))


def test_filters_pass_all_that_are_in_and_few_others(spark):
    keys = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    asked = exact_dedup.Filter.of(keys, 5000)
    others = spark.range(5000, 25_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    assert asked.passing(keys).count() == 5000 and asked.passing(others).count() < 20_000 / 8
    assert exact_dedup.Filter.of(keys.limit(0), 0).passing(keys).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("broadcast_hits", [0, 1000])
def test_survivors_are_judged_by_row(spark, keep, broadcast_hits):
    rows = [(5, "alpha copy"), (5, "only here"), (9, "Alpha copy"), (None, "beta copy"), (None, "null id alone"), (7, "beta copy"), (7, "beta copy"), (3, None), (4, ""), (-4, "")]
    docs = frame(spark, rows)
    got = exact_dedup.survivors(docs, keep=keep, broadcast_hits=broadcast_hits)
    assert got.columns == docs.columns
    first = [(9, "Alpha copy"), (4, "")] if keep == "largest" else [(5, "alpha copy"), (-4, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([*first, (5, "only here"), (None, "null id alone"), (7, "beta copy")], key=str)
    assert exact_dedup.survivors(docs.limit(0), keep=keep).count() == 0
