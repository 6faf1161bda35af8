import hashlib
import math

import pytest
from pyspark.sql import functions as F

from folio.llm import mixing
from tests.llm.cases import ROWS, frame


def quantile(rate, u):
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u and k < 4000:
        k += 1
        term *= rate / k
        total += term
    return k


def u(i, seed=17):
    return int(hashlib.md5(f"{'' if i is None else i}:{seed}".encode()).hexdigest()[:13], 16) / 16**13


def test_counts_are_poisson_quantiles(spark):
    got = mixing.mix(frame(spark), weights={"a": 1.0, None: 5.0}, total=60.0).collect()
    n = {"a": sum(1 for i, _ in ROWS if i is not None and i < 5), None: sum(1 for i, _ in ROWS if i is None or i >= 5)}
    want = []
    for i, _ in ROWS:
        s = "a" if i is not None and i < 5 else None
        copies = quantile({"a": 10.0, None: 50.0}[s] / n[s], u(i))
        want += [(i, s, copies, c) for c in range(1, copies + 1)]
    assert sorted(((r.doc_id, r.source, r.n_copies, r.copy_no) for r in got), key=str) == sorted(want, key=str)
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert {r.id for r in got} == {"clash"}


def test_shares_follow_the_weights(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"), F.lit("x").alias("text"))
    weights = {"hot": 1.0, "s0": 1.0, "s1": 2.0, "s2": 0.0}
    got = {r.source: r["count"] for r in mixing.mix(docs, weights=weights).groupBy("source").count().collect()}
    assert set(got) == {"hot", "s0", "s1"}
    for name, n in got.items():
        assert abs(n - weights[name] / 4 * 40_000) < 700


def test_independent_of_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda d: [(r.doc_id, r.copy_no) for r in mixing.mix(d).collect()]
    assert rows(docs) == rows(docs.repartition(7))


def test_empty_and_wrong_weights(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(frame(spark), weights={"a": -1.0})
