import random
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import calls, intervals, review
from folio.operators.code import outline


def made(seed, n, span, nested=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(-span, span)
        out.append((f"f{rng.randrange(3)}", f"s{i % 7}", start, start + (rng.choice([0, 1, 3, 8, span // 3, span]) if not nested else rng.randrange(6))))
    return [*out, *out[:3], ("f0", "none", None, 5), ("f0", "none", 5, None), ("f1", "odd", 9, 3)]


@pytest.mark.parametrize(("seed", "span"), [(1, 10), (2, 100), (3, 5000)])
def test_holding_against_all_pairs(spark, seed, span):
    rng = random.Random(seed)
    held, numbers = made(seed, 60, span), [(f"f{rng.randrange(3)}", rng.randrange(-span, 2 * span)) for _ in range(150)] + [("f0", None)]
    got = intervals.holding(spark.createDataFrame(numbers, "path string, line long"), spark.createDataFrame(held, "path string, name string, a int, b int"), ["path"], "line", "a", "b")
    want = [(p, n, s, a, b) for p, n in numbers for q, s, a, b in held if p == q and None not in (n, a, b) and a <= n <= b]
    assert sorted(map(str, (tuple(r) for r in got.select("path", "line", "name", "a", "b").collect()))) == sorted(map(str, want))


@pytest.mark.parametrize(("seed", "bits"), [(1, 2), (2, 4), (3, 14)])
def test_spans_within_some_interval(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(intervals, "SWEEP_BITS", bits)
    held, spans = made(seed, 25, 60, True), [x for x in made(seed + 9, 90, 60, True) if None not in x[2:]]
    a = spark.createDataFrame(spans, "path string, title string, line_start int, line_end int").withColumn("more", F.create_map(F.lit(1), F.lit(2)))
    b = spark.createDataFrame(held, "path string, name string, start int, end int")
    got = review.grounded(a, b)
    want = [x for x in spans if any(q == x[0] and None not in (s, e) and s <= x[2] and x[3] <= e for q, _, s, e in held)]
    assert got.columns == a.columns and sorted(str(tuple(r)[:4]) for r in got.collect()) == sorted(map(str, want)) and want


@pytest.mark.parametrize("seed", range(4))
def test_innermost_against_all_pairs(spark, seed):
    rows = [x for x in made(seed, 40, 12, seed % 2 == 0) if None in x[2:] or x[2] <= x[3]]
    got = outline.containment(spark.createDataFrame(rows, "path string, name string, start_row int, end_row int")).collect()
    want = []
    for p, n, a, b in rows:
        outer = [(-s, e, m) for q, m, s, e in rows if None not in (a, b, s, e) and q == p and s <= a and b <= e and (s, e) != (a, b)]
        best = min(outer, default=None)
        want.append((p, n, a, b, best and best[2], best and -best[0]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_file_of_a_hundred_thousand_rows(spark):
    """All in one path: 100,000 symbols, nested in pairs, and as many calls and findings."""
    n = 100_000
    symbols = spark.range(n).select(F.lit("hot").alias("path"), F.col("id").cast("string").alias("name"), (F.col("id") * 2 + F.col("id") % 2 * 0).cast("int").alias("start_row"), (F.col("id") * 2 + F.when(F.col("id") % 2 == 0, 3).otherwise(1)).cast("int").alias("end_row"))
    made_ = spark.range(n).select(F.lit("hot").alias("path"), F.lit("f").alias("name"), (F.col("id") * 2 + 1).cast("int").alias("line"))
    began = time.time()
    edges = calls.calls_in_symbols(made_, symbols)
    assert edges.count() == n + n // 2
    found = outline.containment(symbols)
    assert found.where("parent IS NOT NULL").count() == n // 2
    spans = made_.select("path", F.col("line").alias("line_start"), (F.col("line") + 1).alias("line_end"))
    assert review.grounded(spans, symbols.select("path", F.col("start_row").alias("start"), F.col("end_row").alias("end"))).count() == n // 2
    assert time.time() - began < 120


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, name string, start_row int, end_row int")
    assert outline.containment(none).count() == 0
    assert calls.calls_in_symbols(spark.createDataFrame([("p", "f", 3)], "path string, name string, line int"), none).count() == 0
