import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import vector_tree
from folio.llm.queries import op4_vector_tree


def brute(rows, queries, k):
    """Exact neighbours, in double precision."""
    sound = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    widths = [len(v) for v in sound.values()]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    sound = {i: v for i, v in sound.items() if len(v) == width}
    out = []
    for q in queries:
        if q in sound:
            near = sorted((-float(sound[q] @ v / (np.sqrt(sound[q] @ sound[q]) * np.sqrt(v @ v))), i) for i, v in sound.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return out


def frame(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("rep", "ids", "vec", "leaf", "salt", "at", "part", "score", "id"):
        made = made.withColumn(name, F.lit("clash"))
    return made


def search(spark, rows, every=1, k=5, **more):
    table = frame(spark, rows)
    index = vector_tree.build(table, k=k, **more)
    return sorted(tuple(r) for r in vector_tree.search(index, table.where(F.col("vec_id") % every == 0), k=k, block_rows=64).collect())


def test_edge_cases_exactly(spark):
    rng = np.random.default_rng(2)
    random = lambda: [float(x) for x in rng.integers(-3, 4, 4)]
    rows = [(i, random()) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 1.5]) for i in range(40)] + [(7, [1.0, 2.0, 3.0, 1.5])]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 2.0, 3.0]), (303, [float("nan"), 1.0, 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, [1.0, 2.0]), (306, []), (None, [1.0, 1.0, 1.0, 1.0])]
    rows = [r for r in rows if r[0] != 7 or r[1][0] == 1.0]
    got = search(spark, rows, recall=1.0, calibration_queries=1000)
    want = brute(rows, [r[0] for r in rows if r[0] is not None], 5)
    scores = lambda x: [(q, n, round(s, 9)) for q, n, _, s in sorted(x)]
    assert scores(got) == scores(want)
    hot = [x for x in got if 200 <= x[0] < 240]
    for q in range(200, 240):
        assert [i for a, _, i, _ in hot if a == q] == [i for i in (7, *range(200, 240)) if i != q][:5]


def test_few_and_none(spark):
    assert search(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])]) == [(1, 1, 2, pytest.approx(0.5**0.5)), (2, 1, 1, pytest.approx(0.5**0.5))]
    assert search(spark, [(1, [1.0, 0.0])]) == []
    assert search(spark, []) == []


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id): r.score for r in op4_vector_tree(spark, sf).collect()}
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert len(got) == len(want)
    assert sum((q, i) in got for q, _, i, _ in want) / len(want) >= 0.9
    assert all(abs(got[q, i] - s) < 1e-12 for q, _, i, s in want if (q, i) in got)


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(0)
    rows = vector_tree.unit(rng.normal(size=(500, 8)))
    tree = vector_tree.Tree.fit(rows, 4, 10)
    leaves = list(tree.leaves(rows[0]))
    assert len(leaves) == len(set(leaves)) == tree.leaf_count() > 20
    assert set(tree.assign(rows)) <= set(leaves)
    # another branch may come first where its centre is nearer than all below the nearest branch
    places = [list(tree.leaves(r)).index(leaf) for r, leaf in zip(rows, tree.assign(rows), strict=True)]
    assert np.mean(np.array(places) == 0) > 0.9 and max(places) < 10


def test_many_ties_of_different_vectors(spark):
    """Thirty vectors of one direction, at powers of two: all cosines tie, so the smallest ids win."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(100, 400)]
    rows += [(3 * n, [float(2**n) * x for x in (1.0, 2.0, 3.0, 4.0, 0.5, 0.25)]) for n in range(30)]
    got = search(spark, rows, recall=1.0, calibration_queries=1000)
    assert [i for q, _, i, _ in got if q == 0] == [3, 6, 9, 12, 15]
    assert [i for q, _, i, _ in got if q == 9] == [0, 3, 6, 12, 15]


def test_ties_beyond_any_block(spark):
    queries, rows = np.array([[1.0, 1.0]]), np.array([[2.0**-n, 2.0**-n] for n in range(200)])
    reps = np.random.default_rng(0).permutation(200)
    _, r, scores = vector_tree.best(queries, rows, reps, 7)
    assert sorted(reps[r]) == list(range(7)) and len(set(scores)) == 1
    assert len(vector_tree.best(queries, rows[:3], reps[:3], 7)[0]) == 3


def test_doubles_keep_their_digits(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-9]), (3, [1.0, 0.5]), (4, [0.3, 0.7]), (5, [1.0, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_tree.search(vector_tree.build(table, k=2), table, k=2).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in got}[4, 1] == 3
    assert all(abs(r.score - next(s for q, _, i, s in brute(rows, [r.query_id], 4) if i == r.vec_id)) < 1e-15 for r in got)
