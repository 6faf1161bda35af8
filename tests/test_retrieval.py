import pytest

from folio.operators import evaluation, retrieval
from folio.operators.retrieval import Filter


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "b1", "document", "alpha beta", ["x"], "en"), (2, "b1", "skill", "alpha alpha gamma", ["y"], None), (3, "b2", "document", "beta gamma delta", [], "de"), (4, "b2", "memory", "", None, "en")]
    return spark.createDataFrame(rows, "id long, book string, namespace string, text string, tags array<string>, language string")


def ids(df):
    return [r.id for r in df.collect()]


def legs(spark, *lists):
    return [spark.createDataFrame([(ord(c), s) for c, s in leg], "id long, score double") for leg in lists]


def test_fusion_counts_ranks_from_zero_and_keeps_first_seen_order(spark):
    fused = retrieval.fuse(legs(spark, [("A", 3.0), ("B", 2.0), ("C", 1.0)], [("B", 9.0), ("D", 8.0)]), 10).collect()
    assert [chr(r.id) for r in fused] == ["B", "A", "D", "C"]
    assert fused[0].score == pytest.approx(1 / 61 + 1 / 60)


def test_equal_32_bit_scores_share_a_rank(spark):
    fused = {chr(r.id): r.score for r in retrieval.fuse(legs(spark, [("A", 1.0), ("B", 1.0 + 1e-12), ("C", 0.5)], []), 10).collect()}
    assert fused["A"] == fused["B"] == pytest.approx(1 / 60) and fused["C"] == pytest.approx(1 / 62)


def test_truncation_comes_after_fusion_and_empty_legs_are_fine(spark):
    assert [chr(r.id) for r in retrieval.fuse(legs(spark, [("A", 3.0), ("B", 2.0)], [("B", 1.0)]), 1).collect()] == ["B"]
    assert retrieval.fuse(legs(spark, [], []), 5).count() == 0


def test_lexical_repeats_count_and_no_terms_no_rows(docs):
    one, two = (retrieval.lexical_leg(docs, q, 10).collect() for q in ("gamma", "gamma gamma"))
    assert [r.id for r in one] == [r.id for r in two] and two[0].score == pytest.approx(2 * one[0].score)
    assert ids(retrieval.lexical_leg(docs, "!? ", 10)) == [] and ids(retrieval.lexical_leg(docs, "nothing", 10)) == []
    assert len(retrieval.text.query_terms("a " * 50)) == 32


def test_filters(docs):
    leg = lambda f: set(ids(retrieval.lexical_leg(docs, "alpha beta gamma", 10, f)))
    assert leg(Filter(books=["b1"])) == {1, 2} and leg(Filter(namespaces=["document"], language="de")) == {3}
    assert leg(Filter(tags=["x", "y"])) == {1, 2} and leg(Filter(tags=[])) == leg(Filter(books=[])) == set()
    assert leg(Filter(language="en")) == {1}
    with pytest.raises(retrieval.UnknownBook):
        Filter(books=["b1", "no"]).check_books(docs)


def test_statistics_are_of_the_whole_corpus(docs):
    score = lambda f: {r.id: r.score for r in retrieval.lexical_leg(docs, "beta", 10, f).collect()}
    assert score(Filter(books=["b1"]))[1] == score(None)[1]


def test_vector_leg_and_width(spark):
    units = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, embedding array<float>")
    assert ids(retrieval.vector_leg(units, [1.0, 0.2], 2)) == [1, 3]
    with pytest.raises(retrieval.IndexStale):
        retrieval.vector_leg(units, [1.0], 2)


def test_search_of_none(docs):
    assert retrieval.search(docs, docs, "alpha", None, 0).count() == 0
    assert ids(retrieval.search(docs, docs, "alpha", None, 1)) == [2]


def test_evaluation(spark):
    expected = spark.createDataFrame([("q", 1), ("q", 2), ("r", 9)], "query string, uri long")
    ranking = spark.createDataFrame([("q", 5, 1), ("q", 2, 2), ("r", 5, 1)], "query string, uri long, rank int")
    got = {r["query"]: r for r in evaluation.score_queries(expected, ranking, [1, 2]).collect()}
    assert (got["q"].recall_1, got["q"].recall_2, got["q"].rr) == (0, 0.5, 0.5) and got["r"].rr == 0
    absent = spark.createDataFrame([("q", 5), ("q", 7)], "query string, uri long")
    assert [r.uri for r in evaluation.absent_violations(absent, ranking, 1).collect()] == [5]


@pytest.mark.parametrize("bad", [{"k": [], "queries": [1]}, {"k": [1]}, {"k": [1], "queries": [{"query": "a", "expected": []}]}, {"k": [1], "queries": [{"query": "a", "expected": ["x"], "absent": ["x"]}]}, {"k": [1], "extra": 1, "queries": []}, {"k": [0], "queries": [{"query": "a", "expected": ["x"]}]}])
def test_dataset_errors(bad):
    with pytest.raises(ValueError):
        evaluation.read_dataset(bad)


def test_floors():
    assert evaluation.parse_floors(["mrr=0.9"]) == {"mrr": 0.9}
    for bad in (["mrr"], ["mrr=2"], ["mrr=0.1", "mrr=0.2"]):
        with pytest.raises(ValueError):
            evaluation.parse_floors(bad)


def test_floors_are_checked_over_one_scan_of_the_totals(spark, tmp_path):
    spark.createDataFrame([(0.5, 0.2)], "mrr double, recall_1 double").write.parquet(str(tmp_path / "t"))
    checks = evaluation.checks(spark.read.parquet(str(tmp_path / "t")), {"mrr": 0.5, "recall_1": 0.3})
    assert sorted(map(tuple, checks.collect())) == [("mrr", 0.5, 0.5, True), ("recall_1", 0.2, 0.3, False)]
    assert checks._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
