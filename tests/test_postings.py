import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import embedding, evaluation, index, postings, retrieval
from folio.operators.postings import Postings, Segment
from folio.operators.retrieval import Filter

ROWS = [(1, "b1", "document", "alpha beta", ["x"], "en"), (2, "b1", "skill", "alpha alpha gamma Élan", ["y"], None), (3, "b2", "document", "beta gamma delta", [], "de"), (4, "b2", "memory", "", None, "en"), (5, "b3", "memory", None, None, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, book string, namespace string, text string, tags array<string>, language string")


@pytest.fixture(scope="module")
def built(docs, tmp_path_factory):
    return Postings.build(docs, str(tmp_path_factory.mktemp("ix") / "a"))


def rows(leg):
    return [(r.id, round(r.score, 9)) for r in leg.collect()]


@pytest.mark.parametrize("query", ["alpha", "beta gamma", "gamma gamma elan", "nothing", "ÉLAN!", "?!"])
@pytest.mark.parametrize("where", [None, Filter(books=["b1"]), Filter(language="de"), Filter(tags=[])])
def test_index_and_scan_agree(docs, built, query, where):
    assert rows(retrieval.lexical_leg(built, query, 10, where)) == rows(retrieval.lexical_leg(docs.na.fill({"text": ""}), query, 10, where))


def test_many_queries_agree_with_one_by_one(spark, built):
    asked = ["alpha gamma", "delta", "nothing", "gamma gamma"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = retrieval.lexical_legs(built, queries, 10).collect()
    for n, q in enumerate(asked):
        want = rows(retrieval.lexical_leg(built, q, 10))
        assert [(r.id, round(r.score, 9)) for r in sorted((r for r in got if r.query_id == n), key=lambda r: r["rank"])] == want


def test_a_query_reads_its_terms_only(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TASK_POSTINGS", 2)
    ix = Postings.build(docs, str(tmp_path / "x"))
    assert ix._facts[0][2] > 1
    plan = ix.of(["alpha", "beta"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or "bucket#" in plan
    assert {r.term for r in ix.of(["alpha", "beta"]).collect()} == {"alpha", "beta"}


def key(df):
    return sorted(map(str, df.collect()))


def same_index(one, other):
    for name, columns in (("postings", ["id", "term", "f", "size"]), ("terms", ["term", "df"]), ("docs", ["id", "size", "text_hash", "book", "language"])):
        assert key(getattr(one, name).select(*columns)) == key(getattr(other, name).select(*columns))
    assert one.totals() == other.totals()


def test_segments_equal_one_built_at_once(spark, docs, built, tmp_path):
    """Document 1 gets another facet, 3 another text, 2 goes, 7 comes; then 3 changes again."""
    second = spark.createDataFrame([(1, "b9", "document", "alpha beta", ["x"], "en"), (3, "b2", "document", "beta epsilon", [], "de"), (7, "b2", "document", "alpha", [], "de")], docs.schema)
    third = spark.createDataFrame([(3, "b2", "document", "beta beta gamma", [], "de")], docs.schema)
    Postings.build(second, str(tmp_path / "b"), gone=docs.where("id < 4"))
    Postings.build(third, str(tmp_path / "c"), gone=second.where("id = 3"))
    parts = [Segment(built.segments[0].path, 0), Segment(str(tmp_path / "b"), 1, 3), Segment(str(tmp_path / "c"), 2, 1)]
    now = docs.where("id > 3").union(second.where("id <> 3")).union(third)
    fresh = Postings.build(now, str(tmp_path / "d"))
    several = Postings(spark, segments=parts)
    same_index(several, fresh)
    same_index(Postings.merge(several, str(tmp_path / "e"), True), fresh)
    late = Postings.merge(Postings(spark, segments=parts[1:]), str(tmp_path / "f"), False)
    same_index(Postings(spark, segments=[parts[0], Segment(late.segments[0].path, 2, 4)]), fresh)
    for query in ("alpha", "beta gamma", "epsilon", "gamma gamma elan"):
        for where in (None, Filter(books=["b9", "b2"])):
            assert rows(retrieval.indexed_leg(several, query, 5, where, 0)) == rows(retrieval.lexical_leg(fresh, query, 5, where))


def test_counts_within_rows(spark):
    rows_ = spark.createDataFrame([(1, "b a B c a a"), (2, ""), (3, None), (4, "x")], "id long, _text string")
    got = {r.id: (r.size, sorted(map(tuple, r.counts))) for r in postings.counted_terms(rows_).collect()}
    assert got == {1: (6, [("a", 3), ("b", 2), ("c", 1)]), 2: (0, []), 3: (0, []), 4: (1, [("x", 1)])}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of a third of the words of one, with frequent and rare terms, ties and copies."""
    rng = random.Random(3)
    made = [(i, f"b{i % 3}", "document", " ".join(rng.choice(["the"] * 6 + ["of"] * 4 + ["a"] * 3 + [f"w{rng.randrange(400)}"] * 4) for _ in range(rng.choice([5, 5, 40, 200]))), ["x"], "en") for i in range(1500)]
    made += [(2000 + i, "b1", "document", "the the rare", ["x"], "en") for i in range(60)]
    df = spark.createDataFrame(made, "id long, book string, namespace string, text string, tags array<string>, language string")
    return df, Postings.build(df, str(tmp_path_factory.mktemp("ix") / "c"))


@pytest.mark.parametrize("query", ["the", "the rare w3 w4 w5", "nothing"])
@pytest.mark.parametrize("where", [None, Filter(books=["b1"])])
def test_ranges_give_the_same_rows(corpus, query, where):
    df, ix = corpus
    for k in (1, 100):
        got = rows(retrieval.indexed_leg(ix, query, k, where, direct=0))
        assert got == rows(retrieval.indexed_leg(ix, query, k, where, direct=1 << 60))
    assert got == rows(retrieval.lexical_leg(df, query, k, where))


def test_ranges_read_far_less(corpus):
    _, ix = corpus
    every, read = retrieval.postings_read(ix, "the", 10)
    assert read * 4 < every


def test_layout_follows_the_size():
    assert postings.layout(0) == postings.layout(400_000) == (1, 1)
    assert all(b * p * postings.TASK_POSTINGS >= n and p >= postings.PARTS for n in (10**6, 10**8, 10**10) for b, p in [postings.layout(n)])


def test_fields_and_diacritics(spark, tmp_path):
    made = spark.createDataFrame([(1, "naïve Café", "document/Zürich-x"), (2, "plain", "skill/y")], "id long, text string, concept_id string")
    ix = Postings.build(made, str(tmp_path / "f"), text_cols=("text", "concept_id"))
    for query in ("naive", "CAFÉ", "zurich", "document", "Zürich"):
        assert [r.id for r in retrieval.lexical_leg(ix, query, 5).collect()] == [1]
    words = ["Ünï", "ñandú", "Ångström", "Łódź", "áb", "straße"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.terms(F.col("w")).alias("t")).collect()
    assert all(r.t == text.query_terms(r.w) for r in got)


def test_empty_index(docs, tmp_path):
    ix = Postings.build(docs.limit(0), str(tmp_path / "e"))
    assert ix.totals() == (0, 0.0) and rows(retrieval.lexical_leg(ix, "alpha", 5)) == []


def test_store_searches_its_postings(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "s"))
    key = "book string, namespace string, concept_id string, ordinal int, passage string"

    def units(*found):
        df = spark.createDataFrame([("b", "document", c, n, t) for c, n, t in found], key)
        return embedding.Hashed(16).embed(df.join(index.concept_hashes(df), index.KEY), "passage", "embedding")

    with pytest.raises(retrieval.IndexStale):
        store.search("x", 3)
    store.build(units(("a", 0, "red fox"), ("b", 0, "blue fox"), ("b", 1, "green tree")), "hashed-terms-16", 16)
    assert [r.id for r in store.search("tree", 3).collect()] == ["b/document/b#1"]
    asked = embedding.Hashed(16).embed_query(spark, "red fox")
    assert store.search("red fox", 1, asked).first().id == "b/document/a#0"
    store.build(units(("a", 0, "red hen"), ("b", 0, "blue fox"), ("b", 1, "green tree")), "hashed-terms-16", 16)
    assert [r.id for r in store.search("hen", 3).collect()] == ["b/document/a#0"]
    assert {r.id for r in store.search("fox", 3).collect()} == {"b/document/b#0"}
    store.remove(spark.createDataFrame([("b", "document", "b"), ("b", "document", "none")], "book string, namespace string, concept_id string"))
    assert [r.concept_id for r in store.units().collect()] == ["a"] and rows(store.search("fox", 3)) == []
    store.clear()
    assert store.units().count() == 0 and rows(store.search("hen", 3)) == []
    with pytest.raises(retrieval.IndexStale):
        store.search("hen", 3, [1.0])


def test_embedding_providers(spark):
    rows_ = spark.createDataFrame([(1, "one two"), (2, None)], "id long, passage string")
    seen = []

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    model = embedding.Model("lengths@1", 2, load, query_prefix="query: ")
    assert {r.id: r.v for r in model.embed(rows_, "passage", "v").collect()} == {1: [7.0, 1.0], 2: [0.0, 1.0]}
    assert model.embed_query(spark, "one") == [10.0, 1.0]
    with pytest.raises(ValueError):
        embedding.Model("wrong", 3, load).embed_query(spark, "one")
    assert embedding.LexicalOnly().embed_query(spark, "x") is None
    held = rows_.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(9.0), F.lit(9.0))))
    assert {r.id: r.embedding for r in embedding.embed_new(held, model).collect()} == {1: [9.0, 9.0], 2: [0.0, 1.0]}
    assert not seen


def test_containing_against_brute_force(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "a quick brown foxtrot", "xthe quick brown fox jumps over the lazy dogs", "quick", "", None, "the  quick brown\nfox jumps over the lazy dog", "ab cd ef gh ij kl mn op"]
    asked = ["the quick brown fox jumps over the lazy dog", "quick brown fox", "quick", "b cd e", "cd ef gh ij kl mn o", "brown fox jumps over", "the  quick", "zz yy xx ww vv uu tt", "", "quick", None, "x", "k b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "uri long, body string")
    items = spark.createDataFrame(list(enumerate(asked)), "query long, text string")
    want = {(n, m) for n, a in enumerate(asked) for m, t in enumerate(texts) if None not in (a, t) and a in t}
    for together in (200_000, 2):  # short items at once, and in blocks
        got = [(r["query"], r.uri) for r in evaluation.containing(docs, items, together=together).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert evaluation.containing(docs, items.limit(0)).count() == 0


def test_bounds_hold_every_term_and_are_made_without_a_shuffle(corpus):
    _, ix = corpus
    want = {(r["term"], r["range"]): (r["f"], r["size"]) for r in ix.postings.groupBy("term", "range").agg(F.max("f").alias("f"), F.min("size").alias("size")).collect()}
    terms = sorted({t for t, _ in want})
    got = ix.bounds(terms).groupBy("term", "range").agg(F.max("f").alias("f"), F.min("size").alias("size")).collect()
    assert {(r["term"], r["range"]): (r["f"], r["size"]) for r in got} == want
    assert "Exchange" not in postings.range_bounds(ix.postings.select("term", "range", "f", "size", "bucket"))._jdf.queryExecution().toString()


@pytest.mark.parametrize("together,cells", [(200_000, 1 << 21), (4, 200)])
def test_many_queries_with_ties_in_blocks(spark, corpus, monkeypatch, together, cells):
    """Sixty copies tie for the same places; queries and documents come in blocks of any size."""
    monkeypatch.setattr(retrieval, "SCORE_CELLS", cells)
    _, ix = corpus
    asked = ["the rare", "rare", "w3 w4 of", "nothing", "a a w9"]
    got = retrieval.lexical_legs(ix, spark.createDataFrame([*enumerate(asked), (9, None)], "query_id long, query string"), 10, together).collect()
    assert {r.query_id for r in got} <= set(range(5))
    for n, q in enumerate(asked):
        own = sorted((r for r in got if r.query_id == n), key=lambda r: r["rank"])
        want = sorted(retrieval.indexed_leg(ix, q, 2000, direct=1 << 60).collect(), key=lambda r: (-round(r.score, 9), r.id))[:10]
        assert [(r.id, round(r.score, 8)) for r in own] == [(r.id, round(r.score, 8)) for r in want]
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))


def test_usual_words_are_cut_as_terms_are(spark):
    rng = random.Random(5)
    usual = [chr(c) for c in (*range(1, 0x250), *range(0x2000, 0x2070))] + list(" abcXYZ019") * 60
    made = ["".join(rng.choice(usual) for _ in range(rng.choice([0, 1, 30, 300]))) for _ in range(300)] + [None, "İıẞß Ⱥⱥ", "áb ΣΑΣ Σ 東京 ٣ a", "½x²y ªº"]
    df = spark.createDataFrame(list(enumerate(made)), "id long, _text string")
    want = {r.id: sorted(r.t) for r in df.select("id", text.terms(F.coalesce("_text", F.lit(""))).alias("t")).collect()}
    got = {r.id: (r.size, sorted(t for t, f in r.counts for _ in range(f))) for r in postings.counted_terms(df).collect()}
    assert got == {n: (len(t), t) for n, t in want.items()}


def test_blocks_hold_each_posting_once(corpus, monkeypatch):
    """One file holds a term's bounds and its postings, whatever the number of them that is sorted at a time."""
    _, ix = corpus
    rows_ = ix.postings.select("id", "term", F.col("f").cast("int").alias("f"), "size", "range", "bucket")
    want = {(r["term"], r["range"]): (r["n"], r["f"], r["size"]) for r in ix.postings.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("f").alias("f"), F.min("size").alias("size")).collect()}
    for together in (2_000_000, 1_000):
        monkeypatch.setattr(postings, "SORTED_POSTINGS", together)
        got = {}
        for r in postings.packed_blocks(rows_).collect():
            n, f, size = got.get((r["term"], r["range"]), (0, 0, 1 << 30))
            assert r["n"] == len(r["ids"]) == len(r["fs"]) == len(r["sizes"]) and (r["f"], r["size"]) == (max(r["fs"]), min(r["sizes"]))
            got[r["term"], r["range"]] = n + r["n"], max(f, r["f"]), min(size, r["size"])
        assert got == want
