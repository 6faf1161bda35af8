import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.llm import cross_entropy as ce
from tests.llm.cases import ROWS, frame


def brute(rows, target_ids):
    """Exact n-grams, in dictionaries."""
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    size, models = len({w for _, t in rows for w in words(t)}) + 1, []
    for chosen in ([r for r in rows if r[0] in target_ids], rows):
        c1, ctx, c2 = Counter(), Counter(), Counter()
        for _, t in chosen:
            w = words(t)
            c1.update(w)
            ctx.update([b"", *w][:-1] if w else [])
            c2.update(zip([b"", *w], w, strict=False))
        models.append((c1, ctx, c2, sum(c1.values())))
    out = []
    for i, t in rows:
        w, losses = words(t), []
        for c1, ctx, c2, n in models:
            p = lambda h, x: (c2[h, x] + ce.MU * (c1[x] + ce.ALPHA) / (n + ce.ALPHA * size)) / (ctx[h] + ce.MU)  # noqa: E731, B023
            losses.append(-sum(math.log(p(h, x)) for h, x in zip([b"", *w], w, strict=False)) / len(w) if w else None)
        out.append((i, len(w), losses[0], losses[1]))
    return out


def test_against_exact_counts(spark):
    rows = [r for r in ROWS if r[0] not in (6, 7)] + [(20 + i, f"alpha beta gamma {i % 3} beta") for i in range(9)]
    docs = frame(spark, rows).withColumn("target", F.col("doc_id") > 21)
    got = ce.score(docs, ce.fit(docs)).collect()
    want = brute(rows, {i for i, _ in rows if i is not None and i > 21})
    key = lambda x: str((x[0], x[1], round(x[3] or 0, 9)))
    ours = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key)
    for a, b in zip(ours, sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == (pytest.approx(b[2]), pytest.approx(b[3]))
    assert all(r.score is None if r.n_tokens == 0 else r.score == pytest.approx(r.target_loss - r.background_loss) for r in got)


def test_target_documents_score_lower(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("target", F.col("lang") == "de")
    mean = {r.target: r.m for r in ce.score(docs, ce.fit(docs)).groupBy("target").agg(F.avg("score").alias("m")).collect()}
    assert mean[True] < mean[False] - 1


def test_independent_of_partitions_long_texts_and_empty(spark):
    docs = frame(spark).withColumn("target", F.col("doc_id") == 6)
    rows = lambda d, m: sorted(((r.doc_id, r.n_tokens, r.score) for r in ce.score(d, m).collect()), key=str)
    assert rows(docs, ce.fit(docs)) == rows(docs.repartition(5), ce.fit(docs.repartition(5)))
    assert {r[1] for r in rows(docs, ce.fit(docs)) if r[0] == 6} == {80_000}
    none = docs.limit(0)
    assert ce.score(none, ce.fit(none)).count() == 0
    assert {r.score for r in ce.score(docs, ce.fit(docs.withColumn("target", F.lit(None).cast("boolean")))).collect()} != {None}


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 100_000}])
def test_n_grams_share_no_counters(spark, sizes):
    """Over 260,000 bigrams: among 2**20 slots many would share one."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = table.withColumn("target", F.col("doc_id") % 5 == 0)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    scored = ce.score(docs, ce.fit(docs)) if not sizes else ce.fit_and_score(docs, **sizes)
    got = {r.doc_id: r for r in scored.collect()}
    want = brute(rows, {i for i, _ in rows if i % 5 == 0})
    assert len(got) == len(want)
    for i, n, target, background in want:
        assert got[i].n_tokens == n and (got[i].target_loss, got[i].background_loss) == (pytest.approx(target), pytest.approx(background))


def test_texts_that_were_not_counted(spark):
    docs = frame(spark, [(1, "a b c"), (2, "a b d")]).withColumn("target", F.col("doc_id") == 1)
    r = ce.score(frame(spark, [(3, "x y")]), ce.fit(docs)).first()
    assert r.background_loss == pytest.approx(-math.log(ce.ALPHA / (6 + ce.ALPHA * 5)) - math.log(200 / 202) / 2)


def test_fitted_and_scored_at_once(spark):
    docs = frame(spark).withColumn("target", F.col("doc_id") == 6)
    key = lambda d: sorted(((r.doc_id, r.text, r.source, r.n_tokens, r.target_loss, r.score) for r in d.collect()), key=str)
    assert key(ce.fit_and_score(docs)) == key(ce.score(docs, ce.fit(docs)))
    assert ce.fit_and_score(docs.limit(0)).count() == 0
