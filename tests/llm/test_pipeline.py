"""The whole pipeline against brute force on a small fixture."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import byte_bpe, language_id, mixing
from tests.llm.test_language_id import by_force
from tests.llm.test_mixing import u
from tests.llm.test_near_copies import brute as near_copies_by_force


def brute(docs, dictionaries, margins, spark):
    kept = [d for d in docs if (p := by_force(d.text, dictionaries))[0] != "und" and p[1] >= margins.get(len(d.text).bit_length(), 0)]
    best = {}
    for d in kept:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text)
        best[key] = max(best.get(key, d), d, key=lambda x: x.doc_id)
    kept = sorted(best.values(), key=lambda d: d.doc_id)
    groups = near_copies_by_force([(d.doc_id, d.text) for d in kept])
    kept = [d for d in kept if groups.get(d.doc_id, d.doc_id) == d.doc_id]
    frame = spark.createDataFrame([tuple(d) for d in kept], "doc_id long, text string, lang string, source string, n_chars long")
    cdfs = {r.source: r.cdf for r in mixing.repetition_rates(frame, "source").select("source", mixing.cumulative(F.col("rate")).alias("cdf")).collect()}
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d in kept:
        tokens = coder.encode_ordinary(d.text)
        row = (d.doc_id, len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())
        out += [row] * sum(c <= u(d.doc_id) for c in cdfs[d.source])
    return sorted(out)


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labelled = docs.where(~language_id.held_out(F.col("doc_id")))
    dictionaries = language_id.learn(labelled)
    margins = language_id.calibrate(labelled, dictionaries)
    want = brute(docs.collect(), dictionaries, margins, spark)
    assert want and sorted(tuple(r) for r in corpus_pipeline.run(spark, small).collect()) == want


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", None, 15), (None, "some words here", "en", None, 15), (3, "Some words here", "de", "a", 15), (4, "x" * 200_000, "de", "b", 1)]
ODD += [(5, "alpha copy", "en", "a", 10), (5, "only here", "en", "a", 9), (9, "Alpha copy", "en", "a", 10), (None, "null id alone", "en", "a", 13)]
#: By stage: the places in ODD of the rows that stay; None: see the tests.
STAYS = {"language_id": None, "exact_dedup": [1, 4, 5, 7, 8, 9], "simhash_near_dedup": [0, 1, 4, 5, 6, 7, 9], "source_mixing": None, "byte_bpe": None}


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("row", F.lit(1))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name, stage):
    docs = odd(spark)
    rows = stage(spark, docs, "").collect()
    if name == "language_id":  # two languages, too few documents for margins: only what has no letter goes
        assert sorted(map(tuple, rows), key=str) == sorted((r for r in ODD if r[1]), key=str)
    elif name == "source_mixing":
        cdfs = {r.source: r.cdf for r in mixing.repetition_rates(docs, "source").select("source", mixing.cumulative(F.col("rate")).alias("cdf")).collect()}
        want = [r for r in ODD for c in cdfs[r[3]] if c <= u(r[0])]
        assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    elif name == "byte_bpe":
        want = [(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ODD]
        assert sorted(((r.doc_id, r.decoded_sha256) for r in rows), key=str) == sorted(want, key=str)
        assert all((r.n_tokens == 0) == (r.decoded_sha256 == hashlib.sha256(b"").hexdigest()) for r in rows)
    else:
        assert sorted(map(tuple, rows), key=str) == sorted((ODD[i] for i in STAYS[name]), key=str)
    empty = stage(spark, docs.limit(0), "")
    assert empty.count() == 0 and (name == "byte_bpe" or empty.columns == corpus_pipeline.COLUMNS)
