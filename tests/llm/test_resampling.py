import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import resampling
from folio.llm.queries import op12_resampling
from tests.llm.cases import frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text, longest=2, size=10_000):
    own = words(text)
    return [zlib.crc32(" ".join(own[i : i + n]).encode()) % size for n in range(1, longest + 1) for i in range(len(own) - n + 1)]


def brute(docs, target, percent=25, seed=7, least=20):
    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        own = buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, folder):
    at = f"/root/testdata/{folder}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = op12_resampling(spark, at)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(docs, target), key=repr)


@given(st.lists(st.text(max_size=80), max_size=6), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_composed_crcs(texts, longest):
    _, text, bucket = resampling.Features(1 << 31, longest).of([t.encode("utf-8", "ignore") for t in texts])
    for i, t in enumerate(texts):
        t = t.encode("utf-8", "ignore").decode()
        assert sorted(bucket[text == i].tolist()) == sorted(buckets(t, longest, 1 << 31))


@given(st.binary(max_size=50), st.integers(0, 100_000))
@settings(deadline=None)
def test_zeros_appended(head, n):
    tail = zlib.crc32(bytes(n))
    got = resampling.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([n]))[0] ^ np.uint32(tail)
    assert got == zlib.crc32(head + bytes(n))


def test_odd_rows_and_ties(spark):
    docs = frame(spark).union(frame(spark)).withColumns({"rank": F.lit("clash"), "weight": F.lit("clash")})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = frame(spark, [(1, "the quick word1 other1"), (2, None), (3, "")])
    gain = resampling.gains(resampling.count(docs), resampling.count(target))
    got = resampling.draw(resampling.weigh(docs, gain), percent=50, least_words=2).select("id", "n_features", "weight", "score", "rank").collect()
    want = brute(rows, ["the quick word1 other1"], 50, least=2)
    assert sorted(map(repr, map(tuple, (r[:4] for r in got)))) == sorted(map(repr, (r[:4] for r in want)))
    assert sorted((r[4] for r in got if r[4]), key=int) == sorted(r[4] for r in want if r[4])
    assert {(r[0], r[3], r[4]) for r in got} == {(r[0], r[3], r[4]) for r in want}


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    zero = resampling.count(none)
    assert zero.sum() == 0 and resampling.draw(resampling.weigh(none, resampling.gains(zero, zero)), percent=25).count() == 0


def test_drawn_documents_are_nearer_to_the_target(spark, small):
    got = op12_resampling(spark, small).toPandas()
    assert got[got["rank"].notna()].weight.mean() > got[got["rank"].isna() & (got.n_features >= 39)].weight.mean()
