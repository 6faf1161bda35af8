import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import packing
from folio.llm.queries import op11_packing
from tests.llm.cases import frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, texts, tokenizer, capacity=2048, slack=packing.SLACK):
    """pieces: (doc, start, length, crc, doc_tokens, sequence, offset); texts: by doc. Returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for _, start, length, crc, total, _, _ in sorted(own, key=lambda p: p[1]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    free = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p[6]):
            assert p[6] == at and p[2] > 0
            at += p[2]
        assert at <= capacity and (capacity - at <= 2 * slack or at & (at - 1) == 0)
        free += capacity - at if at & (at - 1) else 0
    return free / (capacity * len(by_sequence))


def test_query_against_the_whole_tokenizer(spark, small, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = [tuple(r) for r in op11_packing(spark, small).collect()]
    assert check(got, docs, tokenizer) < 0.01


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aBcdé 's\t\n\r\x0b\x0c\x1c\x85\xa0 　̣́Σςİß0123,.!'-<|>中日한😀ﬁẛ")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_by_stretches_equal_whole_texts(texts):
    coder = _coder()
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.encode([t.encode() for t in texts])] == want


def _coder(held=[]):  # noqa: B006
    held[:] = held or [packing.Coder(PATH, remembered=50)]
    return held[0]


def test_every_token_is_what_its_symbols_merge_to():
    """What makes merging by tokens equal merging by pairs."""
    merges = packing.Coder(PATH).merges
    rank = {pair: i for i, pair in enumerate(merges.pairs)}
    assert len({a + b for a, b in merges.pairs}) == len(merges.pairs)
    for a, b in merges.pairs:
        whole = a + b
        parts = [*whole.removesuffix("</w>")]
        if whole.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, len(rank)))
            assert best in rank, whole
            out, i = [], 0
            while i < len(parts):
                step = 2 if tuple(parts[i : i + 2]) == best else 1
                out.append("".join(parts[i : i + step]))
                i += step
            parts = out
        assert parts == [whole]


def test_merges_equal_the_tokenizer(tokenizer):
    rng = np.random.default_rng(5)
    letters = ["the", "ing", "tion", "er", "q", "zx", "aa", "ss", "ou", "'", "--", "..", "!", "8"]
    kinds = [letters, list("abcdefghijklmnopqrstuvwxyz"), list("aeéÉèçñÑöÖßàÀÿŸœŒŁłſ×÷İıµ'st")]
    runs = ["".join(rng.choice(kinds[i % 3], rng.integers(1, 14))) for i in range(30_000)]
    got = packing.Coder(PATH).encode([r.encode() for r in runs])
    want = tokenizer.encode_batch(runs, add_special_tokens=False)
    assert all(g.tolist() == w.ids for g, w in zip(got, want, strict=True))


def test_special_tokens_and_long_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 64)
    text = "Hello<|endoftext|>it's " * 40 + "x" * 500 + " end <|startoftext|> "
    assert packing.Coder(PATH).encode([b"", text.encode(), b"  "])[1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 9000), st.sampled_from([(2048, 32), (2048, 0), (100, 7), (7, 0)]))
@settings(deadline=None)
def test_cuts(total, size):
    capacity, slack = size
    own = packing.cuts(total, capacity, slack)
    assert sum(own) == total and all(0 < n <= capacity for n in own)


@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([(2048, 32), (64, 3)]))
@settings(deadline=None)
def test_classes_have_a_fixed_number_of_pieces(lengths, size):
    capacity, slack = size
    packer, seen = packing.Packer(capacity, slack), 0
    for doc, n in enumerate(lengths):
        for pieces in packer.place(doc, np.arange(n, dtype=np.uint32)):
            k = {capacity // len(ids) for _, _, ids in pieces}
            assert len(k) == 1 and len(pieces) == k.pop() and sum(len(ids) for _, _, ids in pieces) <= capacity
            seen += sum(len(ids) for _, _, ids in pieces)
    for pieces in packer.finish():
        n = sum(len(ids) for _, _, ids in pieces)
        assert n == capacity or n & (n - 1) == 0 or capacity - n <= slack
        assert all((ids == np.arange(start, start + len(ids))).all() for _, start, ids in pieces)
        seen += n
    assert seen == sum(lengths)


def test_odd_rows(spark, tokenizer):
    docs = frame(spark)
    for name in ("start", "length", "sequence_id", "offset"):
        docs = docs.withColumn(name, docs.lang)
    for own in (docs, docs.repartition(7)):
        rows = packing.pack(own, PATH).collect()
        assert sum(r.length for r in rows) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
        assert {r.doc_tokens for r in rows if r.id in (3, 4, 5)} == {1}
        assert any(r.id is None for r in rows)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_sequences_are_padded(spark):
    docs = spark.createDataFrame([(i, "word " * (97 * i % 3000)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(docs, PATH)
    whole = packing.sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(97 * i % 3000 + 1 for i in range(60))
    for r in whole:
        assert len(r.ids) == 4 * (2048 if r.length & (r.length - 1) else r.length)
        ids = np.frombuffer(r.ids, "<u4")
        assert (ids[r.length :] == 0).all() and (ids[: r.length] > 0).all()
        assert sum(p.length for p in r.documents) == r.length
    assert {tuple(r) for r in packed.collect()} == {tuple(r) for r in packed.collect()}
