import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import byte_bpe
from folio.llm.queries import bpe_digests, bpe_model
from tests.llm.cases import ROWS, frame


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=[True, False], ids=["by stretch", "by match"])
def ours(request):
    return byte_bpe.Coder(*bpe_model(), by_stretch=request.param)


def test_each_token_is_its_own_piece(ranks, ours):
    got = ours.pieces.encode([byte_bpe.as_piece(t) for t in ranks], out_type=int)
    assert got == [[r] for r in ranks.values()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FFFF), st.sampled_from("ab'sS t1éж²Ⅷ.,\n\r\t\x0b\x1c\x1f\x85\xa0　 ")), max_size=60))
def test_like_tiktoken(ours, theirs, text):
    ids = ours.encode(text).tolist()
    assert ids == theirs.encode_ordinary(text)
    table = ours.token_bytes()
    assert b"".join(table[i] for i in ids) == text.encode()


def test_any_pattern(ranks):
    """Matches with white space inside them, which the shortcut for stretches would cut."""
    pattern = r"[0-9]{1,3}|[^0-9]+"
    own = byte_bpe.Coder(bpe_model()[0], pattern)
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("it costs 12345 dollars, or  so it   says 7", "no digits at all in here", "  1 2  ", "a\nb 10\n\n", ""):
        assert own.encode(text).tolist() == theirs.encode_ordinary(text)


def test_edge_cases(spark, theirs):
    model, pattern = bpe_model()
    rows = byte_bpe.decode(byte_bpe.encode(frame(spark), model, pattern), model, pattern).collect()
    got = sorted((str(r.doc_id), r.text or "", list(r.ids), bytes(r.decoded)) for r in rows)
    assert got == sorted((str(i), t or "", theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS)


def test_documents_and_empty(spark, small, theirs):
    import hashlib

    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in bpe_digests(docs).collect()}
    for d in docs.collect():
        ids = theirs.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
    assert bpe_digests(docs.limit(0)).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0, b"b": 2})
