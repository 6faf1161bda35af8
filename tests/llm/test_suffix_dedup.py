import numpy as np
import pytest

from folio.llm import suffix_dedup
from tests.llm.cases import ROWS, frame


def brute(rows, length):
    seen, out = {}, []
    keyed = {(suffix_dedup.NULL_ID if i is None else i, (t or "").encode() if not isinstance(t, bytes) else t): i for i, t in rows}
    import hashlib

    order = sorted(keyed, key=lambda k: (k[0], hashlib.sha256(k[1]).digest()))
    for n, (i, text) in enumerate(order):
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - length + 1):
            string = text[s : s + length]
            if string in seen:
                gone[s : s + length] = True
            else:
                seen[string] = (n, s)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out += [(keyed[i, text], len(text), int(gone.sum()), spans, kept)]
    answer = {(x[0], r): x[1:] for x, (_, r) in zip(out, order, strict=True)}
    return sorted(((i, *answer[i, (t or "").encode()]) for i, t in rows), key=str)


def check(spark, rows, length=100, gram=32, **more):
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=length, gram=gram, **more).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, length)


def some_texts(seed=3, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 8))) for _ in range(300)]
    say = lambda k: " ".join(words[i] for i in rng.integers(0, 300, k))
    passages = [say(int(rng.integers(15, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = " ".join(say(int(rng.integers(1, 60))) if rng.random() < 0.6 else passages[int(rng.integers(0, 6))] for _ in range(rng.integers(1, 6)))
        if rng.random() < 0.2 and rows:
            other = list(rows[int(rng.integers(0, len(rows)))][1])
            other[int(rng.integers(0, len(other)))] = "é"
            text = "".join(other)
        rows.append((int(rng.integers(0, 10**6)), text))
    rows += [(7, "ab" * 400), (8, "x" * 700), (9, "x" * 50 + "y" * 260), (5, rows[0][1]), (6, rows[0][1] + "!")]
    return rows


@pytest.mark.parametrize("bucket_pieces", [2, 4096])
def test_against_brute_force(spark, bucket_pieces):
    check(spark, some_texts(), bucket_pieces=bucket_pieces)


def test_other_lengths_and_shuffled_exceptions(spark):
    check(spark, some_texts(9, 40), length=50, gram=16, broadcast_rows=0)


def test_edge_cases(spark):
    rows = [r for r in ROWS if r[0] not in (6, 7)]
    text = rows[0][1] * 5
    check(spark, rows + [(None, text), (3, text), (3, text + "x"), (20, text), (20, text)])


def test_long_texts_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 3000))
    assert sorted(x for at, part in suffix_dedup.slices(text.encode(), 100, 256) for x in range(at, at + len(part) - 99)) == list(range(2901))
    long = ROWS[5][1][:60_000]
    check(spark, [(1, long), (2, long[:30_000] + "#" + long[30_000:]), (3, long[500:])])


def test_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_cover_reaches_every_difference():
    for period in (8, 16, 32, 64):
        cover = suffix_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
        assert len(cover) <= 2.2 * period**0.5


def test_blockwise_order_is_the_suffix_order():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(97, 99, 400), np.tile([97, 98, 98], 200), rng.integers(97, 99, 400), np.tile([97, 98, 98], 100)]).astype(np.uint8)
    starts = np.arange(len(text) - 100)
    raw = text.tobytes()
    for size in (1, 50, 10**6):
        got = list(suffix_dedup.blockwise_order(text, starts, 100, bucket_suffixes=size))
        order, same = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        heads = [raw[i : i + 100] for i in order]
        assert heads == sorted(heads) and sorted(order) == list(starts)
        assert list(same[1:]) == [a == b for a, b in zip(heads, heads[1:], strict=False)]


def test_cut_out():
    assert suffix_dedup.cut_out(b"0123456789", [(2, 4), (4, 5), (3, 5), (8, 9)]) == (b"0156" + b"79", 4, 2)
    assert suffix_dedup.cut_out(b"abc", []) == (b"abc", 0, 0)
    assert suffix_dedup.cut_out(b"abc", [(0, 3)]) == (b"", 3, 1)


def test_parts_of_pieces_keep_equal_strings_together():
    """Each string lies in one part, by its anchor's place; equal strings of different pieces share a bucket."""
    rng = np.random.default_rng(6)
    length, gram = 100, 32
    middle = bytes(rng.integers(97, 123, 110, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) + middle + bytes(rng.integers(97, 123, 90, dtype=np.uint8)) for n in (0, 40, 90)]
    for width in (35, 18, 9, 5, 3, 2, 1):
        buckets: dict[bytes, set[int]] = {}
        for text in texts:
            for at, part in suffix_dedup.slices(text, length):
                for _, first, last, anchor in zip(*suffix_dedup.pieces(part, length, gram), strict=True):
                    piece = part[first : last + length]
                    starts = []
                    for bucket, a, b in suffix_dedup.split_piece(int(anchor - first), piece, length, width):
                        assert 0 <= a <= b <= last - first
                        starts += range(a, b + 1)
                        for s in range(a, b + 1):
                            buckets.setdefault(piece[s : s + length], set()).add(bucket)
                    assert sorted(starts) == list(range(last - first + 1))
        assert all(len(b) == 1 for b in buckets.values())


@pytest.mark.parametrize("bucket_pieces", [1, 3])
def test_crowded_buckets_are_split_until_they_fit(spark, bucket_pieces):
    """A common line with other neighbours each time, some of which repeat."""
    rng = np.random.default_rng(12)
    line = "this line stands in every text of the table, " * 2
    sides = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(5, 80))) for _ in range(6)]
    rows = [(i, sides[int(rng.integers(0, 6))] + line + sides[int(rng.integers(0, 6))] + str(i % 4)) for i in range(40)]
    check(spark, rows, bucket_pieces=bucket_pieces, broadcast_rows=0 if bucket_pieces == 1 else 1000)


def test_many_texts_of_one_id(spark):
    rows = [(None, f"{'x' * (i % 5)} text number {i} " + "shared words all of these rows have in common and long enough to count " * 2) for i in range(40)] + [(7, "seven " * 40), (7, "seven " * 41), (7, "other " * 40)]
    check(spark, rows)
