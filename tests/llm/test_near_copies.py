import numpy as np
import pytest

import corpus_pipeline
from folio.llm import near_copies as nc
from tests.llm.cases import ROWS, frame


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, similarity=0.8):
    sets = {i: shingles(t) for i, t in rows if i is not None and shingles(t)}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {i: root(i) for i in ids}
    sizes = list(groups.values())
    return {i: r for i, r in groups.items() if sizes.count(r) > 1}


def planted():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [words[i] for i in rng.integers(0, 3000, n)]
    rows, i = [], 0
    for size, n in ((12, 60), (3, 100), (2, 400), (40, 200), (1, 100), (1, 30)):
        base = say(n)
        for copy in range(size):
            text = list(base)
            for _ in range(rng.integers(0, max(1, n // 100) + 1) if copy else 0):
                text[int(rng.integers(0, n))] = f"edit{i}"
            rows.append((i, " ".join(text)))
            i += 1
    return rows


@pytest.mark.parametrize("limit", [4, 1000])
def test_planted_groups(spark, limit):
    rows = planted()
    got = {r.id: r.component_id for r in nc.near_copies(frame(spark, rows), bucket_limit=limit).collect()}
    assert got == brute(rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.id: r.component_id for r in nc.near_copies(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_edge_cases_and_empty(spark):
    rows = [r for r in ROWS if r[0] != 10]
    got = {r.id: r.component_id for r in nc.near_copies(frame(spark, rows), broadcast_ids=0).collect()}
    assert got == brute(rows)
    assert nc.near_copies(frame(spark, [])).count() == 0


def decided(spark, rows, **options):
    return {r.id: r.component_id for r in nc.near_copies(frame(spark, rows), **options).collect()}


def test_pairs_within_a_crowd_of_half_copies(spark):
    """Twelve pairs of near copies that share 340 of 400 words with all others: every pair is found, in any bucket size."""
    rng = np.random.default_rng(9)
    shared, rows = [f"s{i}" for i in range(340)], []
    for pair in range(12):
        own = [f"p{pair}x{i}" for i in range(60)]
        at = int(rng.integers(0, 280))
        text = shared[:at] + own + shared[at:]
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join([*text, f"end{pair}"]))]
    want = brute(rows)
    assert len(want) == 24
    for limit in (2, 24):
        assert decided(spark, rows, bucket_limit=limit, part_rows=5) == want


def test_family_without_its_original(spark):
    """Few of hundreds of copies are near to all; most are linked through these only, whichever is compared first."""
    rng = np.random.default_rng(3)
    base, rows = [f"b{i}" for i in range(300)], []
    for i in range(260):
        text = list(base)
        for n, at in enumerate(rng.choice(60, 2 if i % 40 == 7 else 4, replace=False) * 5):
            text[at] = f"edit{i}.{n}"
        rows.append((i, " ".join(text)))
    want = brute(rows)
    assert len(want) > 200
    assert decided(spark, rows, bucket_limit=8, part_rows=50) == want


def test_unlike_texts_with_one_passage(spark):
    rng = np.random.default_rng(5)
    passage = [f"common{i}" for i in range(40)]
    rows = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 5000, 60)), *passage])) for i in range(90)]
    rows += [(100 + i, t + " more") for i, t in rows[:3]]
    assert decided(spark, rows, bucket_limit=6) == brute(rows)


def test_short_texts(spark):
    words = "a b c d e f g h".split()
    rows = [(i, " ".join(words[:n] + extra)) for i, (n, extra) in enumerate([(8, []), (8, ["i"]), (7, []), (5, []), (5, ["x"]), (4, []), (3, []), (1, []), (8, ["i", "j"])])]
    rows += [(50 + i, " ".join(f"{k}{i}" for k in words)) for i in range(300)] + [(400 + i, " ".join([f"{k}{i}" for k in words] + ["z"])) for i in range(300)]
    assert decided(spark, rows) == brute(rows)


def test_rows_are_judged_one_by_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (5, "quite another text of this id"), (3, base + " end"), (None, base + " more"), (None, "only here"), (9, base), (9, base), (None, None), (8, ""), (8, "")]
    kept = nc.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(5, rows[1][1]), rows[2], rows[4], rows[7], rows[8], rows[9]], key=str)
    repeated = nc.keep_one(frame(spark, [(1, base)] * 7 + [(None, "x y")] * 3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in repeated) == [("1", base), ("None", "x y")]
    assert nc.keep_one(frame(spark, [])).count() == 0


def test_pivot_distances_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (set(rng.integers(0, 400, rng.integers(1, 200)).tolist()) for _ in range(2))
        x, y = (np.bincount(np.array(list(s)) % nc.CLASSES, minlength=nc.CLASSES) for s in (a, b))
        assert np.abs(x - y).sum() <= len(a ^ b)
        u, v = (nc.fingerprint_bits(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (a, b))
        assert nc.bits_apart(u, v) <= len(a ^ b) and nc.bits_apart(u, u) == 0 and nc.bits_apart(u, v) == nc.bits_apart(v, u)
        if len(a & b) >= 0.8 * len(a | b):
            assert 9 * len(a ^ b) <= len(a) + len(b)


def test_links_by_fingerprints_are_links_too(spark):
    """Two texts with one fingerprint and a similarity of under 0.8: a line many times over decides each bit."""
    line = "all rights reserved by the owners of this work and by nobody else "
    rows = [(1, line * 200 + "alpha beta gamma delta epsilon zeta eta theta"), (2, line * 200 + "one two three four five six seven eight nine"), (3, "quite another text of a few words"), (4, None), (5, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute(rows) == {} and sorted(r.doc_id for r in nc.keep_one(docs).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.doc_id for r in nc.keep_one(docs, fingerprints=True).collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.selectExpr("*", "'en' AS lang", "'a' AS source", "1L AS n_chars"), "").collect()) == [1, 3, 4, 5]
