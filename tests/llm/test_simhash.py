import numpy as np
import xxhash

from folio.llm import simhash
from tests.llm.cases import ROWS, frame


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(fps)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def check(spark, rows, limit=64):
    got = simhash.near_duplicates(frame(spark, rows), bucket_limit=limit).collect()
    assert len(got) == len(rows)
    fps = {}
    for i, text in rows:
        fps.setdefault(brute_fingerprint(text), []).append(i)
    roots = brute_components(set(fps))
    least = {}
    for f, ids in fps.items():
        known = [i for i in ids if i is not None] + [least.get(roots[f])] * (roots[f] in least)
        least[roots[f]] = min((i for i in known if i is not None), default=None)
    want = sorted(((i, f, least[roots[f]]) for f, ids in fps.items() for i in ids), key=str)
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in got), key=str) == want


def test_edge_cases(spark):
    check(spark, ROWS)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(spark, rows)


def planted():
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)}
    far = {int(x) for x in rng.integers(0, 2**63, 200)}
    return near | far | {x ^ 3 for x in list(far)[:50]}


def test_crowded_buckets_and_pairs_give_the_same_components(spark):
    values = planted()
    want = brute_components(values)
    frames = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    for limit in (1, 4, 10_000):
        edges, _ = simhash.links(frames, bucket_limit=limit)
        groups = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
        ours = {v: groups.get(v, v) for v in values}
        classes = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
        assert classes(ours) == classes(want)


def test_pivot_table_discards_all_pairs_of_more_than_four_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    table = lambda x: np.bitwise_count(x[:, None] ^ simhash.pivots()[None, :]).astype(int)
    for m in range(1, 9):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, m, replace=False)) for _ in a], dtype=np.uint64)
        most = np.abs(table(a) - table(a ^ flips)).max(axis=1)
        assert (most <= m).all()
        assert m <= 4 or (most > 2).all()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160))
