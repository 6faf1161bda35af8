from collections import Counter
from itertools import combinations, product

from pyspark.sql import functions as F

from folio.llm import url_rules
from folio.llm.queries import op7_url_rules

URLS = [
    (1, "https://WWW.Example.com/en/x?utm_source=1#top"),
    (2, "https://example.com/en/1"),
    (3, "https://sub.example.com/en/"),
    (4, "https://badexample.com/en/"),
    (5, "https://a.net/es/1"),
    (6, "https://a.net/fr"),
    (7, "https://a.net/de/"),
    (8, "https://a.com"),
    (9, "https://com/"),
    (10, None),
    (11, ""),
    (12, "no scheme.com/en/"),
    (13, "x://"),
    (14, "https://a.net/es/1"),
    (None, "https://www.example.com/en/" + "long/" * 5000),
    (15, "HTTPS://ÄB.NET/ES/?a://b.net/es/"),
]


def python_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def python_rule(host, path):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_rules.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "token", "have", "tokens", "anchor"):
        made = made.withColumn(name, F.lit("clash"))
    return made


def empty_rules(spark):
    return spark.createDataFrame([], "tokens array<string>, members array<array<string>>, anchor string, support double, confidence double")


def test_parts_and_given_rules(spark):
    got = url_rules.judge(frame(spark, URLS), empty_rules(spark)).collect()
    want = []
    for i, url in URLS:
        rule, verdict = python_rule(*python_parts(url))
        want.append((i, *python_parts(url), rule, verdict or "allow"))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(want, key=str)


def brute_rules(baskets, min_support, min_confidence, min_rows=1):
    out, n = {}, len(baskets)
    least = max(min_support * n, min_rows)
    alone = Counter(t for b, bad in baskets if bad for t in b)
    universe = {frozenset(c) for b, bad in baskets if bad for k in range(1, len(b) + 1) for c in combinations(sorted(t for t in b if alone[t] >= least), k)}
    for items in universe:
        having = [bad for b, bad in baskets if items <= b]
        if sum(having) >= least and sum(having) / len(having) >= min_confidence:
            out[items] = sum(having) / len(having)
    return {i for i in out if not any(j < i and out[j] >= out[i] for j in out)}


def test_mined_rules_and_matches_against_brute_force(spark):
    urls = [f"http://{h}.{d}/{s}/{i}" for i, (h, d, s) in enumerate([("a", "x", "p"), ("a", "y", "q"), ("b", "x", "q"), ("b", "y", "p"), ("c", "x", "p")] * 12)]
    bad = [("a." in u and "/p/" in u) or ("b." in u and ".x" in u and i % 4 > 0) for i, u in enumerate(urls)]
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(zip(urls, bad, strict=True))], "page_id long, url string, bad boolean")
    mined = url_rules.mine(pages, min_support=0.05, min_confidence=0.7)
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    want = brute_rules([(tokens[i], b) for i, b in enumerate(bad)], 0.05, 0.7)
    got = mined.collect()
    every = [frozenset(c) for r in got for c in product(*r.members)]  # one token of each item
    assert set(every) == want and want and len(every) == len(want)
    assert all(r.anchor in r.tokens and [m[0] for m in r.members] == r.tokens for r in got)
    for limit in (0, 1000):
        hit = {r.url for r in url_rules.matched_urls(pages, mined, broadcast_rules=limit).collect()}
        assert hit == {u for i, u in enumerate(urls) if any(w <= tokens[i] for w in want)}
        verdicts = {r.url: r.verdict for r in url_rules.judge(pages, mined, [], broadcast_rules=limit).collect()}
        assert all((verdicts[u] == "block") == (u in hit) for u in urls)


def test_repeated_rows_with_long_paths(spark):
    """Five copies of a url of 40 segments, and one with a few of them: 2^45 sets of tokens, one item."""
    import time

    deep = "http://deep.org/" + "/".join(f"s{i}x" for i in range(40))
    rows = [(i, deep, True) for i in range(5)] + [(5, "http://clean.net/a", False), (6, None, True), (7, "", True), (8, None, False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    began = time.time()
    mined = url_rules.mine(pages).collect()
    assert time.time() - began < 120
    assert sorted(len(r.tokens) for r in mined) == [1, 1] and max(len(r.members[0]) for r in mined) == 43
    asked = [("http://x.y/s7x", "block"), ("http://clean.net/a", "block"), ("ftp://x.y/z", "allow"), (None, "allow"), (deep, "block"), ("https://deep.org", "block")]
    other = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(asked)], "page_id long, url string")
    got = url_rules.judge(other, url_rules.mine(pages), []).collect()
    assert {r.url: r.verdict for r in got} == dict(asked)
    tokens = [(python_tokens(u) - {f"segment=s{i}x" for i in range(3, 40)}, b) for _, u, b in rows]
    assert {frozenset(c) for r in mined for c in product(*r.members)} & {frozenset([t]) for b, _ in tokens for t in b} == brute_rules(tokens, url_rules.MIN_SUPPORT, url_rules.MIN_CONFIDENCE, url_rules.MIN_ROWS)


def test_nothing_labelled_and_empty(spark):
    none = frame(spark, URLS).withColumn("bad", F.lit(None).cast("boolean"))
    assert url_rules.mine(none).count() == 0
    assert url_rules.mine(none.withColumn("bad", F.lit(False))).count() == 0
    assert url_rules.judge(frame(spark, []), empty_rules(spark)).count() == 0


def test_hosts_named_like_the_class_item(spark):
    rows = [(i, f"http://bad.com/{'x' if i % 2 else 'y'}/{i}", i % 2 == 1) for i in range(40)] + [(100 + i, f"http://{h}/", False) for i, h in enumerate(["label=bad", "=bad", "bad"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    assert {tuple(r.tokens) for r in url_rules.mine(pages, min_support=0.1, min_confidence=0.9).collect()} == {("segment=x",)}
    one = spark.createDataFrame([(1, "http://bad.com/x", True)], "page_id long, url string, bad boolean")
    assert url_rules.mine(one).count() == 0
    assert url_rules.mine(one, min_rows=1).count() > 0
    unlabelled = spark.createDataFrame([(i, "http://bad.com/x", False) for i in range(9)], "page_id long, url string, bad boolean")
    assert url_rules.mine(unlabelled).count() == 0


def python_tokens(url):
    """Tokens in plain Python."""
    host, path = python_parts(url)
    if url is None:
        return frozenset()
    scheme = url.split("://", 1)[0].lower() if "://" in url else ""
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    out = {f"scheme={scheme}"} if scheme else set()
    out |= {f"host={host}"} if host else set()
    out |= {f"label={x}" for x in host.split(".") if x}
    out |= {f"segment={x}" for x in path.split("/") if any("a" <= c.lower() <= "z" and c.isascii() for c in x)}
    out |= {f"key={k}" for x in query.split("&") if (k := x.split("=")[0])}
    return frozenset(out | ({"fragment"} if "#" in url else set()))


def test_registered_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    labels = [(r.doc_id, r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    rules = brute_rules([(python_tokens(pages[i]), bad) for i, bad in labels if i in pages], url_rules.MIN_SUPPORT, url_rules.MIN_CONFIDENCE, url_rules.MIN_ROWS)
    want = {}
    for i, url in pages.items():
        host, path = python_parts(url)
        rule, verdict = python_rule(host, path)
        have = python_tokens(url)
        want[i] = (host, path, rule, verdict or ("block" if any(r <= have for r in rules) else "allow"))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op7_url_rules(spark, sf).collect()} == want
