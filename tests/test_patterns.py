import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators import patterns, review


@pytest.mark.parametrize(
    ("pattern", "words"),
    [
        ("tion\\b", ("tion",)), ("^[A-Z][a-z]+ a", (" a",)), ("ing[,.]", ("ing",)), ("foo|ba+r", ("foo", "ba")[:0] or ("b", "foo")), ("a*b", ("b",)), ("(?:abc)?", None),
        ("(ab){2}c", ("ab",)), ("(?i)Secret", ("secret",)), ("x|", None), (".*", None), ("(unclosed", None), ("\\Qa.b\\E", None), ("\\p{L}x", None), ("a(?=b)", None), ("[a&&b]c", None), ("", None), ("TODO: (fix|mend) it", ("todo: ",)),
    ],
)
def test_required_words(pattern, words):
    assert patterns.required_words(pattern) == words


@given(st.recursive(st.sampled_from(["a", "b", "c", ".", "\\w", "[ab]", "^", "$", "\\b", "é", "B"]), lambda x: st.one_of(st.lists(x, min_size=1, max_size=4).map("".join), x.map("(?:{})*".format), x.map("({})+".format), st.tuples(x, x).map("(?:{0[0]}|{0[1]})".format)), max_leaves=9), st.text(alphabet="abcBé x", max_size=12))
@settings(max_examples=600, deadline=None)
def test_every_match_holds_a_required_word(pattern, text):
    words = patterns.required_words(pattern)
    if words and re.search(pattern, text):
        assert any(w in patterns._lower(text) for w in words)


def rules_frame(spark, found):
    return spark.createDataFrame([(i, f"book://r/styleguide/en/w/{i}", f"r{i}", "error", p) for i, p in enumerate(found)], "rule_seq int, rule_uri string, label string, priority string, pattern string")


def test_equal_to_every_rule_on_every_line(spark, small, monkeypatch):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("diff_id"), F.concat(F.lit("p"), "doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    words = [w for r in docs.limit(300).collect() for w in re.findall("[a-z]{3,9}", r.text)]
    found = [rng.choice(["{}", "{}\\b", "^{}", "(?i){}", "{}|zz", "{}[,.]", "\\w{}", "{}.*e"]).format(rng.choice(words)) for _ in range(60)] + ["[.,]$", "(?!x)y", "\\p{Lu}\\p{Lu}\\p{Lu}", "a", "é"]
    added = docs.union(spark.createDataFrame([(0, "n", 0, None), (0, "n", 1, ""), (0, "n", 2, "SECRET É é")], "diff_id long, path string, line_no int, text string"))
    rules = rules_frame(spark, found)
    want = added.join(F.broadcast(rules), F.expr("text rlike pattern"))
    key = lambda d: sorted((r.diff_id, r.line_no, r.rule_seq) for r in d.select("diff_id", "line_no", "rule_seq").collect())
    assert key(review.matches(added, rules)) == key(want)
    monkeypatch.setattr(patterns, "TOGETHER", 20)
    assert key(review.matches(added, rules)) == key(want)
    assert review.matches(added, rules.limit(0)).count() == 0 and review.matches(added.limit(0), rules).count() == 0
    assert set(review.matches(added, rules).columns) == {*added.columns, *rules.columns}


def test_five_thousand_rules_on_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("diff_id"), F.col("source").alias("path"), F.lit(1).alias("line_no"), "text")
    words = sorted({w for r in docs.select("text").limit(200).collect() for w in re.findall("[a-z]{6,}", r.text or "")})[:2500]
    rules = rules_frame(spark, [w + "\\b" for w in words] + [f"absent{i}[0-9]" for i in range(5000 - len(words))])
    began = time.time()
    got = review.matches(docs, rules)
    n = got.count()
    assert time.time() - began < 90
    held = {r.diff_id: r.text or "" for r in docs.collect()}
    some = words[::250]
    want = sum(bool(re.search(w + r"\b", t)) for w in some for t in held.values())
    assert got.where(F.col("pattern").isin([w + "\\b" for w in some])).count() == want and n >= want
