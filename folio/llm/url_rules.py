"""URL filtering by association rules, in DataFrame operations only.

Spark's FP-growth mines sets of URL tokens that go with a bad label. Tokens that stand in the very same
labelled rows, as all segments of a path that is repeated do, are one item, named by the first of them: sets
of them don't differ in support or confidence, and there are 2^n of these. In a rule each item stands for any
of its tokens (``members``), so a URL with one of them fits as it would by the rule of that token alone.

Rules "tokens => bad" are pruned by support (a share of the labelled rows, and a number of them at least)
and confidence, and by the rules they contain: a rule is redundant when some of its items make a rule of
no less confidence. The best confidence within a set is handed up from the sets that lack one item. The rest
match through an inverted index: each rule stands at the tokens of its rarest item, a URL's tokens look up
the index, and a found rule fits if the URL has all its items. URLs are matched once each, however many
rows share them.

Given host and path rules come first: a rule fits its host and all subdomains if the path starts
with the rule's path, and the longest wins (host and path together; then the longer host).

Edge cases: a null url, or one without `://`, has an empty host and path and no tokens, so no rule
fits and it is allowed. Hosts are lower-cased in A-Z only. Rows repeat as given. Without labelled
rows, or without bad ones, no rules are mined and all is allowed. All columns of the pages are kept;
like-named result columns are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.exact_dedup import normalised
from folio.storage import discard, save, saved

MIN_SUPPORT = 0.002
#: Bad labelled rows that a rule needs at least, however few rows are labelled.
MIN_ROWS = 5
MIN_CONFIDENCE = 0.5
#: The class item: tokens start with their kind, so none equals it.
BAD = "=bad"
#: Rules up to which the index is broadcast; beyond it it is joined by shuffle.
BROADCAST_RULES = 20_000

#: The given rules: (verdict, host, path). (Fixed values.)
GIVEN = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return normalised(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def given_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host, its labels, path segments with a letter, query keys, fragment."""
    url = F.coalesce(url, F.lit(""))
    named = lambda name, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{name}="), x))
    h, p = host(url), path(url)
    scheme = F.when(F.instr(url, "://") > 0, F.lower(F.substring_index(url, "://", 1))).otherwise(F.lit(""))
    segments = F.filter(F.split(p, "/"), lambda x: x.rlike("[A-Za-z]"))
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named("scheme", F.array(scheme)), named("host", F.array(h)), named("label", F.split(h, r"\.")), named("segment", segments), named("key", keys), mark))


def items(rows: DataFrame, least: float) -> DataFrame:
    """(token, item, members) of tokens that at least so many bad rows have; rows: row (unique), tokens, bad.

    Sets of rows are told apart by their size and 128 bits of hash. There are few such tokens: a row's
    number of tokens over the least share at most."""
    held = rows.select("row", "bad", F.explode("tokens").alias("token"))
    marks = held.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    grouped = marks.where(F.col("bad") >= least).groupBy("n", "x", "y").agg(F.array_sort(F.collect_set("token")).alias("members"))
    return grouped.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"), "members")


def _unbeaten(sets: DataFrame, min_confidence: float, min_support: float) -> DataFrame:
    """Sets (tokens, confidence, support) of enough confidence within which no smaller one has as much."""
    largest = sets.agg(F.max(F.size("tokens"))).first()[0] or 0
    out, best = [], None
    for k in range(1, largest + 1):
        own = sets.where(F.size("tokens") == k)
        if best is None:
            own = own.withColumn("within", F.lit(0.0))
        else:
            smaller = own.select("tokens", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("smaller"))
            most = smaller.join(best, F.col("smaller") == F.col("of")).groupBy("tokens").agg(F.max("best").alias("within"))
            own = own.join(most, "tokens", "left").withColumn("within", F.coalesce("within", F.lit(0.0)))
        own = saved(own, "url-level")
        out.append(own.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("within")) & (F.col("support") >= min_support)).drop("within"))
        best = own.select(F.col("tokens").alias("of"), F.greatest("confidence", "within").alias("best"))
    return reduce(DataFrame.unionByName, out) if out else sets.where(F.lit(False))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Rules (tokens, members, anchor, support, confidence) from all labelled rows; anchor: the rule's rarest
    item; members: the tokens of each item, that of tokens first."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    known = labelled.where(F.col(bad_col).isNotNull()).select(tokens(F.col(url_col)).alias("tokens"), F.col(bad_col).alias("bad"))
    rows, rows_at = save(known.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    n = rows.count()
    support = max(min_support, min(1.0, (min_rows - 0.5) / max(n, 1)))  # the half: FP-growth rounds up
    named, named_at = save(items(rows, max(support * n, min_rows - 0.5)), "url-items")
    few = F.broadcast(named) if named.count() <= broadcast_rules else named
    sets = rows.select("row", F.explode("tokens").alias("token")).join(few, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    label = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = rows.select("row", "bad").join(sets, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(baskets)
    found, found_at = save(model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-sets")
    rules, rules_at = save(_unbeaten(found, min_confidence, (min_rows - 0.5) / max(n, 1)), "url-rules")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    each = rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token").join(few.where("token = item"), "token")
    anchors = each.groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"), F.array_sort(F.collect_list("members")).alias("members"))
    out = saved(rules.join(anchors, "tokens").select("tokens", "members", "anchor", "support", "confidence"), "url-index")
    discard(spark, rows_at, named_at, found_at, rules_at)
    return out


def matched_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Distinct urls that a rule fits."""
    index = rules.select(F.explode(F.element_at(F.filter("members", lambda m: m[0] == F.col("anchor")), 1)).alias("token"), F.col("members").alias("wanted"))
    index = F.broadcast(index) if index.count() <= broadcast_rules else index
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumn("have", tokens(F.col("url")))
    looked = urls.select("url", "have", F.explode("have").alias("token")).join(index, "token")
    return looked.where(F.forall("wanted", lambda m: F.arrays_overlap(m, F.col("have")))).select("url").distinct()


def judge(pages: DataFrame, mined: DataFrame, given: list[tuple[str, str, str]] = GIVEN, url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """The columns of pages with host, path, rule and verdict."""
    own = pages.drop("host", "path", "rule", "verdict")
    bad = matched_urls(pages, mined, url_col, broadcast_rules).select(F.col("url").alias("_bad_url"))
    found = own.join(bad, own[url_col] == bad["_bad_url"], "left")
    found = found.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    found = found.withColumn("_given", given_rule(F.col("host"), F.col("path"), given))
    method = F.when(F.col("_bad_url").isNotNull(), "block").otherwise("allow")
    return found.withColumn("rule", F.col("_given.rule")).withColumn("verdict", F.coalesce(F.col("_given.verdict"), method)).drop("_given", "_bad_url")
