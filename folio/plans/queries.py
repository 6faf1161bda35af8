"""The registered queries of the engine's own operators, over the star-schema tables.

Where an operator needs structure that the tables lack, a view gives it: see folio.sources.tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import ignore, text, vectors
from folio.operators import calls, catalog, chunking, context, decision, embedding, evaluation, graph, index, merkle, retrieval, review, validation
from folio.operators.code import conflicts, outline, structure, symbols
from folio.operators.memo import Memo
from folio.operators.postings import Postings
from folio.sources import bundle, packages
from folio.sources.tables import code_files, documents, generated_files, markdown_documents, table, version
from folio.storage import new_path, save, saved
from folio.streaming import cache
from folio.streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

QUERY = "and the erst onnd thor the"
GERMAN = "und der einheit"
FREQUENT = "the of and"
KS = [1, 5, 10]
RULES = [
    {"rule_seq": 0, "rule_uri": "book://rules/styleguide/en/words/tion", "label": "tion", "priority": "error", "pattern": "tion\\b"},
    {"rule_seq": 1, "rule_uri": "book://rules/styleguide/en/words/capital", "label": "capital", "priority": None, "pattern": "^[A-Z][a-z]+ a"},
    {"rule_seq": 2, "rule_uri": "book://rules/styleguide/en/words/ing", "label": "ing", "priority": "info", "pattern": "ing[,.]"},
    {"rule_seq": 3, "rule_uri": "book://rules/styleguide/en/words/broken", "label": "broken", "priority": "warn", "pattern": "(unclosed"},
]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))


_INDEXES = Memo()


def _lexical(spark: SparkSession, sf_dir: str) -> Postings:
    """The lexical index of `documents`, over texts and concept ids: written by a session's first query, read by
    all until the table changes."""
    made = lambda: Postings.build(documents(spark, sf_dir), new_path(spark, "lexical"), text_cols=("text", "concept_id"))
    return _INDEXES.get((spark.sparkContext.applicationId, sf_dir), version(spark, f"{sf_dir}/documents.parquet"), made)


@query
def bm25_topk(spark, sf_dir):
    return _rounded(retrieval.lexical_leg(_lexical(spark, sf_dir), QUERY, 32))


@query
def ranges_topk(spark, sf_dir):
    """Frequent terms, by ranges that can reach the result, whatever the number of postings."""
    return _rounded(retrieval.indexed_leg(_lexical(spark, sf_dir), FREQUENT, 16, direct=0))


@query
def incremental_search(spark, sf_dir):
    """An index built twice: over an older state, then over the table. The older one lacks what `labels` calls
    bad, has other texts of what it calls toxic, and concepts of `benchmark` that are gone since."""
    d = documents(spark, sf_dir).where("text IS NOT NULL")
    passages = lambda rows: rows.select(F.coalesce("book", F.lit("none")).alias("book"), "namespace", "concept_id", F.lit(0).alias("ordinal"), F.col("text").alias("passage"), F.sha2("text", 256).alias("text_hash"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic").dropDuplicates(["id"])
    older = d.join(marks, "id", "left").where("quality IS NULL OR quality <> 0").withColumn("text", F.when(F.col("toxic") == 1, F.reverse("text")).otherwise(F.col("text")))
    gone = table(spark, sf_dir, "benchmark").select(F.lit("gone").alias("book"), F.lit("memory").alias("namespace"), F.concat(F.lit("memory/b"), "item_id").alias("concept_id"), "text")
    store = index.Store(spark, new_path(spark, "store"))
    store.build(passages(older).unionByName(passages(gone)), "lexical", 0)
    store.build(passages(d), "lexical", 0)
    return _rounded(retrieval.indexed_leg(store.lexical(), QUERY, 32))


@query
def knn_l2_topk(spark, sf_dir):
    return _rounded(retrieval.vector_leg(_units(spark, sf_dir), _vector(spark, sf_dir), 32))


@query
def hybrid_rrf(spark, sf_dir):
    return _rounded(retrieval.search(_lexical(spark, sf_dir), _units(spark, sf_dir), QUERY, _vector(spark, sf_dir), 8))


@query
def filtered_search(spark, sf_dir):
    wanted = retrieval.Filter(books=["src0", "src1", "src2", "src3"], language="de")
    index = _lexical(spark, sf_dir)
    wanted.check_books(index.docs)
    return _rounded(retrieval.lexical_leg(index, GERMAN, 10, wanted))


@query
def empty_filter_list(spark, sf_dir):
    return _rounded(retrieval.lexical_leg(_lexical(spark, sf_dir), QUERY, 10, retrieval.Filter(books=[])))


@query
def tag_overlap_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(retrieval.Filter(tags=["fr", "t3"]).condition()).select("id", "book")


@query
def rules_dedup_best_passage(spark, sf_dir):
    index_ = _lexical(spark, sf_dir)
    hits = retrieval.lexical_leg(index_, QUERY, retrieval.depth(16)).join(index_.docs.select("id", "book"), "id")
    return _rounded(retrieval.first_of_each(hits, "book", 8))


@query
def unique_concept_ranks(spark, sf_dir):
    index_ = _lexical(spark, sf_dir)
    hits = retrieval.lexical_leg(index_, QUERY, 200).join(index_.docs.select("id", F.concat("book", F.lit("/"), "language").alias("uri")), "id")
    return retrieval.first_of_each(hits, "uri", 200).select("uri", (F.col("place") + 1).alias("rank"))


def _ranking(spark, sf_dir):
    """(query, uri, rank): a written table, as more than one join asks it."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    ranking = retrieval.lexical_legs(_lexical(spark, sf_dir), items, retrieval.depth(max(KS)))
    return saved(ranking.select(F.col("query_id").alias("query"), F.col("id").alias("uri"), "rank"), "evaluation-ranking")


def _totals(spark, sf_dir):
    docs, items = documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    expected = evaluation.containing(docs.select(F.col("id").alias("uri"), F.col("text").alias("body")), items)
    return evaluation.summary(evaluation.score_queries(expected, _ranking(spark, sf_dir), KS), KS)


@query
def eval_recall_mrr(spark, sf_dir):
    totals = _totals(spark, sf_dir)
    return totals.select("queries", *(F.round(c, 6).alias(c) for c in totals.columns[1:]))


@query
def eval_threshold_checks(spark, sf_dir):
    return evaluation.checks(_totals(spark, sf_dir), evaluation.parse_floors(["recall_5=0.95", "mrr=0.5"])).withColumn("observed", F.round("observed", 6))


@query
def eval_label_hygiene(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("uri"))
    return evaluation.unknown_labels(labels, documents(spark, sf_dir).select(F.col("id").alias("uri")))


@query
def eval_absent_window(spark, sf_dir):
    ranking = _ranking(spark, sf_dir)
    absent = ranking.where("rank IN (2, 7)").select("query", "uri")
    return evaluation.absent_violations(absent, ranking, 5)


@query
def chunk_passages(spark, sf_dir):
    return chunking.passages(markdown_documents(spark, sf_dir))


@query
def chunk_coverage_invariant(spark, sf_dir):
    bodies = markdown_documents(spark, sf_dir)
    lines = bodies.select("id", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    cut = chunking.passages(bodies).select("id", "ordinal", "start_line", "end_line")
    met = lines.join(cut, "id").where(F.col("pos").between(F.col("start_line") - 1, F.col("end_line") - 1))
    return met.groupBy("id").agg(F.count("*").alias("covered"), F.countDistinct("pos").alias("lines"))


@query
def token_estimates(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("id", text.estimate_tokens(t).alias("tokens"), text.dense_script_tokens(t).alias("dense"), text.byte_tokens(t).alias("quarter_bytes"))


@query
def invisible_strip(spark, sf_dir):
    marked = F.when(F.col("id") % 7 == 0, F.concat(F.left("text", F.lit(10)), F.lit("​­"), F.substr("text", F.lit(11)))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("id", text.invisible_count(marked).alias("n"), F.md5(F.encode(text.strip_invisible(marked), "UTF-8")).alias("stripped"))


@query
def concept_hash(spark, sf_dir):
    rows = documents(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("ordinal", "passage"))
    return index.concept_hashes(rows, key=["id"])


def _snapshots(spark, sf_dir):
    d = documents(spark, sf_dir).select("id", "text")
    stored = d.where("id % 10 <> 0").select("id", F.md5(F.encode(F.when(F.col("id") % 10 == 1, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")), "UTF-8")).alias("text_hash"))
    return stored, d.where("id % 10 <> 2").select("id", F.md5(F.encode("text", "UTF-8")).alias("text_hash"))


@query
def staleness_diff(spark, sf_dir):
    return index.staleness(*_snapshots(spark, sf_dir), key=["id"])


@query
def reconcile_apply(spark, sf_dir):
    stored, current = _snapshots(spark, sf_dir)
    return index.reconcile(stored.withColumn("origin", F.lit("stored")), current.withColumn("origin", F.lit("current")), key=["id"])


@query
def index_status_rollup(spark, sf_dir):
    return catalog.status(documents(spark, sf_dir))


@query
def namespace_counts_pivot(spark, sf_dir):
    return catalog.namespace_counts(documents(spark, sf_dir))


@query
def duplicate_ids(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.md5(F.encode("text", "UTF-8")).alias("concept_id"), F.col("book").alias("root"), "book")
    return catalog.duplicates(d).select("concept_id", "roots", F.array_join("books", ",").alias("books"))


@query
def trust_effective_tier(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    claim = F.when(F.col("quality") == 1, "human-reviewed").when(F.col("quality") == 0, " machine-confirmed ")
    rows = documents(spark, sf_dir).join(labels, "id", "left").select("id", "book", (F.col("book") == "src0").alias("is_local"), claim.alias("claim"))
    number = F.substring("book", 4, 9).cast("int")
    caps = rows.select("book").distinct().where(number % 3 < 2).select("book", F.when(number % 3 == 0, "human-reviewed").otherwise("machine-confirmed").alias("cap"))
    return context.effective_trust(rows, caps).select("id", "trust")


@query
def skill_shadowing(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_type").alias("name"))
    return context.shadowed(parts, "name", "p_brand", "p_partkey").select("p_partkey", "name", "is_shadowed")


def _trees(spark, sf_dir):
    d = documents(spark, sf_dir).select("id", F.concat("namespace", F.lit("/d"), "id").alias("path"), "text")
    return d.where("id % 11 <> 0").select("path", F.sha2("text", 256).alias("hash")), d.where("id % 13 <> 0").select("path", F.sha2(F.when(F.col("id") % 17 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("hash"))


@query
def tree_change_counts(spark, sf_dir):
    return catalog.change_counts(catalog.tree_changes(*_trees(spark, sf_dir)))


@query
def integrity_mismatch(spark, sf_dir):
    return catalog.integrity_problems(*_trees(spark, sf_dir))


def _file_snapshots(spark, sf_dir):
    """Documents as files by language, source and group of numbers, and as they are later: some groups edited, removed or copied."""
    d, group = table(spark, sf_dir, "documents"), F.floor(F.col("doc_id") / 64)
    folder = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.concat(F.lit("g"), group.cast("string")))
    path, name = F.concat(folder, F.lit("/d"), F.col("doc_id").cast("string")), F.concat(F.lit("/d"), F.col("doc_id").cast("string"))
    edited = F.when((group % 5 == 0) & (F.col("doc_id") % 3 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    later = d.where(group % 7 != 3).select(path.alias("path"), F.sha2(edited, 256).alias("hash"))
    copies = d.where(group % 11 == 5).select(F.concat(F.lit("new/"), F.coalesce("lang", F.lit("none")), name).alias("path"), F.sha2("text", 256).alias("hash"))
    return d.select(path.alias("path"), F.sha2("text", 256).alias("hash")), later.union(copies)


@query
def merkle_changes(spark, sf_dir):
    """Changed files of two snapshots; files of folders with equal digests aren't joined."""
    return merkle.changes(*_file_snapshots(spark, sf_dir))


@query
def merkle_folders(spark, sf_dir):
    before, after = _file_snapshots(spark, sf_dir)
    return merkle.compare(merkle.folders(before), merkle.folders(after))


@query
def update_files(spark, sf_dir):
    """Files that an update of each book (source) would add, change and remove."""
    trees = [tree.select(F.split_part("path", F.lit("/"), F.lit(2)).alias("name"), "path", "hash") for tree in _file_snapshots(spark, sf_dir)]
    books = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("name")).distinct()
    return catalog.update_counts(books, *trees)


@query
def bundle_hash(spark, sf_dir):
    d = documents(spark, sf_dir).select("book", F.col("concept_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return catalog.bundle_hash(d, "document/d4")


@query
def update_plan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    pins = s.select(F.col("s_name").alias("name"), F.sha2(F.col("s_suppkey").cast("string"), 256).alias("commit"))
    remote = s.where("s_suppkey % 7 <> 0").select(F.col("s_name").alias("name"), F.sha2((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)).cast("string"), 256).alias("commit"))
    return catalog.update_plan(pins, remote)


@query
def stamp_matrix(spark, sf_dir):
    k = F.col("s_suppkey")
    stamp = F.when(k % 3 == 0, "none").when(k % 3 == 1, F.concat(F.lit("h"), (k % 4).cast("string")))
    sidecar = F.when(k % 2 == 0, F.concat(F.lit("h"), (k % 8 % 4).cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", catalog.stamp_state(stamp, sidecar, k % 5 != 0).alias("state"))


@query
def sync_status(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    pins = s.select(F.col("s_name").alias("name"), (k % 4).cast("string").alias("commit"))
    checkouts = s.where(k % 5 != 0).select(F.col("s_name").alias("name"), (k % 8).cast("string").alias("head"), (k % 6 != 0).alias("intact"), F.when(k % 7 == 0, "no network").alias("error"))
    return catalog.sync_states(pins, checkouts).groupBy("state").agg(F.count("*").alias("n"))


def _contracted(spark, sf_dir):
    k = F.col("id")
    own = F.when(F.col("namespace") == "styleguide", F.when(k % 5 == 0, "Note").otherwise("Rule")).when(F.col("namespace") == "skill", "Skill").otherwise("Note")
    return documents(spark, sf_dir).select(
        "concept_id", "namespace", F.when(k % 6 == 0, " ").when(k % 9 != 0, own).alias("type"), F.when(k % 7 != 0, F.left("text", F.lit(20))).alias("description"), F.when(k % 8 == 1, "").otherwise(F.col("text")).alias("body"),
        F.when(k % 3 != 0, F.col("language")).alias("language"), F.lit("prose").alias("category"), F.when(k % 4 == 2, F.when(k % 5 == 1, "critical").otherwise("warn")).alias("priority"), F.when(k % 10 == 2, "(x").alias("pattern"), F.lit(False).alias("pattern_ok"),
    )


@query
def validation_findings(spark, sf_dir):
    return validation.violations(_contracted(spark, sf_dir), validation.concept_contracts())


@query
def validation_verdict(spark, sf_dir):
    return validation.verdict(validation_findings(spark, sf_dir))


@query
def uri_parse(spark, sf_dir):
    base = text.uri("book", F.col("book"), F.col("concept_id"))
    k = F.col("id") % 9
    odd = F.when(k == 1, F.concat(base, F.lit(".md"))).when(k == 2, F.concat(base, F.lit("/../x"))).when(k == 3, F.concat(F.lit("http"), F.substr(base, F.lit(5)))).when(k == 4, F.concat(F.lit("book://"), "book", F.lit("/custom/x"))).when(k == 5, F.concat(base, F.lit(" x"))).otherwise(base)
    rows = documents(spark, sf_dir).select("id", odd.alias("uri")).withColumn("p", text.parse_uri(F.col("uri"), "book"))
    return rows.select("id", F.col("p.book").alias("book"), F.col("p.namespace").alias("namespace"), text.last_segment(F.col("p.id")).alias("name"))


@query
def heading_lines(spark, sf_dir):
    lines = markdown_documents(spark, sf_dir).select("id", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    found = lines.withColumn("level", text.heading_level(F.col("line"))).where("level > 0")
    return found.select("id", "pos", "level", text.heading_text(F.col("line")).alias("title"))


@query
def identifier_extract(spark, sf_dir):
    found = documents(spark, sf_dir).select("id", text.identifiers(F.col("text")).alias("found"))
    return found.select("id", F.md5(F.encode(F.array_join("found", ","), "UTF-8")).alias("names_md5"), F.size("found").cast("long").alias("names"))


@query
def html_outline(spark, sf_dir):
    shape = "(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    pages = table(spark, sf_dir, "pages")
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(shape), 1).alias("level"), F.regexp_extract_all("html", F.lit(shape), 2).alias("title"))
    return pages.select("page_id", F.posexplode(pairs).alias("pos", "h")).select("page_id", "pos", F.col("h")["level"].cast("int").alias("level"), F.trim(F.col("h")["title"]).alias("title"))


@query
def zoom_lines(spark, sf_dir):
    return review.gutter_lines(documents(spark, sf_dir).select(F.col("id").alias("path"), F.col("text").alias("content")), 2, 4)


def _names(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda c: li.where(c).select(F.col("l_suppkey").alias("path"), F.col("l_partkey").cast("string").alias("ident"), F.col("l_linenumber").alias("line"))
    return side("l_linenumber = 1"), side("l_linenumber <> 1").select("path", "ident")


def _graph(spark, sf_dir):
    defs, refs = _names(spark, sf_dir)
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return nodes, graph.reference_edges(defs, refs, ["7", "42"]), graph.seeds(nodes, [], defs, ["7", "42"]).join(nodes, "node", "left_semi")


@query
def def_ref_edges(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return edges.select("src", "dst", F.round("weight", 6).alias("weight"))


@query
def pagerank(spark, sf_dir):
    return graph.pagerank(*_graph(spark, sf_dir), rounds=8, tolerance=0.0).select("node", F.round("score", 6).alias("score"))


def _top(spark, sf_dir):
    defs = _names(spark, sf_dir)[0].distinct()
    ranks = graph.pagerank(*_graph(spark, sf_dir), rounds=8, tolerance=0.0).select("node", F.round("score", 6).alias("score"))
    return graph.top_definitions(defs, ranks, ["7", "42"], 100)


@query
def top_defs(spark, sf_dir):
    return _rounded(_top(spark, sf_dir))


@query
def repomap_budget(spark, sf_dir):
    order = [F.desc("score"), F.col("path"), F.col("line"), F.col("ident")]
    size = F.length("ident") + F.lit(4)
    return _rounded(graph.within_budget(_top(spark, sf_dir), size, order, 200)).select("path", "ident", "score", "running", "place")


def _call_tables(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    row = lambda c, *more: e.where(c).select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), *more)
    return row("event_id % 3 <> 0", F.col("event_id").alias("line")), row("event_id % 3 = 0", F.col("event_id").alias("start_row"), (F.col("event_id") + 400).alias("end_row"))


@query
def call_edges_range_join(spark, sf_dir):
    made, symbols_ = _call_tables(spark, sf_dir)
    return calls.resolve(calls.calls_in_symbols(made, symbols_), symbols_)


def _hops(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("src"), ((k * 3 + F.col("n_regionkey")) % 25).alias("dst")).union(n.where(k % 4 == 1).select(k, (k + 5) % 25))


@query
def impact_closure(spark, sf_dir):
    start = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("source"))
    return calls.reachable(_hops(spark, sf_dir), start)


@query
def call_tree_depth(spark, sf_dir):
    roots = table(spark, sf_dir, "nation").where("n_nationkey IN (1, 2)").select(F.col("n_nationkey").alias("node"))
    return calls.call_tree(_hops(spark, sf_dir), roots).select(F.array_join(F.col("trail").cast("array<string>"), ">").alias("trail"), "node", "level", "is_cycle")


def _diffs(spark, sf_dir):
    k, lines = F.col("id"), F.split("text", "\n")
    line = lambda n: F.coalesce(F.get(lines, F.lit(n)), F.lit("none"))
    name = F.concat(F.lit("docs/"), k.cast("string"), F.lit(".md"))
    parts = [F.lit("diff --git a/old.md b/"), name, F.lit("\n--- a/old.md\n+++ b/"), name, F.lit("\n@@ -2,4 +"), (k % 9 + 1).cast("string"), F.lit(",4 @@ head\n context\n+"), line(0), F.lit("\n-gone\n+"), line(1), F.lit("\n rest\n@@ -40 +"), (k % 9 + 40).cast("string"), F.lit(" @@\n-x\n+"), line(2), F.lit("\n\\ No newline at end of file")]
    return documents(spark, sf_dir).select(k.alias("diff_id"), F.concat(*parts).alias("diff"))


@query
def diff_added_lines(spark, sf_dir):
    return review.added_lines(review.parse_diff(review.diff_lines(_diffs(spark, sf_dir))))


@query
def diff_hunk_ranges(spark, sf_dir):
    return review.hunk_ranges(review.parse_diff(review.diff_lines(_diffs(spark, sf_dir))))


def _findings(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("id").alias("diff_id"), F.concat("book", F.lit("/"), "id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    added = d.select("diff_id", "path", (F.col("pos") + 1).alias("line_no"), "text")
    good, _ = review.usable_rules(spark, RULES)
    rules = spark.createDataFrame([tuple(r.values()) for r in good], "rule_seq int, rule_uri string, label string, priority string, pattern string")
    return review.prepass(added, rules)


@query
def prepass_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("diff_id", "rule_seq", "path", "line_start", "line_end", "priority", "title", "truncated")


@query
def finding_grounding(spark, sf_dir):
    path = F.concat("book", F.lit("/"), "id")
    d = documents(spark, sf_dir)
    ranges = d.where("id % 2 = 0").select(path.alias("path"), F.lit(1).alias("start"), F.lit(2).alias("end")).union(d.where("id % 3 = 0").select(path, F.lit(3), F.lit(9)))
    return review.grounded(_findings(spark, sf_dir), ranges).select("path", "rule_seq", "line_start", "line_end")


def _identified(spark, sf_dir):
    bits = F.lit(review.float_bits(1.0))
    name = review.finding_id(F.lit("review"), F.col("origin"), F.col("title"), F.lit("body"), F.col("priority"), F.col("path"), F.col("line_start"), F.col("line_end"), bits, F.col("rule_uris"))
    return _findings(spark, sf_dir).withColumn("finding_id", name)


@query
def finding_ids(spark, sf_dir):
    return review.recorded(_identified(spark, sf_dir)).select("finding_id", "path", "line_start")


@query
def findings_filter_export(spark, sf_dir):
    found = review.filtered(_identified(spark, sf_dir), "P1", "SRC1")
    return found.select("finding_id", "title", review.sarif_level(F.col("priority")).alias("level"), review.rdjson_severity(F.col("priority")).alias("severity"))


@query
def findings_rdjsonl(spark, sf_dir):
    return review.rdjsonl(_identified(spark, sf_dir))


@query
def todo_scan(spark, sf_dir):
    k = F.col("id")
    mark = F.when(k % 5 == 0, "// TODO: fix ").when(k % 5 == 1, "  FIXME(x) ").when(k % 5 == 2, "# XXX ").when(k % 5 == 3, "not a TODO ").otherwise("-- HACK:")
    body = F.concat(F.lit("first\n"), mark, F.when(k % 7 == 0, "").otherwise(k.cast("string")), F.lit("\nlast"))
    return review.todo_items(documents(spark, sf_dir).select(k.alias("path"), body.alias("content")))


def _conflicted(spark, sf_dir):
    head = F.left(F.regexp_replace("text", "\n", " "), F.lit(30))
    block = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<<<<<<< ours\n"), head, F.lit("\nsecond\n||||||| base\nold\n=======\ntheirs\n>>>>>>> branch\n"))).when(F.col("id") % 3 == 1, F.concat(F.lit("<<<<<<< a\r\n"), head, F.lit("\r\n=======\r\n>>>>>>> b\r\n"))).otherwise(F.lit("<<<<<<< open\nx\n=======\n"))
    return documents(spark, sf_dir).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("top\n"), block, F.lit("end\n")).alias("content"))


@query
def conflict_list(spark, sf_dir):
    return conflicts.list_conflicts(_conflicted(spark, sf_dir))


@query
def conflict_resolve(spark, sf_dir):
    return conflicts.resolve_files(_conflicted(spark, sf_dir), "ours")


@query
def provenance_decorate(spark, sf_dir):
    d = documents(spark, sf_dir)
    books = d.select("book").distinct().select("book", (F.col("book") == "src0").alias("is_local"), F.md5(F.encode("book", "UTF-8")).alias("source_commit"))
    shown = context.with_provenance(d.select("id", "book", F.col("text").alias("passage")), books)
    return shown.select("id", "origin", "source_commit", F.md5(F.encode("shown", "UTF-8")).alias("shown"))


@query
def default_scope(spark, sf_dir):
    return documents(spark, sf_dir).where(context.in_default_scope(F.col("namespace"), F.col("book") == "src0")).select("id", "namespace")


@query
def json_facets(spark, sf_dir):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_total"), F.count_if(k.isNull()).alias("k_missing"))


@query
def budget_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("state"))
    return decision.fit_column(rows, "state", 64).drop("fit_error")


@query
def advisory_rerank(spark, sf_dir):
    hits = retrieval.first_of_each(retrieval.lexical_leg(_lexical(spark, sf_dir), QUERY, 20).withColumn("key", F.col("id")), "key", 20).select("id", "place")
    p = hits.where("place % 3 <> 1").select("id", (F.col("id") % 7 / F.lit(7.0)).alias("p"))
    return decision.reranked(hits, p).select("id", "place", "at", F.round("p", 6).alias("p"))


@query
def session_ttl(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))


@query
def cache_hits(spark, sf_dir):
    """A stream over the table's events, in a folder of its own: each user's cache of three event types, idle for an hour at most."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    (source, at), out = save(rows, "cache-events"), new_path(spark, "cache-hits")
    stream = spark.readStream.schema(source.schema).parquet(at)
    cache.accesses(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string, hit boolean").parquet(out)


@query
def event_windows(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query
def hashed_text_vectors(spark, sf_dir):
    rows = embedding.Hashed(32).embed(table(spark, sf_dir, "benchmark"), "text", "v")
    return rows.select("item_id", F.posexplode("v").alias("slot", "x")).select("item_id", "slot", F.round("x", 6).alias("x"))


@query
def mean_pooled_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(*(F.avg(F.col("embedding")[i].cast("double")).alias(f"c{i}") for i in range(64)))
    return e.select("label", F.round(vectors.normalised(F.array(*(F.col(f"c{i}") for i in range(64))))[0], 6).alias("first"))


@query
def code_symbols(spark, sf_dir):
    return symbols.extract_symbols(code_files(spark, sf_dir))


def _generated(spark, sf_dir, kinds):
    found = symbols.extract_symbols(generated_files(spark, sf_dir, kinds).select("path", "content"))
    return found.select(F.regexp_extract("path", r"gen/d(-?\d+)", 1).cast("long").alias("id"), "name", "kind", "start_row", "end_row", "scope")


@query
def code_lexed(spark, sf_dir):
    """Symbols of files whose comments and strings hold the other language's words and braces."""
    return _generated(spark, sf_dir, ["go", "rb", "ts", "gd"])


@query
def key_scopes(spark, sf_dir):
    """Nested keys of YAML and TOML files."""
    return _generated(spark, sf_dir, ["yaml", "toml"])


@query
def code_calls(spark, sf_dir):
    files = code_files(spark, sf_dir)
    found = saved(symbols.extract_symbols(files), "code-symbols")
    return calls.resolve(calls.calls_in_symbols(symbols.extract_calls(files), found), found)


@query
def code_outline(spark, sf_dir):
    found = saved(symbols.extract_symbols(code_files(spark, sf_dir)), "code-symbols")
    return outline.containment(found).select("path", "name", "kind", "start_row", "parent", "parent_start")


@query
def code_zoom(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return outline.zoom(files, symbols.extract_symbols(files.where("path = 'src/d3.py'")), "src/d3.py", "read3")


@query
def code_zooms(spark, sf_dir):
    """Every symbol of generated Go and Ruby files with the lines around it."""
    files = generated_files(spark, sf_dir, ["go", "rb"]).select("path", "content")
    found = outline.zooms(files, symbols.extract_symbols(files))
    return found.select(_document_id(), "name", "first_line", "last_line", F.md5(F.encode("lines", "UTF-8")).alias("lines_md5"))


@query
def repo_map_edges(spark, sf_dir):
    files = code_files(spark, sf_dir).where("path LIKE 'src/%'")
    edges = graph.reference_edges(symbols.extract_definitions(files).select("path", "ident"), symbols.extract_references(files))
    return edges.select("src", "dst", F.round("weight", 6).alias("weight"))


@query
def ast_search(spark, sf_dir):
    return structure.search_files(code_files(spark, sf_dir), "$F(path, $$$REST)")


@query
def ast_rewrite(spark, sf_dir):
    found = structure.rewrite_files(code_files(spark, sf_dir), "write($X, $Y)", "store($Y, $X, retry=True)")
    return found.select("path", "changed", F.md5(F.encode("diff", "UTF-8")).alias("diff_md5"), "error_introduced")


def _document_id():
    return F.regexp_extract("path", r"gen/d(-?\d+)", 1).cast("long").alias("id")


@query
def structure_search(spark, sf_dir):
    """Patterns of three languages over files whose comments and strings hold what the patterns ask for."""
    files = generated_files(spark, sf_dir, ["rs", "tsx", "go"]).select("path", "content")
    asked = [("store($X, $$$REST)", "rust"), ("$A == $B", "typescript"), ("$N := $V", "go")]
    found = structure.search_each(files, asked)
    return found.select(_document_id(), "line_start", "line_end", "matched", text.match_preview(F.col("matched")).alias("preview"))


@query
def structure_rewrite(spark, sf_dir):
    """Arguments of a call swapped in TypeScript files, the others as they are."""
    files = generated_files(spark, sf_dir, ["tsx", "rs"]).select("path", "content")
    found = structure.rewritten_files(files, "log($A, $B)", "trace($B, [$A])", "typescript")
    return found.select(_document_id(), "changed", "error_introduced", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


#: Rule files of a tree of pages: by path, their lines.
IGNORE = [(".gitignore", "# pages\n*.html\n!/com/**/1*.html\n/net/*/es/\nblog.*\n!blog.t*\nspam-*/\n"), ("org/.gitignore", "/thther.example.org/en\n!*.html\n")]


@query
def ignore_rules(spark, sf_dir):
    """Pages as files of a tree (domain, host, path), judged by rule files at the top and in a folder."""
    host, rest = F.regexp_extract("url", r"://([^/?#]+)", 1), F.regexp_extract("url", r"://[^/?#]+([^?#]*)", 1)
    path = F.rtrim(F.concat(F.element_at(F.split(host, r"\."), -1), F.lit("/"), host, rest), F.lit("/"))
    return ignore.with_ignored(table(spark, sf_dir, "pages").select("page_id", path.alias("path")), ignore.rules_of(IGNORE))


@query
def yaml_import(spark, sf_dir):
    k = F.col("id").cast("string")
    head = F.concat(F.lit("metadata: {language: "), F.coalesce("language", F.lit("~")), F.lit(", category: prose, priority: warning}\nrules:\n"))
    first = F.concat(F.lit("  - id: rule-"), k, F.lit("\n    description: Words of "), "book", F.lit('\n    pattern: ["a'), k, F.lit('", "b"]\n    examples: {good: x, bad: y}\n'))
    second = F.concat(F.lit("  - id: own\n    category: own\n    priority: "), F.when(F.col("id") % 2 == 0, "error").otherwise("info"), F.lit("\n    good: g"), k, F.lit("\n"))
    broken = F.when(F.col("id") % 10 == 3, F.lit("  - description: no id\n")).otherwise("")
    files = documents(spark, sf_dir).select(F.concat(F.lit("rules/"), k, F.lit(".yaml")).alias("path"), F.concat(head, first, second, broken).alias("content"))
    there = documents(spark, sf_dir).where("id % 7 = 0").select(F.concat(F.lit("styleguide/"), F.coalesce("language", F.lit("any")), F.lit("/prose/rule-"), "id").alias("concept_id"))
    found = packages.import_rule_files(files, there)
    return found.select("path", "concept_id", "description", "category", "priority", "pattern", "good", "bad", F.col("error").isNotNull().alias("failed"))


@query
def frontmatter_parse(spark, sf_dir):
    k = F.col("id")
    front = F.concat(F.lit("---\ntype: Note\nlanguage: "), "language", F.lit("\ntags: ["), "book", F.lit(", x]\n"), F.when(k % 6 == 0, "").otherwise("---\n"), F.lit("body "), k.cast("string"))
    parsed = bundle.with_facets(bundle.parse_concepts(documents(spark, sf_dir).select("id", front.alias("content"))))
    return parsed.select("id", "type", F.col("language"), F.array_join("tags", ",").alias("tags"), "body", F.col("parse_error").isNotNull().alias("failed"))
