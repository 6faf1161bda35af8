"""Definition and reference graphs: edges, personalised PageRank, ranked definitions, budgets.

A graph is two DataFrames. PageRank iterates joins on tables in the shared folder; each round is
one partially aggregated sum over the edges, and a table is deleted when the next is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text
from folio.storage import discard, save

MAX_DEFINERS = 5
DAMPING = 0.85
ROUNDS = 100
TOLERANCE = 1e-6
MENTIONED, PRIVATE = 10.0, 0.1
BUDGET_SHARE = 0.85


def reference_edges(defs: DataFrame, refs: DataFrame, mentioned: list[str] | None = None) -> DataFrame:
    """(src, dst, weight): who refers to names that dst defines. defs, refs: path, ident.

    Names defined in more than five files say nothing. Of several definers the first path counts."""
    definers = defs.select("path", "ident").distinct().groupBy("ident").agg(F.count("*").alias("definers"), F.min("path").alias("dst")).where(F.col("definers") <= MAX_DEFINERS)
    users = refs.select("path", "ident").distinct()
    counted = users.groupBy("ident").agg(F.count("*").alias("users"))
    boost = F.when(F.col("ident").isin(mentioned), MENTIONED).otherwise(1.0) if mentioned else F.lit(1.0)
    weight = F.sqrt("users") * boost * F.when(F.col("ident").startswith("_"), PRIVATE).otherwise(1.0)
    weighed = counted.join(definers, "ident").select("ident", "dst", weight.alias("weight"))
    return users.join(weighed, "ident").where(F.col("path") != F.col("dst")).groupBy(F.col("path").alias("src"), "dst").agg(F.sum("weight").alias("weight"))


def seeds(nodes: DataFrame, context: list[str], defs: DataFrame, mentioned: list[str]) -> DataFrame:
    """(node): files in context that are there, and definers of mentioned names."""
    near = nodes.where(F.col("node").isin(context) if context else F.lit(False)).select("node")
    named = defs.where(F.col("ident").isin(mentioned) if mentioned else F.lit(False)).select(F.col("path").alias("node"))
    return near.union(named).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, seed: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, score). nodes: node; edges: src, dst, weight; seed: node, or none for all alike.

    The teleport term is added twice, evenly and to the seeds, so scores sum to about two."""
    spark = nodes.sparkSession
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares, shares_at = save(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "rank-shares")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    m = seed.count() if seed is not None else 0
    seeded = seed.select("node", F.lit(1.0 / m).alias("bias")) if m else nodes.select("node", F.lit(1.0 / n).alias("bias"))
    base = nodes.join(seeded, "node", "left").join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left")
    base, base_at = save(base.select("node", F.coalesce("bias", F.lit(0.0)).alias("bias"), F.coalesce("leads", F.lit(False)).alias("leads")), "rank-nodes")
    now, path = save(base.select("node", "bias", "leads", F.lit(1.0 / n).alias("score")), "rank")
    for _ in range(rounds):
        dangling = now.where("not leads").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        given = shares.join(now.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("given"))
        flat = F.lit((1 - damping) / n + damping * dangling / n)
        score = flat + F.lit(damping) * F.coalesce("given", F.lit(0.0)) + F.lit(1 - damping) * F.col("bias")
        after, after_at = save(now.select("node", "bias", "leads", F.col("score").alias("old")).join(given, "node", "left").select("node", "bias", "leads", "old", score.alias("score")), "rank")
        moved = after.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        discard(spark, path)
        now, path = after, after_at
        if moved < tolerance:
            break
    discard(spark, shares_at, base_at)
    return now.select("node", "score")


def top_definitions(defs: DataFrame, ranks: DataFrame, mentioned: list[str], k: int) -> DataFrame:
    """(path, ident, line, score): definitions by their file's rank, ten more for mentioned names."""
    bonus = F.when(F.col("ident").isin(mentioned), MENTIONED).otherwise(0.0) if mentioned else F.lit(0.0)
    scored = defs.join(ranks.select(F.col("node").alias("path"), F.col("score").alias("rank")), "path").select("path", "ident", "line", (F.col("rank") + bonus).alias("score"))
    return scored.orderBy(F.desc("score"), "path", "line", "ident").limit(k)


def within_budget(lines: DataFrame, size: Column, order: list[Column], budget_tokens: int) -> DataFrame:
    """Rows of a ranked report, from the best on, while their running size stays in the budget's share.
    The first row always stays. `lines` is a top-k report, so one task adds it up."""
    room = int(budget_tokens * BUDGET_SHARE)
    running = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.orderBy(*order))
    return lines.withColumn("running", running).withColumn("place", place).where((F.col("running") <= room) | (F.col("place") == 1))


def render_map(rows: list, budget_tokens: int) -> str:
    """The text of a repository map: the most definitions that fit, by bisection; files alphabetically."""

    def draw(n: int) -> str:
        files: dict[str, list] = {}
        for r in rows[:n]:
            files.setdefault(r["path"], []).append(r)
        return "".join(f"{p}:\n" + "".join(f"  {r['line']}: {r['ident']}\n" for r in sorted(files[p], key=lambda r: r["line"])) for p in sorted(files))

    room, low, high = int(budget_tokens * BUDGET_SHARE), 1, len(rows)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if len(draw(middle).encode()) // 4 <= room else (low, middle - 1)
    return draw(low) if rows else ""


def identifier_references(files: DataFrame) -> DataFrame:
    """(path, ident) for each distinct identifier of a file."""
    return files.select("path", F.explode(text.identifiers(F.col("content"))).alias("ident"))
