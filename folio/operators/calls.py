"""Call graphs: calls in symbol ranges, name resolution, direct and transitive callers, call trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import intervals
from folio.storage import discard, save, saved

TREE_DEPTH = 5


def calls_in_symbols(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, caller, caller_start, callee, line): each call in each symbol whose lines hold it.

    An outer symbol holds the calls of inner ones, too. Calls and symbols meet in blocks of lines."""
    s = symbols.select("path", F.col("name").alias("caller"), F.col("start_row").alias("caller_start"), F.col("end_row").alias("caller_end"))
    c = calls.select("path", F.col("name").alias("callee"), "line")
    return intervals.holding(c, s, ["path"], "line", "caller_start", "caller_end").select("path", "callee", "line", "caller", "caller_start")


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds callee_start: the first symbol of the callee's name in the file, null if there is none."""
    first = symbols.groupBy("path", F.col("name").alias("callee")).agg(F.min("start_row").alias("callee_start"))
    return edges.join(first, ["path", "callee"], "left")


def callers(edges: DataFrame, path: str, name: str, start: int) -> DataFrame:
    """Direct callers of a symbol, itself left out."""
    return edges.where((F.col("path") == path) & (F.col("callee") == name) & (F.col("caller_start") != start)).select("caller", "caller_start").distinct()


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, node, depth): all that is reached over src -> dst from start (source), at its least
    depth, the source itself left out. Each round joins the new frontier only; it ends when none is new.
    The result is a table of its own; those of the rounds are deleted."""
    spark = edges.sparkSession
    steps, steps_at = save(edges.select("src", "dst").distinct(), "reach-edges")
    seen, seen_at = save(start.select("source", F.col("source").alias("node"), F.lit(0).alias("depth")), "reach")
    frontier, level, spent = seen, 0, [seen_at, steps_at]
    while max_depth is None or level < max_depth:
        level += 1
        found = frontier.join(steps, frontier.node == steps.src).select("source", F.col("dst").alias("node")).distinct()
        fresh, fresh_at = save(found.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(level)), "reach-new")
        if fresh.isEmpty():
            discard(spark, fresh_at)
            break
        seen, frontier = seen.union(fresh), fresh
        spent.append(fresh_at)
    reached = saved(seen.where("depth > 0"), "reached")
    discard(spark, *spent)
    return reached


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(trail, node, level, is_cycle): walks from roots (node) over src -> dst; a node met again on its
    own trail is a marked leaf. Levels are few, so the walk is one plan of at most `depth` joins."""
    now = roots.select(F.array(F.col("node")).alias("trail"), "node", F.lit(0).alias("level"), F.lit(False).alias("is_cycle"))
    out = now
    for level in range(1, depth + 1):
        now = now.where("not is_cycle").join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select(F.concat("trail", F.array("dst")).alias("trail"), F.col("dst").alias("node"), F.lit(level).alias("level"), F.array_contains("trail", F.col("dst")).alias("is_cycle"))
        out = out.union(now)
    return out


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """The symbols of a name; if there is none, up to ten whose name holds it or is held by it, marked similar."""
    low = name.lower()
    near = F.lower("name").contains(low) | F.lit(low).contains(F.lower("name"))
    ranked = symbols.withColumn("similar", F.col("name") != name).where((F.col("name") == name) | near)
    best = ranked.orderBy("similar", "path", "start_row").limit(10)  # exact ones come first: with one of these, similar ones go
    exact = F.max((~F.col("similar")).cast("int")).over(Window.partitionBy())
    return best.withColumn("_exact", exact).where((F.col("_exact") == 0) | ~F.col("similar")).drop("_exact").orderBy("similar", "path", "start_row")
