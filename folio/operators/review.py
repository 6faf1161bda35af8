"""Review of changes: diffs, the pattern pre-pass, findings and their export."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import intervals, patterns

RUNS_PER_RULE_AND_FILE = 10
FINDINGS = 200
QUOTED = 200
MAX_DIFF_BYTES = 2 * 1024 * 1024
_HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def diff_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff") -> DataFrame:
    """(id, seq, line) of unified diffs."""
    return diffs.select(F.col(id_col).alias("diff_id"), F.posexplode(F.split(text_col, "\n")).alias("seq", "line"))


def parse_diff(lines: DataFrame) -> DataFrame:
    """Adds path, hunk (its number), new_start, new_count and new_line to each line (diff_id, seq, line).

    A file's path is what follows the last ` b/` of its header. A line's number in the new file counts
    context and added lines from the hunk's start on. Lines of a diff stand together: a diff is bounded."""
    by = Window.partitionBy("diff_id").orderBy("seq")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("line").startswith("diff --git ")
    path = F.when(header, F.regexp_extract("line", r"^diff --git .* b/(.*)$", 1))
    hunk = F.col("line").rlike(_HUNK)
    with_path = lines.withColumn("path", F.last(path, True).over(upto)).withColumn("_file", F.count_if(header).over(upto)).withColumn("hunk", F.count_if(hunk).over(upto))
    # a hunk ends where the next file begins
    with_path = with_path.withColumn("_of", F.last(F.when(hunk, F.col("_file")), True).over(upto))
    inside = F.col("_of") == F.col("_file")
    start = F.last(F.when(hunk, F.regexp_extract("line", _HUNK, 1).cast("int")), True).over(upto)
    given = F.regexp_extract("line", _HUNK, 2)
    count = F.last(F.when(hunk, F.when(given == "", 1).otherwise(given.cast("int"))), True).over(upto)
    placed = with_path.withColumn("new_start", F.when(inside, start)).withColumn("new_count", F.when(inside, count))
    new = inside & ~hunk & (F.col("line").startswith("+") | F.col("line").startswith(" "))
    number = F.count_if(new).over(Window.partitionBy("diff_id", "hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_new", new).withColumn("new_line", F.when(F.col("_new"), (F.col("new_start") + number - 1).cast("int"))).drop("_file", "_of", "_new")


def added_lines(parsed: DataFrame) -> DataFrame:
    """(diff_id, path, line_no, text)"""
    return parsed.where(F.col("new_line").isNotNull() & F.col("line").startswith("+")).select("diff_id", "path", F.col("new_line").alias("line_no"), F.substr("line", F.lit(2)).alias("text"))


def hunk_ranges(parsed: DataFrame) -> DataFrame:
    """(diff_id, path, start, end) in the new files; hunks of no lines have no range."""
    heads = parsed.where(F.col("line").rlike(_HUNK) & (F.col("new_count") > 0))
    return heads.select("diff_id", "path", F.col("new_start").alias("start"), (F.col("new_start") + F.col("new_count") - 1).alias("end"))


def usable_rules(spark: SparkSession, rules: list[dict]) -> tuple[list[dict], int]:
    """(rules whose patterns compile and need neither look-around nor back-references, number of others)"""
    java, good = spark._jvm.java.util.regex.Pattern, []
    for rule in rules:
        try:
            if re.search(r"\(\?[=!<]|\\[1-9]", rule["pattern"]):
                raise ValueError
            java.compile(rule["pattern"])
            good.append(rule)
        except Exception:  # the JVM's own error for a pattern
            continue
    return good, len(rules) - len(good)


def pattern_priority(word: Column) -> Column:
    return F.when(word == "error", "P1").when(word == "info", "P3").otherwise("P2")


def matches(added: DataFrame, rules: DataFrame) -> DataFrame:
    """Added lines that a rule's pattern finds. rules: rule_seq, rule_uri, label, priority, pattern.

    Rules whose required words stand in a line are asked of it, and those without such words of every line."""
    return patterns.matching(added, rules)


def runs(matched: DataFrame) -> DataFrame:
    """Consecutive matched lines of a rule and file: (..., line_start, line_end, lines)."""
    key = ["diff_id", "rule_seq", "path"]
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*key).orderBy("line_no"))
    grouped = matched.withColumn("_island", island).groupBy(*key, "rule_uri", "label", "priority", "_island")
    quoted = F.array_sort(F.collect_list(F.struct("line_no", text_cap(F.col("text")).alias("text"))))
    return grouped.agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), quoted.alias("lines")).drop("_island")


def text_cap(line: Column) -> Column:
    return F.when(F.length(line) > QUOTED, F.concat(F.left(line, F.lit(QUOTED - 1)), F.lit("…"))).otherwise(line)


def prepass(added: DataFrame, rules: DataFrame, per_file: int = RUNS_PER_RULE_AND_FILE, overall: int = FINDINGS) -> DataFrame:
    """Findings of the pattern pre-pass, with `truncated` where a cap cut something of the diff.

    The caps are the feature: a report for people, in the order of rules, files and lines."""
    found = runs(matches(added, rules))
    at = F.row_number().over(Window.partitionBy("diff_id", "rule_seq", "path").orderBy("line_start"))
    ranked = found.withColumn("_at", at).withColumn("_over", F.max((F.col("_at") > per_file).cast("int")).over(Window.partitionBy("diff_id")))
    kept = ranked.where(F.col("_at") <= per_file).withColumn("_place", F.row_number().over(Window.partitionBy("diff_id").orderBy("rule_seq", "path", "line_start")))
    kept = kept.withColumn("_more", F.max((F.col("_place") > overall).cast("int")).over(Window.partitionBy("diff_id")))
    p = pattern_priority(F.col("priority"))
    title = F.concat(F.lit("["), p, F.lit("] `"), F.col("label"), F.lit("` pattern match in `"), F.col("path"), F.lit("`"))
    return kept.where(F.col("_place") <= overall).select("diff_id", "rule_seq", "path", "line_start", "line_end", p.alias("priority"), title.alias("title"), F.array("rule_uri").alias("rule_uris"), F.lit(1.0).cast("float").alias("confidence"), F.lit("pattern").alias("origin"), "lines", ((F.col("_over") + F.col("_more")) > 0).alias("truncated"))


def float_bits(x: float) -> str:
    return str(struct.unpack("<I", struct.pack("<f", x))[0])


def finding_id(review: Column, origin: Column, title: Column, body: Column, priority: Column, path: Column, line_start: Column, line_end: Column, confidence_bits: Column, rule_uris: Column, suggestion: Column | None = None) -> Column:
    """24 hexadecimal digits of SHA-256 over the fields, a NUL after each."""
    fields = [origin, review, title, body, priority, path, line_start.cast("string"), line_end.cast("string"), confidence_bits]
    ended = lambda c: F.concat(c, F.lit("\0"))
    uris = F.array_join(F.transform(rule_uris, ended), "")
    return F.substring(F.sha2(F.concat(*map(ended, fields), uris, F.coalesce(suggestion, F.lit("")) if suggestion is not None else F.lit("")), 256), 1, 24)


def grounded(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings whose lines lie within one changed range of their file."""
    return intervals.within_some(findings, ranges, ["path"], "line_start", "line_end", "start", "end")


def unknown_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(finding_id, rule_uri) of references to rules that aren't there."""
    return findings.select("finding_id", F.explode("rule_uris").alias("rule_uri")).join(rules.select("rule_uri"), "rule_uri", "left_anti").select("finding_id", "rule_uri")


def recorded(findings: DataFrame) -> DataFrame:
    """One row for each id: a repeated report is the same finding."""
    return findings.dropDuplicates(["finding_id"])


def filtered(findings: DataFrame, priority: str | None = None, path_part: str | None = None) -> DataFrame:
    if priority:
        findings = findings.where(F.col("priority") == priority)
    return findings.where(F.lower("path").contains(path_part.lower())) if path_part else findings


def sarif_level(priority: Column) -> Column:
    return F.when(priority.isin("P0", "P1"), "error").when(priority == "P2", "warning").otherwise("note")


def rdjson_severity(priority: Column) -> Column:
    return F.when(priority.isin("P0", "P1"), "ERROR").when(priority == "P2", "WARNING").otherwise("INFO")


def rdjsonl(findings: DataFrame) -> DataFrame:
    """(value): a diagnostic in JSON for each finding."""
    place = F.struct(F.col("path"), F.struct(F.struct(F.col("line_start").alias("line")).alias("start"), F.struct(F.col("line_end").alias("line")).alias("end")).alias("range"))
    return findings.select(F.to_json(F.struct(F.col("title").alias("message"), place.alias("location"), rdjson_severity(F.col("priority")).alias("severity"))).alias("value"))


def sarif(findings: list, tool: str = "folio") -> dict:
    """A SARIF 2.1.0 log of collected findings (a capped report)."""
    rules = sorted({u for f in findings for u in f["rule_uris"]})
    level = {"P0": "error", "P1": "error", "P2": "warning"}
    results = [
        {
            "level": level.get(f["priority"], "note"),
            "message": {"text": f["title"]},
            **({"ruleId": f["rule_uris"][0]} if f["rule_uris"] else {}),
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["path"]}, "region": {"startLine": f["line_start"], "endLine": f["line_end"]}}}],
            "partialFingerprints": {"findingId/v1": f["finding_id"]},
        }
        for f in findings
    ]
    return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": u} for u in rules]}}, "results": results}]}


def edit_applies(line_start: int, line_end: int, edits: list[dict]) -> bool:
    """Whether edits lie within the finding's lines and don't overlap."""
    order = sorted(edits, key=lambda e: e["line_start"])
    inside = all(line_start <= e["line_start"] <= e["line_end"] <= line_end for e in order)
    return inside and all(a["line_end"] < b["line_start"] for a, b in zip(order, order[1:], strict=False))


def todo_items(files: DataFrame) -> DataFrame:
    """(path, line_no, keyword, item): TODO and the like at a line's start or after a comment mark."""
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    shape = r"^(?:// |# |-- |;; |/\* |<!-- )?(TODO|FIXME|HACK|XXX)[:( ]?(.*)$"
    trimmed = F.trim("line")
    found = lines.where(trimmed.rlike(shape)).select("path", (F.col("pos") + 1).alias("line_no"), F.regexp_extract(trimmed, shape, 1).alias("keyword"), F.trim(F.regexp_extract(trimmed, shape, 2)).alias("item"))
    return found.where(F.col("item") != "")


def gutter_lines(files: DataFrame, first: int, last: int) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return lines.where(F.col("pos").between(first - 1, last - 1)).select("path", (F.col("pos") + 1).alias("line_no"), text.gutter(F.col("pos") + 1, F.col("line")).alias("shown"))
