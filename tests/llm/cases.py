"""Rows that every text operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "the QUICK brown fox jumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, "  \t\n "),
    (6, LONG),
    (7, LONG + " end"),
    (8, "one"),
    (9, "one two"),
    (10, "Ünïcode\xa0spaces　and\x1cseparators it's  we'll\r\n\r\n  x  "),
    (10, "Ünïcode\xa0spaces　and\x1cseparators it's  we'll\r\n\r\n  x  "),
    (None, "a row without id"),
    (12, "12345 !!! ??? 99"),
]


def frame(spark, rows=None):
    """With columns named like the operators' own."""
    made = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string")
    for name in ("id", "fp", "key", "digest", "keep_id", "n", "u", "v", "lang_pred", "score", "ids", "decoded", "mix_key"):
        made = made.withColumn(name, F.lit("clash"))
    return made.withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") < 5, "a"))
