"""Joins of rows with intervals of rows, without comparing all of a file with all of it.

Whole numbers lie in blocks of 1, 8, 64, ... numbers. An interval is covered exactly, without overlap, by
at most 14 blocks of each size (the largest that fit, then smaller ones at its ends), and a number lies in one
block of each size, so a number and an interval that holds it share exactly one block. Joining by block
gives each pair once and no others, and a key is a part of a file, not a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 3
#: Rows of a file that are swept by one task.
SWEEP_BITS = 14


def _levels(intervals: DataFrame, start: str, end: str) -> int:
    """Sizes of blocks that the longest interval needs."""
    longest = intervals.agg(F.max(F.col(end) - F.col(start) + 1)).first()[0] or 1
    return 1 + max(0, int(longest).bit_length() - 1) // BITS


def blocks_of_interval(start: Column, end: Column, levels: int) -> Column:
    """array of struct(level, block): the cover of start to end, both included."""
    empty = F.array().cast("array<long>")

    def row(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first, last)).otherwise(empty)

    def of(level: int) -> Column:
        size, above = 1 << (BITS * level), 1 << BITS
        low, high = F.ceil(start.cast("long") / F.lit(size)), F.floor((end.cast("long") + 1) / F.lit(size))
        up, down = F.ceil(low / F.lit(above)) * above, F.floor(high / F.lit(above)) * above
        whole = F.lit(False) if level + 1 == levels else up < down
        own = F.when(low >= high, empty).when(whole, F.concat(row(low, up - 1), row(down, high - 1))).otherwise(row(low, high - 1))
        return F.transform(own, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))

    return F.concat(*(of(level) for level in range(levels)))


def blocks_of_number(number: Column, levels: int) -> Column:
    return F.array(*(F.struct(F.lit(level).alias("level"), F.floor(number.cast("long") / F.lit(1 << (BITS * level))).alias("block")) for level in range(levels)))


def holding(numbers: DataFrame, intervals: DataFrame, keys: list[str], number: str, start: str, end: str) -> DataFrame:
    """Each row of numbers with each row of intervals of its keys that holds its number. Null bounds hold nothing."""
    levels = _levels(intervals, start, end)
    one = numbers.withColumn("_b", F.explode(blocks_of_number(F.col(number), levels))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    other = intervals.withColumn("_b", F.explode(blocks_of_interval(F.col(start), F.col(end), levels))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    return one.join(other, [*keys, "_level", "_block"]).drop("_level", "_block")


def within_some(spans: DataFrame, intervals: DataFrame, keys: list[str], first: str, last: str, start: str, end: str) -> DataFrame:
    """Rows of spans whose numbers first to last lie within one interval of their keys.

    A span fits if, among the intervals that start before it or with it, the furthest end is not before
    its own. So one sort and a running maximum do: within parts of a file, after the maximum of the parts before."""
    part = lambda c: F.floor(F.col(c).cast("long") / F.lit(1 << SWEEP_BITS))
    held = intervals.dropna(subset=[*keys, start, end]).select(*keys, part(start).alias("_part"), F.col(start).cast("long").alias("_at"), F.col(end).cast("long").alias("_end"))
    asked = spans.withColumns({"_part": part(first), "_at": F.col(first).cast("long")})
    parts = held.groupBy(*keys, "_part").agg(F.max("_end").alias("_most")).unionByName(asked.select(*keys, "_part", F.lit(None).cast("long").alias("_most")).distinct())
    ordered = parts.groupBy(*keys, "_part").agg(F.max("_most").alias("_most"))
    before = ordered.select(*keys, "_part", F.max("_most").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = asked.withColumns({"_end": F.lit(None).cast("long"), "_is": F.lit(1)}).unionByName(held.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_part").orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_reach", F.max("_end").over(upto)).where("_is = 1").join(before, [*keys, "_part"], "left")
    return swept.where(F.greatest("_reach", "_before") >= F.col(last)).select(*spans.columns)


def innermost(rows: DataFrame, key: str, name: str, start: str, end: str, out_name: str, out_start: str) -> DataFrame:
    """rows with the name and start of the innermost other row of their key whose interval holds theirs; null at the top.

    Of several the one that starts last, then ends first, then comes first by name; a row of the same
    interval holds nothing. One sort by key and start, and a sweep that keeps the open intervals only."""
    order = rows.repartition(key).sortWithinPartitions(key, start, F.col(end).desc(), name)
    at = {c: rows.columns.index(c) for c in (key, name, start, end)}
    kinds = [T.StructField(out_name, rows.schema[name].dataType), T.StructField(out_start, rows.schema[start].dataType)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, stack = object(), []  # (start, end, name, own holder), ends falling from the bottom to the top
        for batch in batches:
            found = []
            for group, label, low, high in zip(*(batch.column(at[c]).to_pylist() for c in (key, name, start, end)), strict=True):
                if group != of:
                    of, stack = group, []
                if low is None or high is None:
                    found.append((None, None))
                    continue
                while stack and stack[-1][1] < high:
                    stack.pop()
                if stack and stack[-1][:2] == (low, high):
                    found.append(stack[-1][3])
                    continue
                holder = (stack[-1][2], stack[-1][0]) if stack else (None, None)
                found.append(holder)
                if stack and stack[-1][1] == high:
                    stack.pop()  # starts earlier: never the innermost again
                stack.append((low, high, label, holder))
            columns = list(zip(*found, strict=True)) or [[], []]
            schema = batch.schema
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns[0], schema.field(at[name]).type), pa.array(columns[1], schema.field(at[start]).type)], [*schema.names, out_name, out_start])

    return order.mapInArrow(sweep, T.StructType([*rows.schema.fields, *kinds]))
