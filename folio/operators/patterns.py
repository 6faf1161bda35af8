"""Many patterns over many lines: only patterns whose required words stand in a line are asked.

From each pattern, words are read that every match must hold: the longest of those that follow each other
without a choice, or one for each alternative. They go into one automaton (Aho-Corasick) that finds, in one
pass over a line, the patterns that can match; these are then asked, as regular expressions. Patterns
without such words, or with syntax that isn't read here, are asked of every line.

Words are compared after lower-casing A-Z, so patterns that ignore case are found, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as codes
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of one automaton, and those without words that are broadcast together.
TOGETHER = 20_000
#: Escapes and groups that mean the same in both languages of patterns; others aren't read.
_READ = re.compile(r"(?:\(\?i\))?(?:[^\\(\[]|\((?!\?)|\(\?:|\\[bBdDwWsStnrf.()\[\]{}*+?|^$/\\\"'#:;,=!<>@%&~`-]|\[\^?(?:[^\\\[\]&]|\\[dDwWsStnrf.()\[\]{}*+?|^$/\\\"'-])+\])*")


def _words(tree) -> tuple[str, ...] | None:
    """Words one of which every match of a parsed pattern holds; None if there is none."""
    best: tuple[str, ...] | None = None
    run = ""

    def better(found: tuple[str, ...] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for code, value in tree:
        if code is codes.LITERAL:
            run += chr(value)
            continue
        better((run,) if run else None)
        run = ""
        if code is codes.SUBPATTERN:
            better(_words(value[-1]))
        elif code in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            better(_words(value[2]))
        elif code is codes.BRANCH:
            each = [_words(part) for part in value[1]]
            better(tuple(w for found in each for w in found) if all(each) else None)
    better((run,) if run else None)
    return best


@lru_cache(50_000)
def required_words(pattern: str) -> tuple[str, ...] | None:
    """Lower-cased (A-Z) words one of which stands in every text that the pattern matches; None: unknown."""
    if not _READ.fullmatch(pattern):
        return None
    try:
        found = _words(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None
    return tuple(sorted({_lower(w) for w in found})) if found else None


def _lower(text: str) -> str:
    """A-Z only: bytes, one character each."""
    return text.encode("utf-8", "surrogatepass").lower().decode("latin-1")


def candidates(lines: DataFrame, patterns: dict[int, str], text_col: str, out: str) -> DataFrame:
    """lines with the number of each pattern that can match their text; only patterns with required words."""
    wanted = {n: words for n, p in patterns.items() if (words := required_words(p))}
    at = lines.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        held: dict[str, list[int]] = {}
        for n, words in wanted.items():
            for word in words:
                held.setdefault(word, []).append(n)
        automaton = ahocorasick.Automaton()
        for word, numbers in held.items():
            automaton.add_word(word, numbers)
        if held:
            automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(at).to_pylist() if held else ()):
                hits = {n for _, numbers in automaton.iter(_lower(text)) for n in numbers} if text else ()
                rows += [i] * len(hits)
                found += sorted(hits)
            for cut in range(0, len(rows), 10_000):
                taken = batch.take(pa.array(rows[cut : cut + 10_000], pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found[cut : cut + 10_000], pa.int32())], [*batch.schema.names, out])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField(out, T.IntegerType())]))


def matching(lines: DataFrame, rules: DataFrame, text_col: str = "text", pattern_col: str = "pattern") -> DataFrame:
    """Each line with each rule whose pattern finds something in its text. Rules are a list that a driver
    holds (a book's), whatever the number of lines; they are taken by TOGETHER."""
    spark, out = lines.sparkSession, None
    every = rules.where(F.col(pattern_col).isNotNull()).collect()
    for at in range(0, max(len(every), 1), TOGETHER):
        some = every[at : at + TOGETHER]
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(some)], T.StructType([T.StructField("_rule", T.IntegerType()), *rules.schema.fields]))
        patterns = {i: r[pattern_col] for i, r in enumerate(some)}
        blind = [i for i, p in patterns.items() if not required_words(p)]
        found = candidates(lines, patterns, text_col, "_rule").join(F.broadcast(numbered), "_rule").where(F.rlike(text_col, F.col(pattern_col)))
        if blind:
            found = found.unionByName(lines.join(F.broadcast(numbered.where(F.col("_rule").isin(blind))), F.rlike(text_col, F.col(pattern_col))))
        out = found if out is None else out.unionByName(found)
    return out.drop("_rule")
