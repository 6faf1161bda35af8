"""Books in context: precedence, shadowing, trust, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text

#: Trust tiers from the least on. (Fixed values.)
TIERS = ["unverified", "machine-confirmed", "human-reviewed"]
PASSAGE_LIMIT = 2000


def tier_ordinal(tier: Column) -> Column:
    """0 for an unknown tier, as for `unverified`."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce(F.trim(tier), F.lit(TIERS[0])))
    return F.greatest(place.cast("int") - 1, F.lit(0))


def effective_trust(concepts: DataFrame, caps: DataFrame) -> DataFrame:
    """Adds `trust`. Local claims stand as they are; imported ones are held to their book's cap, and a
    book without one is unverified. concepts: book, is_local, claim; caps: book, cap."""
    least = F.least(tier_ordinal(F.col("claim")), tier_ordinal(F.coalesce("cap", F.lit(TIERS[0]))))
    imported = F.element_at(F.array(*map(F.lit, TIERS)), least + 1)
    return concepts.join(caps, "book", "left").withColumn("trust", F.when(F.col("is_local"), F.trim(F.coalesce("claim", F.lit(TIERS[0])))).otherwise(imported)).drop("cap")


def shadowed(named: DataFrame, name: str = "name", *order: str) -> DataFrame:
    """Adds `is_shadowed`: not the first of its name in the order of precedence."""
    return named.withColumn("is_shadowed", F.row_number().over(Window.partitionBy(name).orderBy(*order)) > 1)


def resolved(named: DataFrame, name: str = "name", *order: str) -> DataFrame:
    """The first of each name."""
    return shadowed(named, name, *order).where(~F.col("is_shadowed")).drop("is_shadowed")


def in_default_scope(namespace: Column, is_local: Column) -> Column:
    """Reserved namespaces, without the memory of imported books."""
    return namespace.isin(*text.RESERVED_NAMESPACES) & (is_local | (namespace != "memory"))


def with_provenance(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Adds origin, source_commit and shown: the passage, capped, and marked when it is imported.

    books: book, is_local, source_commit."""
    origin = F.when(F.col("is_local"), "local").otherwise("imported")
    capped = text.capped(F.col("passage"), PASSAGE_LIMIT, "… [cut: read the whole concept]")
    shown = F.when(F.col("is_local"), capped).otherwise(F.concat(F.lit("<untrusted book=\""), F.col("book"), F.lit("\">\n"), capped, F.lit("\n</untrusted>")))
    return hits.join(books, "book").withColumn("origin", origin).withColumn("shown", shown).drop("is_local")


def duplicate_names(books: DataFrame) -> DataFrame:
    """Books whose name is taken twice: opening a project with any is an error."""
    return books.groupBy("book").agg(F.count("*").alias("n")).where("n > 1")
