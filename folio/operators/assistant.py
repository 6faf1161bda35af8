"""Composites for callers: rule search with examples, questions over passages, provenance on hits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import context, decision, retrieval
from folio.operators.chunking import fenced, heading
from folio.operators.postings import Postings

CANDIDATES = 10
DEFAULT_K = 8


def section(body: str, name: str) -> str | None:
    """The text under a heading of level 2, up to the next of its level or above; fences are passed over.

    A section that is one code fence alone gives the code."""
    lines, out, inside = body.split("\n"), [], False
    for line, skip in zip(lines, fenced(lines), strict=True):
        found = None if skip else heading(line)
        if found and found[0] <= 2:
            inside = found == (2, name)
            continue
        if inside:
            out.append(line)
    said = "\n".join(out).strip()
    if not said:
        return None
    code = re.fullmatch(r"(```|~~~)[^\n]*\n(.*?)\n?\1", said, re.DOTALL)
    return code[2] if code and "\n```" not in code[2] else said


def search_rules(rules: DataFrame, units: DataFrame, query: str, vector: list[float] | None, k: int = DEFAULT_K, where: retrieval.Filter | None = None, index: Postings | None = None) -> list[dict]:
    """The best passage of each rule, best first, with its priority and Good and Bad examples.

    rules: id (of the passage), text, concept_id, priority, body, and the facets; index: kept postings of
    them, without which their texts are scanned."""
    hits = retrieval.search(index or rules, units, query, vector, retrieval.depth(k), where)
    named = hits.join(rules.select("id", "concept_id", "priority", "body", F.col("text").alias("passage")), "id")
    top = retrieval.first_of_each(named, "concept_id", k).orderBy("place").collect()
    return [{"concept_id": r.concept_id, "score": r.score, "priority": r.priority, "passage": r.passage, "good": section(r.body or "", "Good"), "bad": section(r.body or "", "Bad")} for r in top]


def ask(docs: DataFrame, units: DataFrame, question: str, vector: list[float] | None, provider: decision.DecisionProvider | None = None, k: int = DEFAULT_K, where: retrieval.Filter | None = None, index: Postings | None = None) -> dict:
    """The concept that answers a question, chosen by the provider among at most ten candidates.

    Passages are retrieved first and collapsed to concepts after, so there may be fewer than k. Without a
    provider, or when it doesn't answer, the best hit stands and the mode says so. index: kept postings of
    docs, without which their texts are scanned."""
    hits = retrieval.search(index or docs, units, question, vector, k, where)
    named = hits.join(docs.select("id", "concept_id", F.col("text").alias("passage")), "id")
    found = retrieval.first_of_each(named, "concept_id", CANDIDATES).orderBy("place").collect()
    candidates = [{"concept_id": r.concept_id, "score": r.score, "passage": r.passage} for r in found]
    if not candidates:
        return {"mode": "empty", "answer": None, "confidence": None, "candidates": []}
    ranked = {"mode": "ranked", "answer": candidates[0]["concept_id"], "confidence": None, "candidates": candidates}
    if provider is None:
        return ranked
    options = [c["concept_id"] for c in candidates]
    state = decision.fit({"question": question, "passages": [c["passage"] for c in candidates]})
    try:
        response = provider.decide({"state": state, "questions": {"answer": {"type": "choice", "options": options}}})
        chosen, sure = decision.choice(response, "answer", options)
    except (OSError, ValueError):
        return ranked | {"mode": "failed open"}
    return ranked if chosen is None else ranked | {"mode": "decided", "answer": chosen, "confidence": sure}


def decorated(hits: DataFrame, concepts: DataFrame, books: DataFrame, caps: DataFrame) -> DataFrame:
    """Hits (id, score) with passage, origin, trust and commit, in order. concepts: id, book, text, claim."""
    rows = hits.join(concepts.select("id", "book", F.col("text").alias("passage"), "claim"), "id")
    trusted = context.effective_trust(rows.join(books.select("book", "is_local"), "book"), caps).drop("is_local")
    return context.with_provenance(trusted, books).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def read(concepts: DataFrame, book: str, concept_id: str) -> DataFrame:
    """One concept by its qualified id, of the first book in precedence."""
    return concepts.where((F.col("book") == book) & (F.col("concept_id") == concept_id)).limit(1)


def list_skills(concepts: DataFrame) -> DataFrame:
    """Skills that keep their contract, in file or folder form, with the shadowed ones marked.

    concepts: book, concept_id, namespace, type, description, body, precedence."""
    parts = F.split("concept_id", "/")
    form = (F.size(parts) == 2) | ((F.size(parts) == 3) & (parts[1] == parts[2]))
    fine = (F.col("type") == "Skill") & (F.trim("description") != "") & (F.trim("body") != "")
    own = concepts.where((F.col("namespace") == "skill") & form & fine).withColumn("name", parts[1])
    return context.shadowed(own, "name", "precedence", "concept_id").select("book", "concept_id", "name", "description", "precedence", "is_shadowed")


def list_rules(concepts: DataFrame, language: str | None = None, category: str | None = None) -> DataFrame:
    """Rules that keep their contract, by facets: a facet that is asked for must be there and equal.

    concepts: book, concept_id, namespace, type, description, language, category, priority, precedence."""
    name = F.element_at(F.split("concept_id", "/"), -1)
    fine = (F.trim("type") == "Rule") & (F.trim("description") != "") & ~name.isin("index", "log")
    own = concepts.where((F.col("namespace") == "styleguide") & fine)
    for facet, wanted in (("language", language), ("category", category)):
        own = own if wanted is None else own.where(F.col(facet) == wanted)
    return own.orderBy("precedence", "concept_id").select("book", "concept_id", "description", "language", "category", "priority")
