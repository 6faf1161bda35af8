"""python -m folio COMMAND: books, searches and maps from the command line; results as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from folio.functions import text
from folio.operators import calls, catalog, chunking, embedding, graph, index, retrieval, review, validation
from folio.operators.code import conflicts, outline, structure, symbols
from folio.sources import bundle, packages


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("folio").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _checked(spark, root):
    rows = bundle.read_concepts(spark, root, "book")
    patterns = [{"pattern": r.pattern} for r in rows.select("pattern").where("pattern IS NOT NULL").distinct().collect()]
    good = [r["pattern"] for r in review.usable_rules(spark, patterns)[0]]
    return rows.withColumn("pattern_ok", rows.pattern.isin(good)), rows


def provider(meta: dict) -> embedding.EmbeddingProvider:
    """What an index's description asks for: hashed vectors of its width, or none."""
    return embedding.Hashed(meta["width"]) if meta.get("width") else embedding.LexicalOnly()


def run(args: argparse.Namespace):
    """A DataFrame, or a value, for one command."""
    spark = session()
    match args.command:
        case "validate":
            return validation.violations(_checked(spark, args.root)[0], validation.concept_contracts())
        case "catalog":
            return catalog.namespace_counts(bundle.read_concepts(spark, args.root, args.name))
        case "search" if args.store:
            store = index.Store(spark, args.store)
            hits = store.search(args.query, retrieval.depth(args.k), provider(store.meta() or {}).embed_query(spark, args.query))
            named = store.units().withColumn("id", index.unit_id()).selectExpr("id", "concept_id", "passage AS text")
            return retrieval.first_of_each(hits.join(named, "id"), "concept_id", args.k)
        case "search":
            rows = bundle.read_concepts(spark, args.root, "book")
            cut = chunking.passages(rows.withColumnRenamed("concept_id", "id"), description_col="description", budget=args.budget)
            named = cut.withColumnRenamed("id", "concept_id").selectExpr("concat(concept_id, '#', ordinal) AS id", "concept_id", "passage AS text")
            hits = retrieval.lexical_leg(named, args.query, retrieval.depth(args.k)).join(named, "id")
            return retrieval.first_of_each(hits, "concept_id", args.k)
        case "index":
            rows = bundle.read_concepts(spark, args.root, args.name)
            cut = chunking.passages(rows.withColumnRenamed("concept_id", "id"), description_col="description", budget=args.budget).withColumnRenamed("id", "concept_id")
            cut = cut.join(rows.select("concept_id", "book", "namespace"), "concept_id")
            model = provider({"width": args.width})
            units = cut.join(index.concept_hashes(cut), index.KEY)
            return index.Store(spark, args.store).build(model.embed(units, "passage", "embedding") if args.width else units, model.model_id, model.width)
        case "package":
            return packages.package(args.root, args.target)
        case "symbols":
            return symbols.extract_symbols(packages.read_sources(spark, args.root))
        case "outline":
            found = symbols.extract_symbols(packages.read_sources(spark, args.root))
            return outline.render(found.where(found.path == args.path).collect())
        case "callers":
            files = packages.read_sources(spark, args.root)
            found = symbols.extract_symbols(files)
            edges = calls.calls_in_symbols(symbols.extract_calls(files), found)
            return edges.where(edges.callee == args.name).select("path", "caller", "caller_start").distinct()
        case "map":
            files = packages.read_sources(spark, args.root)
            defs = symbols.extract_definitions(files)
            edges = graph.reference_edges(defs, symbols.extract_references(files))
            ranks = graph.pagerank(files.select(files.path.alias("node")), edges)
            return graph.render_map(graph.top_definitions(defs, ranks, [], 800).collect(), args.budget)
        case "grep":
            files = packages.read_sources(spark, args.root)
            if args.rewrite is not None:
                return structure.rewrite_files(files, args.pattern, args.rewrite, args.lang).where("changed OR error_introduced")
            found = structure.search_files(files, args.pattern, args.lang)
            return found.withColumn("matched", text.match_preview(found.matched))
        case "todos":
            return review.todo_items(packages.read_sources(spark, args.root))
        case "conflicts":
            return conflicts.list_conflicts(packages.read_sources(spark, args.root))
    raise ValueError(args.command)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folio", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    more = {
        "validate": [], "catalog": ["--name"], "search": ["query"], "index": ["store", "--name"], "package": ["target"], "symbols": [],
        "outline": ["path"], "callers": ["name"], "map": [], "grep": ["pattern"], "todos": [], "conflicts": [],
    }
    for name, options in more.items():
        p = sub.add_parser(name)
        p.add_argument("root")
        for o in options:
            p.add_argument(o, **({"default": "book"} if o.startswith("--") else {}))
        if name == "search":
            p.add_argument("-k", type=int, default=5)
            p.add_argument("--store", help="a kept index, instead of cutting and scanning the book")
        if name == "grep":
            p.add_argument("--lang", default="python", help="the language whose files are searched")
            p.add_argument("--rewrite", help="a template for what is found: the differences are shown, no file is written")
        if name == "index":
            p.add_argument("--width", type=int, default=0, help="of the vectors kept with the passages; 0: none")
        p.add_argument("--budget", type=int, default=1000 if name == "map" else chunking.BUDGET)
    return top


def main(argv: list[str] | None = None) -> int:
    made = run(parser().parse_args(argv))
    if isinstance(made, str):
        sys.stdout.write(made)
    elif isinstance(made, dict):
        print(json.dumps(made))
    else:
        for row in made.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
