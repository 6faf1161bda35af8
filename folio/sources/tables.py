"""The star-schema tables, and views of them in the shape of the engine's own inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, last change) of a table's files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = list(fs.listStatus(where))
    return sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as concepts: id, book, namespace, concept_id, language, text, tags."""
    d = table(spark, sf_dir, "documents")
    namespace = F.element_at(F.array(*map(F.lit, ("document", "skill", "styleguide", "memory"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("book"),
        namespace.alias("namespace"),
        F.concat(namespace, F.lit("/d"), F.col("doc_id").cast("string")).alias("concept_id"),
        F.col("lang").alias("language"),
        "text",
        F.array(F.col("lang"), F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))).alias("tags"),
    )


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): each text under a heading of its source, its second half under one of its language."""
    d = table(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / F.lit(2)).cast("int")
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.left("text", half), F.lit("\n\n## "), F.col("lang"), F.lit("\n\n"), F.substr("text", half + F.lit(1)))
    return d.select(F.col("doc_id").alias("id"), body.alias("body"))


_PYTHON = """import os

LIMIT = {k}


class Store{k}:
    def load(self, path):
        return read{r}(path)

    def save(self, path, data):
        self.load(path)
        write(path, data)


def read{r}(path):
    return os.open(path)


def write(path, data):
    print(path, data)
"""
_RUST = """pub struct Node{k} {
    x: u32,
}

impl Node{k} {
    pub fn new(x: u32) -> Self {
        check{c}(x);
        Node{k} { x }
    }
}

fn check{c}(x: u32) {}
"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a source file for each document, named by its id: Python, Markdown around the
    document's whole text, or Rust."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    named = lambda template: F.replace(F.replace(F.replace(F.lit(template), F.lit("{k}"), k.cast("string")), F.lit("{r}"), (k % 300).cast("string")), F.lit("{c}"), (k % 9).cast("string"))
    prose = F.concat(F.lit("# Top "), k.cast("string"), F.lit("\n\n> "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n> "), F.lit("\n\n## Part\n\nend"))
    path = F.when(k % 3 == 0, F.concat(F.lit("src/d"), k.cast("string"), F.lit(".py"))).when(k % 3 == 1, F.concat(F.lit("docs/d"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("src/d"), k.cast("string"), F.lit(".rs")))
    return d.select(path.alias("path"), F.when(k % 3 == 0, named(_PYTHON)).when(k % 3 == 1, prose).otherwise(named(_RUST)).alias("content"))


#: A unit for each line of a text. {i}: its number; {w}: its first word; {t}: its letters.
_UNITS = {
    "go": "// } {t} {\nfunc {w}x{i}(a int) {\n\ts := \"}} {w}\" + `{` + string('}')\n}\n",
    "rb": "# end {t}\ndef {w}_{i}(a)\n  x = \"end # {w}\"\n  if a then\n  end\nend\n",
    "ts": "class {w}{i} {\n  /* } {t} */ text = `{ {w} \\` }`;\n  draw(v: View) {\n  }\n}\n",
    "rs": "fn {w}_{i}(a: u32) {\n    // store({w}, 0);\n    let s = \"store({t}, 1)\";\n    store(a.{w}(s, {i})?, vec![{i}, 2]);\n    store(\n        s,\n    );\n}\n",
    "tsx": "function {w}{i}(v: View) {\n  if (v.{w} == null) { log(`}} {t}`, v); }\n  /* log(v, 1) */ return v.a + 1 == v.{w} && log(\"(\", f(v, {i}));\n}\n",
    "gd": "func {w}_{i}(a):\n\tvar s = \"func {t}():\"\n\treturn s # {w}\n\n",
    "yaml": "{w}{i}:\n  \"in \\\"{w}\": |\n    {w}: {t}\n\n  list:\n    - deep: {{w}: 1}\n      more: \"{w}: x\"\n",
    "toml": "[tool.{w}{i}]\na.{w} = [\n  \"b = {t}\",\n]\nb = 'c = {w}' # d = 1\n\n",
}


def generated_files(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """(id, path, content): a file for each document, of a kind by its number, with a unit for each line of its whole text."""
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    unit = F.element_at(F.create_map(*(F.lit(x) for k in kinds for x in (k, _UNITS[k]))), F.col("kind"))

    def made(line, i):
        word = F.regexp_extract(line, "[a-z]{3,}", 0)
        out = F.col("unit")
        for mark, value in (("{i}", i.cast("string")), ("{w}", F.when(word == "", "none").otherwise(word)), ("{t}", F.regexp_replace(line, "[^a-z]+", " "))):
            out = F.replace(out, F.lit(mark), value)
        return out

    named = d.select(F.col("doc_id").alias("id"), lines.alias("lines"), kind.alias("kind")).withColumn("unit", unit)
    return named.select("id", F.concat(F.lit("gen/d"), F.col("id").cast("string"), F.lit("."), "kind").alias("path"), F.array_join(F.transform("lines", made), "").alias("content"))
