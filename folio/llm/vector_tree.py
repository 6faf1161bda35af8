"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

* Rows of equal vectors are one point of the index with their k + 1 smallest ids: a query never
  needs more of them, so nothing is lost, and a vector that a third of all rows share is one point.
* The tree is fitted on a bounded sample (``sample_rows``): spherical k-means, recursively, until
  leaves hold few sample points. All points are then assigned to leaves.
* A query's leaves come from best-bin-first traversal: a priority queue of nodes by the angle to
  their centres; the nearest is opened, a leaf is a visit.
* The number of visits is calibrated: for a sample of queries, true neighbours are found among all
  points in blocks, and visits widen until the sample's recall reaches ``recall``.
* A first round visits each query's first leaves; later visits hand on only what beats its result.
* Queries meet the points of their leaves in bounded blocks: large leaves are split into parts, and
  so are large sets of queries on one leaf. Each block is one matrix product.

Cosines are computed in double precision on the original vectors. Ties go to the smaller id.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither do vectors of another dimension than the most common one (the larger, on a tie). Rows of null
id take no part. Repeated rows count once as candidates and each as a query. With fewer than k
candidates all are returned. Empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.storage import discard, save, saved

SAMPLE_ROWS = 20_000
BRANCHING = 8
LEAF_ROWS = 200
CALIBRATION_QUERIES = 200
RECALL = 0.97
#: Visits of the first round; later ones hand on only what beats its result.
FIRST_VISITS = 8
#: Points, and queries, in one block of work at most, as their hashes fall.
BLOCK_ROWS = 4096
SALTS = 16


def valid(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def kind_of(vectors: DataFrame, vector_col: str) -> str:
    """array<float> for vectors of floats; array<double> for all others, so that no digit is lost."""
    return "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"


def points(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(rep, ids, vec): each distinct vector with its `keep` smallest ids, rep the first of them."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind_of(vectors, vector_col)).alias("vec")).where(F.col("id").isNotNull() & valid(F.col("vec")))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = lambda df, *by: df.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("at") <= keep)
    salted = first(salted.distinct(), "vec", "salt")
    few = first(salted, "vec").groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return few.select(F.col("ids")[0].alias("rep"), "ids", "vec")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Tree:
    """Nodes 0 .. n-1; children[i] is empty for a leaf, and centres[i] holds the children's centres."""

    def __init__(self) -> None:
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray | None] = []

    @classmethod
    def fit(cls, sample: np.ndarray, branching: int, leaf_sample: int, seed: int = 7) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)
        tree._grow(unit(sample) if len(sample) else sample, branching, max(1, leaf_sample), rng)
        return tree

    def _grow(self, rows: np.ndarray, branching: int, leaf_sample: int, rng: np.random.Generator) -> int:
        node = len(self.children)
        self.children.append([])
        self.centres.append(None)
        if len(rows) <= leaf_sample or len(rows) < 2:
            return node
        centres = rows[rng.choice(len(rows), min(branching, len(rows)), replace=False)]
        for _ in range(10):
            near = (rows @ centres.T).argmax(axis=1)
            sums = np.array([rows[near == c].sum(axis=0) for c in range(len(centres))])
            norms = np.sqrt((sums * sums).sum(axis=1))
            centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
        near = (rows @ centres.T).argmax(axis=1)
        used = [c for c in range(len(centres)) if (near == c).any()]
        if len(used) < 2:
            return node
        self.centres[node] = centres[used]
        self.children[node] = [self._grow(rows[near == c], branching, leaf_sample, rng) for c in used]
        return node

    def leaf_count(self) -> int:
        return sum(not c for c in self.children)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        at = np.zeros(len(rows), np.int32)
        todo = [0] if len(rows) else []
        while todo:
            node = todo.pop()
            if not self.children[node]:
                continue
            own = np.flatnonzero(at == node)
            if len(own):
                at[own] = np.array(self.children[node], np.int32)[(rows[own] @ self.centres[node].T).argmax(axis=1)]
                todo += self.children[node]
        return at

    def leaves(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
                continue
            for child, near in zip(self.children[node], self.centres[node] @ query, strict=True):
                heapq.heappush(queue, (1.0 - near, child))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row."""
    dot = lambda x, y: np.array([x[i] @ y[i] for i in range(len(x))])
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b)) if max(np.abs(a).max(), np.abs(b).max()) > 1e100 or min(np.abs(a).max(axis=1).min(), np.abs(b).max(axis=1).min()) < 1e-100 else (a, b)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


#: Cosines by a matrix product of unit vectors are this near to those computed one by one.
ROUNDING = 1e-9
#: Pairs whose cosines are computed one by one at a time.
PAIRS = 1 << 16


def best(queries: np.ndarray, rows: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, row's index, cosine) of the k best rows of each query; ties to the smaller rep.

    A matrix product finds all that may be among them: those not below the k-th by more than its rounding,
    however many tie. Their cosines are computed again one by one, so that a pair's value doesn't depend
    on its block."""
    near = unit(queries) @ unit(rows).T
    least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if k < len(rows) else np.full(len(queries), -2.0)
    q, r = np.nonzero(near >= least[:, None] - ROUNDING)
    scores = np.concatenate([exact_cosines(queries[q[i : i + PAIRS]], rows[r[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)]) if len(q) else np.empty(0)
    order = np.lexsort((reps[r], -scores, q))
    q, r, scores = q[order], r[order], scores[order]
    starts = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - starts[q] < k
    return q[kept], r[kept], scores[kept]


class Index:
    """All points by leaf, the tree, and the calibrated number of visits."""

    def __init__(self, table: DataFrame, path: str, tree: Tree, width: int, visits: int, kind: str):
        self.table, self.path, self.tree, self.width, self.visits, self.kind = table, path, tree, width, visits, kind


def _leaf_order(queries: DataFrame, tree: Tree, width: int, visits: int, kind: str) -> DataFrame:
    """(qrep, qvec, leaf, visit) of each query's first leaves."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, rows = [], unit(matrix(part.column(1), width))
                for i, row in enumerate(rows):
                    found += [(i, leaf, n) for n, leaf in zip(range(visits), held.leaves(row), strict=False)]
                i, leaf, n = (np.array(x, np.int32) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int32),) * 3
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(leaf), pa.array(n)], ["qrep", "qvec", "leaf", "visit"])

    return queries.select("qrep", "qvec").mapInArrow(run, f"qrep long, qvec {kind}, leaf int, visit int")


def _visits(table: DataFrame, tree: Tree, width: int, k: int, n_queries: int, recall: float) -> int:
    """The least number of visits that gives a bounded sample of points, as queries, enough recall.

    Their true neighbours are found among all points, in blocks."""
    n = table.count()
    chosen = table.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1_000_000)) < int(np.ceil(1.2e6 * n_queries / max(n, 1)))).select("rep", "vec").limit(2 * n_queries).toArrow()
    if not chosen.num_rows or tree.leaf_count() == 1:
        return 1
    ids = chosen.column("rep").to_numpy()
    queries = matrix(chosen.column("vec").combine_chunks(), width)
    shared = table.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        for batch in batches:
            if batch.num_rows:
                reps = batch.column(0).to_numpy()
                q, r, scores = best(wanted, matrix(batch.column(1), width), reps, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(reps[r]), pa.array(scores), batch.column(2).take(pa.array(r))], ["q", "rep", "score", "leaf"])

    found = table.select("rep", "vec", "leaf").mapInArrow(run, "q long, rep long, score double, leaf int").where("q <> rep")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    truth = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("q", "leaf").collect()
    ranks = {int(i): {leaf: n for n, leaf in enumerate(tree.leaves(v))} for i, v in zip(ids, unit(queries), strict=True)}
    needed = sorted(ranks[row.q][row.leaf] for row in truth)
    return 1 + needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample_rows: int = SAMPLE_ROWS, branching: int = BRANCHING, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, calibration_queries: int = CALIBRATION_QUERIES) -> Index:
    """An index of all valid vectors for searches of up to k neighbours.

    Queries are read in the index's type (floats or doubles)."""
    spark, kind = vectors.sparkSession, kind_of(vectors, vector_col)
    every, every_at = save(points(vectors, id_col, vector_col, k + 1), "ann-points")
    widths = every.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width, n = (widths.width, widths["count"]) if widths else (1, 0)
    own = every.where(F.size("vec") == width)
    share = min(1.0, sample_rows / max(n, 1))
    picked = own.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).select("vec").toArrow()
    sample = matrix(picked.column("vec").combine_chunks(), width) if n else np.empty((0, width))
    leaf_sample = max(2, round(len(sample) * leaf_rows / max(n, 1)))
    tree = Tree.fit(sample, branching, leaf_sample)
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(unit(matrix(batch.column(2), width)) if batch.num_rows else np.empty((0, width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["rep", "ids", "vec", "leaf"])

    table, path = save(own.mapInArrow(run, f"rep long, ids array<long>, vec {kind}, leaf int"), "ann-index")
    visits = _visits(table, tree, width, k, calibration_queries, recall)
    discard(spark, every_at)
    return Index(table, path, tree, width, visits, kind)


def _order(*by: str) -> Window:
    return Window.partitionBy("qrep").orderBy(F.desc("score"), *by)


def _nearest(met: DataFrame, k: int) -> DataFrame:
    return met.withColumn("at", F.row_number().over(_order("rep"))).where(F.col("at") <= k + 1).drop("at")


def _met(index: Index, visits: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(qrep, rep, score): of each block the k + 1 best points of each query that are not below its floor."""
    width = index.width
    size = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    blocks = size(index.table, "parts").join(size(visits, "turns"), "leaf")
    blocks = F.broadcast(saved(blocks, "ann-blocks"))  # a row for each leaf: bounded by the sample
    dealt = lambda df, key, own, other: df.join(blocks, "leaf").withColumn(own[0], F.pmod(F.xxhash64(key), F.col(own[1])).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
    rows = dealt(index.table, "rep", ("part", "parts"), ("turn", "turns")).select("leaf", "part", "turn", "rep", "vec")
    sought = dealt(visits, "qrep", ("turn", "turns"), ("part", "parts")).select("leaf", "part", "turn", "qrep", "qvec", "floor")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qrep": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        reps, qreps = left.column("rep").to_numpy(), right.column("qrep").to_numpy()
        q, r, scores = best(matrix(right.column("qvec").combine_chunks(), width), matrix(left.column("vec").combine_chunks(), width), reps, k + 1)
        kept = scores >= right.column("floor").to_numpy()[q]
        return pa.table({"qrep": qreps[q][kept], "rep": reps[r][kept], "score": scores[kept]})

    keys = ["leaf", "part", "turn"]
    return rows.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInArrow(run, "qrep long, rep long, score double")


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, without the query's own id."""
    width = index.width
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast(index.kind).alias("qvec"))
    asked = asked.where(F.col("query_id").isNotNull() & valid(F.col("qvec")) & (F.size("qvec") == width))
    one = saved(asked.groupBy("qvec").agg(F.min("query_id").alias("qrep")), "ann-queries")
    visits = saved(_leaf_order(one, index.tree, width, index.visits, index.kind), "ann-visits")

    first = _nearest(_met(index, visits.where(F.col("visit") < FIRST_VISITS).withColumn("floor", F.lit(-2.0)), k, block_rows), k)
    first = saved(first, "ann-first")
    enough = F.count("*") > k
    floors = first.groupBy("qrep").agg(F.when(enough, F.min("score")).otherwise(-2.0).alias("floor"))
    later = visits.where(F.col("visit") >= FIRST_VISITS).join(floors, "qrep", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    near = _nearest(first.union(_met(index, later, k, block_rows)), k)
    named = near.join(index.table.select("rep", "ids"), "rep").select("qrep", "score", F.explode("ids").alias("vec_id"))
    named = named.withColumn("at", F.row_number().over(_order("vec_id"))).where(F.col("at") <= k + 1)
    lists = named.groupBy("qrep").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    to_rep = asked.join(one, "qvec").select("query_id", "qrep")
    own = to_rep.join(lists, "qrep").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    flat = own.select("query_id", F.posexplode("near").alias("pos", "hit"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
