"""An inverted file over vectors: coarse lists, probes of the nearest ones, and the exact way beside it.

Lists are the cells of centroids fitted on a bounded sample (a parameter);
every vector is indexed, in the list of its nearest centroid.  The table is
partitioned by list, so probes open the lists that they name.  Many queries
are answered at once: each is sent to its nearest lists, where it meets the
vectors in blocks of bounded size; a block keeps the best k of a query, and
only those meet again.  exact() sends every query to every block: the same, for
all lists.

Scores are cosines; ties go to the smaller id.  Vectors that are null, of
another length, not finite or zero have no direction: they are not indexed and,
as queries, find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.tables import stored

#: Vectors of a block, and queries that meet one at a time.
BLOCK, QUERIES = 8192, 2048


@dataclass
class VectorIndex:
    """table(list, block, id, v) with unit vectors, and the centroids."""

    table: DataFrame
    centroids: np.ndarray


def _unit(vectors: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("v")).where(F.size("v") == dims).withColumn("n", length).where("n > 0 and n < double('infinity')")
    return rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit(rows: DataFrame, lists: int, sample: int, rounds: int = 8) -> np.ndarray:
    """Centroids of at most `lists` cells from `sample` unit vectors with the least hashes; spherical k-means."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = np.array(got.column("v").to_pylist(), float)
    if not len(x):
        return np.zeros((0, 0))
    at = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        own = (x @ at.T).argmax(axis=1)
        for j in range(len(at)):
            total = x[own == j].sum(axis=0)
            if (norm := np.linalg.norm(total)) > 0:
                at[j] = total / norm
    return at


def build(vectors: DataFrame, lists: int = 32, sample: int = 20_000, id: str = "vec_id", vector: str = "embedding", dims: int = 64) -> VectorIndex:
    """The index of vectors(id, vector)."""
    rows = _unit(vectors, id, vector, dims)
    centroids = fit(rows, lists, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = (_matrix(batch.column(1), dims) @ centroids.T).argmax(axis=1) if len(centroids) else np.zeros(len(batch))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nearest.astype(np.int32))], names=["id", "v", "list"])

    placed = stored(rows.mapInArrow(run, "id long, v array<double>, list int"))
    # Blocks by hash, as many as a list needs: a list that holds most vectors is many blocks.
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id", F.rand(1)), F.col("blocks")).cast("int"))
    return VectorIndex(stored(dealt.select("id", "v", "block", "list").repartition("list", "block"), ["list"]), centroids)


def _best(queries: DataFrame, table: DataFrame, k: int, dims: int) -> DataFrame:
    """(query, id, score, rank): the best k of queries(query, q, list, block, part) among the rows of table of the same list, block and part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query, ids = left.column("query").to_numpy(), right.column("id").to_numpy()
        if not len(query) or not len(ids):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = (_matrix(t.column(c).combine_chunks(), dims) for t, c in ((left, "q"), (right, "v")))
        out = []
        for at in range(0, len(q), 256):
            score = np.round(q[at : at + 256] @ v.T, 9)
            for row, s in enumerate(score):
                # Ties at the k-th place are kept until the ids decide.
                good = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                good = good[np.lexsort((ids[good], -s[good]))[:k]]
                out.append((np.full(len(good), query[at + row]), ids[good], s[good]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query", "id", "score"), zip(*out, strict=True), strict=True)})

    columns = "query long, id long, score double"
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = queries.groupBy("list", "block", "part").cogroup(table.groupBy("list", "block", "part")).applyInArrow(run, columns)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(index: VectorIndex, queries: DataFrame, id: str, vector: str, dims: int, probes: int | None) -> DataFrame:
    """(query, q, list, order): queries at the lists that they probe, the nearest first; null probes are all lists."""
    rows = _unit(queries, id, vector, dims)
    centroids = index.centroids
    n = len(centroids) if probes is None else min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_matrix(batch.column(1), dims) @ centroids.T), axis=1, kind="stable")[:, :n] if len(centroids) else np.zeros((len(batch), 0))
            each = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
            order = pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(batch)))
            yield pa.record_batch([batch.column(0).take(each), batch.column(1).take(each), pa.array(near.ravel().astype(np.int32)), order], names=["query", "q", "list", "order"])

    return rows.mapInArrow(run, "query long, q array<double>, list int, order int")


def nearest(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = 4, id: str = "vec_id", vector: str = "embedding", dims: int = 64) -> DataFrame:
    """(query, id, score, rank): the k best of the probed lists for each of queries(id, vector); with probes None the exact answer."""
    asked = stored(_asked(index, queries, id, vector, dims, probes))
    # Parts of queries meet blocks of vectors: both sides of a group are bounded, however many queries probe a list.
    parts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    blocks = index.table.groupBy("list").agg(F.max("block").alias("blocks"))
    dealt = asked.join(F.broadcast(parts), "list").join(F.broadcast(blocks), "list")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    table = index.table.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _best(dealt.select("query", "q", "list", "block", "part"), table.select("id", "v", "list", "block", "part"), k, dims)


def exact(index: VectorIndex, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", dims: int = 64) -> DataFrame:
    return nearest(index, queries, k, None, id, vector, dims)


def probes_for(index: VectorIndex, queries: DataFrame, k: int = 10, target: float = 0.9, id: str = "vec_id", vector: str = "embedding", dims: int = 64) -> int:
    """The least number of probes with which `queries` find at least `target` of their k best: how far down a query's lists its true neighbours are."""
    truth = exact(index, queries, k, id, vector, dims).select("query", "id").join(index.table.select("id", "list"), "id")
    far = truth.join(_asked(index, queries, id, vector, dims, None).select("query", "list", "order"), ["query", "list"]).groupBy("order").count().orderBy("order").collect()
    total, seen = sum(r["count"] for r in far), 0
    for r in far:
        seen += r["count"]
        if seen >= target * total:
            return r.order + 1
    return len(index.centroids)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of truth(query, id) that is found(query, id)."""
    n = truth.count()
    return found.join(truth.select("query", "id"), ["query", "id"], "left_semi").count() / n if n else 1.0
