"""Ball k-means over integer vectors: exact assignment that compares only what can change.

Vectors of `dims` components, none null or non-finite, become integers
floor(scale * x).  Clusters are balls: a centroid and a radius that no member
exceeds.  After a round the radius about the new centroid is at most the old
one plus the way the centroid went.  Centroid j is a neighbour of ball i if
half the distance of the centroids is within that radius; nearer than its own
centroid a member can only have a neighbour.  A ball's neighbours in order of
distance cut it into a stable core, within half the way to the first one, whose
members stay without a comparison, and into annuli: a member between half the
way to the t-th and the next compares with the first t neighbours only.  All of
this is in whole numbers on squared distances (4 d^2 < D^2 keeps a member, so a
tie is compared as well), and so is the result.

The vectors are written once as integers, and each round writes the table with
its clusters again, from which the next one takes the balls.  Every task adds
one row a cluster with its members' count, componentwise sums, largest and
summed distance, so that only k rows a task are shuffled and k rows reach the
driver.  What travels to the tasks are k centroids and their lists of
neighbours, k * (dims + k) numbers, bounded by the parameters.

Centroids start as the k kept vectors with the smallest sha256 of
`<seed>:<id>`; equal ids in the order of their vectors, null ids last.  If fewer
are kept, there are fewer centroids; from an empty table, or one without such
vectors, comes an empty result.  Repeated rows are vectors of their own.  A
vector of another length, or with a component from 2**27 on once scaled, for
which a squared distance may not fit a long, is dropped like one that is not
finite.  Sums of distances that do not fit a long are null.  Other columns are
not read.  Texts do not occur.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables
from codeloom.llm.vectors import entries, floors, matrix

#: Scaled components stay below this in magnitude, so that squared distances fit a long.
MOST = 1 << 27


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    away = x - c
    return np.einsum("ij,ij->i", away, away)


def _ceil_root(n: int) -> int:
    root = math.isqrt(n)
    return root + (root * root < n)


class Balls:
    """Centroids and, for each ball, its neighbours in order of distance with the squared distance from which a member has to look at them."""

    def __init__(self, centroids: list[list[int]], radii: list[int | None]) -> None:
        """radii: whole numbers that no member's distance exceeds; None if nothing is known."""
        self.at = np.array(centroids, np.int64)
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for i, radius in enumerate(radii):
            # 4 d^2 < D^2 as d^2 < ceil(D^2 / 4), which does not overflow.
            limit = -(-_squared(self.at, self.at[i]) // 4)
            met = limit <= min(1 << 62, 1 << 62 if radius is None else radius * radius)
            met[i] = False
            order = sorted(np.flatnonzero(met), key=lambda j: (limit[j], j))
            self.near.append((np.array(order, np.int64), limit[order]))

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of integer vectors that are members of the balls `own`."""
        cluster, distance = own.copy(), np.zeros(len(x), np.int64)
        for i in np.unique(own):
            at = np.flatnonzero(own == i)
            members, near, limit = x[at], *self.near[i]
            least, nearest = _squared(members, self.at[i]), np.full(len(at), i)
            annulus = np.searchsorted(limit, least, "right")  # 0: the stable core
            for t in range(annulus.max(initial=0)):
                rows = np.flatnonzero(annulus > t)
                d = _squared(members[rows], self.at[near[t]])
                better = (d < least[rows]) | (d == least[rows]) & (near[t] < nearest[rows])
                least[rows[better]], nearest[rows[better]] = d[better], near[t]
            cluster[at], distance[at] = nearest, least
        return cluster, distance


def _whole(vectors: DataFrame, id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, q, cluster): kept vectors as integers, all in ball 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, q = floors(matrix(batch.column(1), dims), scale, MOST)
            offsets = pa.array(np.arange(len(good) + 1) * dims, pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(q.astype(np.int32).ravel())), pa.array(np.zeros(len(good), np.int32))], names=["id", "q", "cluster"])

    rows = vectors.select(F.col(id).alias("id"), entries(vectors, vector).alias("v")).where(F.size("v") == dims)
    return rows.mapInArrow(run, f"id {vectors.schema[id].dataType.simpleString()}, q array<int>, cluster int")


def _round(members: DataFrame, balls: Balls) -> DataFrame:
    """members(id, q, cluster) with new clusters and distances; summary 1 marks the rows that sum up a task's members of a cluster."""
    k, dims = balls.at.shape
    kind = members.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        farthest, inertia = np.zeros(k, np.int64), [0] * k
        of_id = None
        for batch in batches:
            of_id = batch.schema.field(0).type
            x = matrix(batch.column(1), dims).astype(np.int64)
            cluster, distance = balls.assign(x, batch.column(2).to_numpy())
            for i in np.unique(cluster):
                at = cluster == i
                n[i] += at.sum()
                sums[i] += x[at].sum(axis=0)
                farthest[i] = max(farthest[i], distance[at].max())
                inertia[i] += sum(map(int, distance[at]))
            none = pa.nulls(len(x), pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), none, pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.decimal128(38, 0)), pa.array(np.zeros(len(x), np.int32))], names=NAMES)
        some = np.flatnonzero(n)
        if len(some):
            m = len(some)
            offsets = pa.array(np.arange(m + 1) * dims, pa.int32())
            yield pa.record_batch(
                [pa.nulls(m, of_id), pa.nulls(m, pa.list_(pa.int32())), pa.array(some.astype(np.int32)), pa.array(farthest[some]), pa.ListArray.from_arrays(offsets, pa.array(sums[some].ravel())), pa.array(n[some]), pa.array([inertia[i] for i in some], pa.decimal128(38, 0)), pa.array(np.ones(m, np.int32))],
                names=NAMES,
            )

    return members.mapInArrow(run, f"id {kind}, q array<int>, cluster int, distance long, sums array<long>, n long, inertia decimal(38, 0), summary int")


NAMES = ["id", "q", "cluster", "distance", "sums", "n", "inertia", "summary"]


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept row of vectors(id, vector): its cluster after `rounds` updates, squared distance and the inertia of its cluster and of all."""
    name = vectors.schema[id].dataType.simpleString()
    now = _tables.stored(_whole(vectors, id, vector, dims, scale))
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = [list(r.q) for r in now.orderBy(code.asc_nulls_last(), "q").limit(k).select("q").collect()]
    columns = f"{id} {name}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], columns)
    radii: list[int | None] = [None] * len(centroids)
    for turn in range(rounds + 1):
        after = _tables.stored(_round(now, Balls(centroids, radii)), ["summary"])
        _tables.dropped(now)
        total = F.sum(F.element_at("sums", F.col("d")).cast("decimal(38, 0)"))
        tasks = after.where("summary = 1")
        found = {r.cluster: r for r in tasks.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("distance").alias("farthest"), F.sum("inertia").alias("inertia")).collect()}
        if turn < rounds:
            sums = {(r.cluster, r.d): int(r.s) for r in tasks.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(dims)))).groupBy("cluster", "d").agg(total.alias("s")).collect()}
            before, radii = centroids, [0] * len(centroids)  # an empty ball has no member to compare
            centroids = [[sums[i, d] // found[i].n for d in range(1, dims + 1)] if i in found else c for i, c in enumerate(before)]
            for i, r in found.items():
                radii[i] = _ceil_root(r.farthest) + _ceil_root(sum((a - b) ** 2 for a, b in zip(before[i], centroids[i], strict=True)))
        now = after.where("summary = 0").select("id", "q", "cluster", "distance")
        now._codeloom_path = after._codeloom_path
    fits = lambda x: int(x) if x < 1 << 63 else None
    every = fits(sum(int(r.inertia) for r in found.values()))
    facts = [(i, fits(r.inertia), every, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, r in found.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select(F.col("id").alias(id), "cluster", "distance").join(F.broadcast(facts), "cluster").select(*(c.split()[0] for c in columns.split(", ")))
