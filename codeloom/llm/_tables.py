"""Tables between the phases of an operator, and connected components over links."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import _text
from codeloom.tables import dropped, shared_folder, size, small, stored

__all__ = ["NO_ID", "bounded_batches", "components", "dropped", "shared_folder", "size", "small", "stored"]

#: An id that is null orders after every other id.
NO_ID = (1 << 63) - 1


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to Python small, whatever the texts' lengths, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(Exception):
        now = spark.conf.get(key, "")
        if not now.isdigit() or int(now) > _text.BATCH_BYTES:
            spark.conf.set(key, str(_text.BATCH_BYTES))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids -> (id, component): each id that has a link, with the smallest id it reaches.

    Large-star and small-star contraction in turn, each round a written table.
    Every group-by keeps only a minimum, so a hub is combined before the
    shuffle; the joins are inner joins that adaptive execution may split.
    """
    norm = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = stored(norm(edges))
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        mid = stored(norm(large))
        low = mid.groupBy("a").agg(F.min("b").alias("m"))
        near = mid.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = stored(norm(near))
        then = _state(after)
        dropped(now, mid)
        now = after
        if then == state:
            break
        state = then
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr("cast(xxhash64(a, b) % 1000000007 as decimal(38, 0))")), F.lit(0)).alias("s")).first()
    return int(row.n), int(row.s)
