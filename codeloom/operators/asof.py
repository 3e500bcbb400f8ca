"""As-of joins: to each row the last one before it, by ranges and not by one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.tables import stored


def asof_join(left: DataFrame, right: DataFrame, at: str, by: Sequence[str] = (), values: Sequence[str] | None = None) -> DataFrame:
    """left's rows with `at_right` and the values of right's last row whose by-columns are equal and whose `at` is not later; null where there is none.

    Of right's rows with one time the largest by values counts.  Both sides are
    dealt by ranges of (by, at) in one partitioning and written, and the last
    value is carried along within a range; what it carries into the next ones
    is one row a range, the only thing that is sorted in one task.  So neither a
    frequent key nor a long stretch without right rows meets in one task.  Rows
    with null in `at` or a by-column find nothing and are kept.
    """
    by, values = list(by), list(values if values is not None else [c for c in right.columns if c != at and c not in by])
    key = [F.col(f"_by{k}") for k in range(len(by))]
    held = F.struct(F.col(at).alias("at"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)])
    names = [F.col(b).alias(f"_by{k}") for k, b in enumerate(by)]
    kept = F.col(at).isNotNull()
    for b in by:
        kept = kept & F.col(b).isNotNull()
    # One right row a time, so that the order of the right side is unique.
    best = right.where(kept).groupBy(*by, at).agg(F.max(held).alias("_held"))
    rows = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns])).select(*names, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.rand(1).alias("_salt"), "_row", F.lit(None).cast(best.schema["_held"].dataType).alias("_held"))
    both = best.select(*names, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(0.0).alias("_salt"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_held").unionByName(rows)
    order = [*key, F.col("_at"), F.col("_side"), F.col("_salt")]
    ranged = stored(both.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # With its by-columns a value is known to be of another key, so no window has to stop at keys.
    told = F.when(F.col("_held").isNotNull(), F.struct(*key, "_held"))
    last = ranged.where("_side = 0").groupBy("_range").agg(F.max(F.struct(*key, "_at", "_held")).alias("m")).select("_range", F.struct(*[F.col(f"m._by{k}") for k in range(len(by))], F.col("m._held")).alias("_last"))
    ends = ranged.select("_range").distinct().join(last, "_range", "left")
    before = F.last("_last", True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_range", before.alias("_before"))  # a row a range
    within = F.last(told, True).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.join(F.broadcast(carried), "_range").withColumn("_told", F.coalesce(within, F.col("_before"))).where("_side = 1")
    same = F.col("_at").isNotNull()
    for k in range(len(by)):
        same = same & (F.col(f"_by{k}") == F.col(f"_told._by{k}"))
    found = lambda field: F.when(same, F.col(f"_told._held.{field}"))
    return out.select("_row.*", found("at").alias("at_right"), *[found(f"v{k}").alias(v) for k, v in enumerate(values)])
