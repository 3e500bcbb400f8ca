"""The revision log as files: deltas by ranges of revisions, and snapshots between them.

    <path>/deltas/span=<s>/    operations (id, rev, op, value) from rev s * every up to the next span
    <path>/snapshots/upto=<b>/ what stands before revision b: (id, value, rev) of live ids

Appending writes the spans of the batch.  The first 128 spans are `every`
revisions wide, and then a span is as wide as a 64th to a 128th of its revision, so their
number grows with the logarithm of the log.  A snapshot is the one before it
and the deltas since, and it counts only once its files are complete.  The next
one is due after `snapshot_spans` narrow spans, or as many revisions as the last
one has rows, or a quarter of the revisions before it, whatever is most: what
is written stays in proportion to the log, and the number of snapshots grows
with its logarithm.  A state reads the last snapshot at or before
its revision and the spans after it; a difference reads the operations between
its revisions and looks up what stood before only for the ids that they touch.
Spans are the partitions of the tables, so files outside of them are never
opened.  Rows of a span are sorted by revision.

Batches come in order: no revision of a batch is below those of earlier ones'
finished snapshots.  An id's operations have different revisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operations that end an id.
ENDS = ("DeleteNode",)
#: Spans with numbers of up to so many bits are narrow; a number's bits beyond them are zero.
BITS = 7


class RevisionLog:
    def __init__(self, spark: SparkSession, path: str, every: int = 1 << 20, snapshot_spans: int = 4) -> None:
        """every: revisions of a narrow span; snapshot_spans: narrow spans between two snapshots, at least."""
        self._spark, self._path, self._every, self._spans = spark, path.rstrip("/"), every, snapshot_spans
        self._kinds: tuple[str, str] | None = None

    def _names(self, folder: str, key: str, done: bool = False) -> list[int]:
        """Numbers of the partitions of a folder; a listing of directories, not of rows."""
        jvm = self._spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self._path}/{folder}")
        fs = at.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{key}=")]
        return sorted(int(n.split("=")[1]) for n, p in names if not done or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _span(self, rev: int) -> int:
        k = rev // self._every
        low = max(k.bit_length() - BITS, 0)
        return k >> low << low

    def _span_of(self, rev: str) -> Column:
        k = F.floor(F.col(rev) / self._every).cast("long")
        return k - k % F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(k)) - BITS, F.lit(0)))

    def append(self, rows: DataFrame) -> None:
        """Add operations rows(id, rev, op, value)."""
        out = rows.select("id", "rev", "op", "value", self._span_of("rev").alias("span"))
        # Ranges of revisions: a span is as many files as it needs, each with narrow bounds.
        out.repartitionByRange("rev").sortWithinPartitions("span", "rev").write.mode("append").partitionBy("span").parquet(f"{self._path}/deltas")

    def _deltas(self, after: int, upto: int) -> DataFrame:
        """Operations with after <= rev < upto: the spans are told to the scan as partitions, the revisions as statistics."""
        rows = self._spark.read.parquet(f"{self._path}/deltas")
        return rows.where((F.col("span") >= self._span(after)) & (F.col("span") <= self._span(max(upto - 1, 0))) & (F.col("rev") >= after) & (F.col("rev") < upto)).drop("span")

    def _state(self, before: int) -> DataFrame:
        """(id, value, rev) of what stands before a revision."""
        base = max((b for b in self._names("snapshots", "upto", True) if b <= before), default=0)
        ops = self._deltas(base, before).select("id", "rev", "op", "value")
        if base:
            kept = self._spark.read.parquet(f"{self._path}/snapshots/upto={base}").select("id", "rev", F.lit("").alias("op"), "value")
            ops = ops.unionByName(kept)
        last = ops.groupBy("id").agg(F.max_by(F.struct("op", "value", "rev"), "rev").alias("r"))
        return last.where(~F.col("r.op").isin(*ENDS)).select("id", "r.value", "r.rev")

    def snapshots(self) -> list[int]:
        return self._names("snapshots", "upto", True)

    def compact(self) -> list[int]:
        """Write the snapshots that the finished spans allow, each from the one before; the boundaries written."""
        spans = self._names("deltas", "span")
        step, have, out = self._every * self._spans, self.snapshots(), []
        last = have[-1] if have else 0
        while True:
            rows = self._spark.read.parquet(f"{self._path}/snapshots/upto={last}").count() if last else 0
            b = last + -(-max(step, rows, last // 4) // step) * step
            # The last span may still grow.
            if not spans or b > spans[-1] * self._every:
                break
            self._state(b).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{self._path}/snapshots/upto={b}")
            out.append(b)
            last = b
        return out

    def at(self, rev: int) -> DataFrame:
        """(id, value, rev) of the live ids as of a revision."""
        return self._state(rev + 1)

    def diff(self, a: int, b: int, entity: str | None = None) -> DataFrame:
        """(id, change) from revision a to a later b: added, removed or modified, of one id or all."""
        ops = self._deltas(a + 1, b + 1)
        ops = ops if entity is None else ops.where(F.col("id") == entity)
        after = ops.groupBy("id").agg(F.max_by(F.struct("op", "value"), "rev").alias("r"))
        live = ~F.col("r.op").isin(*ENDS)
        after = after.select("id", live.alias("in1"), F.col("r.value").alias("v1"))
        before = self._state(a + 1).select("id", F.lit(True).alias("in0"), F.col("value").alias("v0"))
        both = after.join(before if entity is None else before.where(F.col("id") == entity), "id", "left")
        change = F.when(F.col("in1") & F.col("in0").isNull(), "added").when(~F.col("in1") & F.col("in0"), "removed").when(F.col("in1") & ~F.col("v0").eqNullSafe(F.col("v1")), "modified")
        return both.select("id", change.alias("change")).where("change is not null")

    def history(self, ids: DataFrame, a: int = 0, b: int | None = None) -> DataFrame:
        """(id, rev, op, value): operations of ids(id) from revision a to b."""
        upto = b + 1 if b is not None else 1 << 62
        return self._deltas(a, upto).join(ids.select("id").distinct(), "id", "left_semi")
