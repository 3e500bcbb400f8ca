"""Incremental refresh with Structured Streaming, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_files(spark: SparkSession, root: str, schema: str, fmt: str = "json") -> DataFrame:
    """A stream of file snapshots (path, mtime, hash, deleted)."""
    return spark.readStream.schema(schema).format(fmt).load(root)


def changes(snapshots: DataFrame) -> DataFrame:
    """snapshots(path, mtime, hash, deleted) -> (path, change): new, changed or deleted, by the newest state of each path.

    The state keeps the time of the last event, of a deletion too, so that an
    older event neither revives nor changes a path; a deletion of a path that
    is not there is no change.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, digest = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(batches))
        for row in rows.sort_values(["mtime", "deleted"], kind="stable").itertuples():
            if at is not None and (row.mtime < at or (row.mtime == at and not row.deleted)):
                continue
            if row.deleted:
                if digest is not None:
                    out.append("deleted")
                at, digest = row.mtime, None
                continue
            if row.hash != digest:
                out.append("new" if digest is None else "changed")
            at, digest = row.mtime, row.hash
        if at is not None:
            state.update((int(at), digest))
        yield pd.DataFrame({"path": [key[0]] * len(out), "change": out})

    return snapshots.groupBy("path").applyInPandasWithState(step, "path string, change string", "mtime long, hash string", "append", GroupStateTimeout.NoTimeout)


def newest(snapshots: DataFrame) -> DataFrame:
    """The newest of snapshots(path, mtime, ..) of each path: set-coalesced, as a debounce leaves them."""
    struct = F.struct("mtime", *[c for c in snapshots.columns if c not in ("path", "mtime")])
    return snapshots.groupBy("path").agg(F.max(struct).alias("r")).select("path", "r.*").select(*snapshots.columns)


def refresh(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 milliseconds"):  # noqa: ANN201
    """One refresh runs at a time, with what came in meanwhile as the next: micro-batches, of each path the newest snapshot."""
    return stream.writeStream.foreachBatch(lambda df, n: handle(newest(df), n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; the same on a stream, where `late` bounds the state, and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def debounced(events: DataFrame, size: str = "10 minutes") -> DataFrame:
    """(key, window): each key once per window, the set-coalesced batch of a debounce."""
    return events.groupBy(F.window("ts", size).alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "event_type", "n")


def poll(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) between two polls(path, mtime): new, changed or deleted; what a watch without events of the file system sees."""
    both = previous.select("path", F.col("mtime").alias("then")).join(current.select("path", F.col("mtime").alias("now")), "path", "full")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def watch_source(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str = "300 milliseconds"):  # noqa: ANN201
    """Files that come into or change below root, as a stream of (path, mtime, hash) handed to `handle` batch by batch.

    Contents are hashed where they are read; a file is seen again when its time
    changes.
    """
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("allowOverwrites", True).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    seen = files.select("path", F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))
    return refresh(seen, handle, checkpoint, every)


def ingest_stream(files: DataFrame, parse: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame], DataFrame], commit: Callable[[DataFrame, int], None], checkpoint: str, per_batch: int = 500):  # noqa: ANN201
    """Ingest as a stream: each micro-batch of up to per_batch files is parsed, resolved and committed.

    The batches are those of the source (maxFilesPerTrigger); the number of a
    batch goes to `commit`, which is how a batch that runs again after a failure
    is known and not committed twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.persist()
        try:
            commit(resolve(parse(rows)), number)
        finally:
            rows.unpersist()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backoff(attempt: int, first: float = 1.0, most: float = 30.0) -> float:
    """Seconds to wait before the attempt after this one: doubling, up to `most`."""
    return min(most, first * 2**attempt)


#: Exit code of a run that leaves the work to one that is already under way; attempts of a watch to get its turn.
BUSY, ATTEMPTS = 75, 45


class SingleFlight:
    """One run at a time in a folder that all share: the first to make its marker has the turn.

    A marker older than `stale` seconds was left behind and is taken over.
    """

    def __init__(self, spark: SparkSession, folder: str, stale: float = 900.0) -> None:
        jvm = spark.sparkContext._jvm
        self._stale, self._at = stale, jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_running")
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def take(self) -> bool:
        import time

        for _ in range(2):
            try:
                self._fs.create(self._at, False).close()
                return True
            except Exception:  # noqa: BLE001  somebody has it
                if not self._fs.exists(self._at) or time.time() - self._fs.getFileStatus(self._at).getModificationTime() / 1000 < self._stale:
                    return False
                self._fs.delete(self._at, False)
        return False

    def leave(self) -> None:
        self._fs.delete(self._at, False)

    def run(self, work: Callable[[], object], attempts: int = ATTEMPTS, wait: Callable[[float], None] | None = None) -> int:
        """0 once work has run, BUSY if no turn came in all attempts."""
        import time

        for k in range(attempts):
            if self.take():
                try:
                    work()
                finally:
                    self.leave()
                return 0
            (wait or time.sleep)(backoff(k))
        return BUSY
