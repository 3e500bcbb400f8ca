"""Debounced refresh with timers in state: bursts become one batch, idle paths leave the state.

Both operators are `transformWithState` processors on processing time.  They
need the RocksDB state store (`use_rocksdb`), whose files lie below the
checkpoint of the query, so a lost executor's state comes back from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds without an event after which a burst is over, and those after which a path is idle.
QUIET_MS, IDLE_MS = 300, 10 * 60 * 1000


def use_rocksdb(spark: SparkSession) -> None:
    """Let the queries started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rearm(handle: StatefulProcessorHandle, at: int) -> None:
    for (old,) in [(t,) if not isinstance(t, tuple) else t for t in list(handle.listTimers())]:
        handle.deleteTimer(old)
    handle.registerTimer(at)


def _frame(rows: list[tuple], columns: dict[str, str]) -> Iterator[pd.DataFrame]:
    """Rows as one frame with plain objects for strings, or nothing."""
    if rows:
        yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=kind) for k, (c, kind) in enumerate(columns.items())})


class _PathChanges(StatefulProcessor):
    """Of a path: what was told last, and the newest snapshot of the burst under way."""

    def __init__(self, quiet: int, idle: int) -> None:
        self._quiet, self._idle = quiet, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._told = handle.getValueState("told", "mtime long, hash string")
        self._next = handle.getValueState("next", "mtime long, hash string, deleted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        told = self._told.get() if self._told.exists() else None
        newest = self._next.get() if self._next.exists() else None
        for part in rows:
            for r in part.itertuples():
                event = (int(r.mtime), None if r.hash is None or r.hash != r.hash else str(r.hash), bool(r.deleted))
                # Of one time a deletion counts; what is older than what was told is late.
                if (told is None or event[0] > told[0] or (event[0] == told[0] and event[2])) and (newest is None or (event[0], event[2]) >= (newest[0], newest[2])):
                    newest = event
        if newest is not None:
            self._next.update(newest)
            _rearm(self._handle, timerValues.getCurrentProcessingTimeInMs() + self._quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        if self._next.exists():
            mtime, digest, deleted = self._next.get()
            before = self._told.get()[1] if self._told.exists() else None
            change = ("deleted" if before is not None else None) if deleted else ("new" if before is None else "changed" if digest != before else None)
            out = [(key[0], change, mtime)] if change else []
            self._told.update((mtime, None if deleted else digest))
            self._next.clear()
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        else:
            self._told.clear()  # idle: the path is as good as never seen
        return _frame(out, {"path": "object", "change": "object", "mtime": "int64"})

    def close(self) -> None:
        pass


class _Bursts(StatefulProcessor):
    """Of a root: the paths of the burst under way, each once with its last change, and the number of the next batch."""

    def __init__(self, quiet: int) -> None:
        self._quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._paths = handle.getMapState("paths", "path string", "change string")
        self._number = handle.getValueState("number", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for part in rows:
            for path, change in zip(part["path"], part["change"], strict=True):
                self._paths.updateValue((path,), (change,))
        _rearm(self._handle, timerValues.getCurrentProcessingTimeInMs() + self._quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        number = self._number.get()[0] if self._number.exists() else 0
        found = sorted((p[0], c[0]) for p, c in self._paths.iterator())
        self._paths.clear()
        self._number.update((number + 1,))
        return _frame([(key[0], number, p, c) for p, c in found], {"root": "object", "batch": "int64", "path": "object", "change": "object"})

    def close(self) -> None:
        pass


def changes(snapshots: DataFrame, quiet_ms: int = QUIET_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of snapshots(path, mtime, hash, deleted) -> (path, change, mtime): one change a path and burst, once the path is quiet.

    Of a burst the newest snapshot decides against what was told last: new,
    changed, deleted, or nothing if the content is the same again.  A path
    without events for idle_ms leaves the state; if it comes back it is new.
    """
    return snapshots.groupBy("path").transformWithStateInPandas(_PathChanges(quiet_ms, idle_ms), "path string, change string, mtime long", "append", "processingTime")


def bursts(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of events(root, path, change) -> (root, batch, path, change): all paths since the last batch, once a root is quiet.

    A path is in a batch once, with its last change.
    """
    return events.groupBy("root").transformWithStateInPandas(_Bursts(quiet_ms), "root string, batch long, path string, change string", "append", "processingTime")
