"""Streams with timers: one burst is one batch, and an idle path leaves the state."""

import json
import time

from codeloom.streaming import timers


def put(folder, name, rows):
    part = folder.parent / f"{name}.tmp"
    part.write_text("".join(json.dumps(r) + "\n" for r in rows))
    part.rename(folder / f"{name}.json")


def wait(done, seconds=60):
    end = time.time() + seconds
    while not done():
        assert time.time() < end, "the stream did not get there"
        time.sleep(0.2)


def started(df, rows, tmp_path):
    return df.writeStream.foreachBatch(lambda b, n: rows.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").start()


def test_path_changes(spark, tmp_path):
    (source := tmp_path / "in").mkdir()
    timers.use_rocksdb(spark)
    snapshots = spark.readStream.schema("path string, mtime long, hash string, deleted boolean").json(str(source))
    rows = []
    snap = lambda p, t, h, d=False: {"path": p, "mtime": t, "hash": h, "deleted": d}
    put(source, "a", [snap("x", 1, "h1"), snap("x", 3, "h3"), snap("x", 2, "h2"), snap("y", 1, "k"), snap("z", 1, "q"), snap("z", 2, None, True)])
    query = started(timers.changes(snapshots, 1500, 6000), rows, tmp_path)
    try:
        wait(lambda: len(rows) >= 2)
        assert sorted(rows) == [("x", "new", 3), ("y", "new", 1)]  # one a burst; z came and went
        put(source, "b", [snap("x", 4, "h3"), snap("y", 5, "k2"), snap("y", 5, None, True), snap("x", 1, "old")])
        wait(lambda: len(rows) >= 3)
        assert rows[2:] == [("y", "deleted", 5)]  # x has its content again, and an older event changes nothing
        wait(lambda: query.lastProgress and query.lastProgress["stateOperators"] and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
        put(source, "c", [snap("x", 9, "h3")])
        wait(lambda: len(rows) >= 4)
        assert rows[3:] == [("x", "new", 9)]
    finally:
        query.stop()


def test_bursts(spark, tmp_path):
    (source := tmp_path / "in").mkdir()
    timers.use_rocksdb(spark)
    events = spark.readStream.schema("root string, path string, change string").option("maxFilesPerTrigger", 1).json(str(source))
    rows = []
    event = lambda p, c, root="r": {"root": root, "path": p, "change": c}
    put(source, "a", [event("x", "new"), event("y", "new")])
    put(source, "b", [event("x", "changed"), event("w", "deleted"), event("x", "new", "other")])
    query = started(timers.bursts(events, 4000), rows, tmp_path)
    try:
        wait(lambda: len(rows) >= 4)
        assert sorted(rows) == [("other", 0, "x", "new"), ("r", 0, "w", "deleted"), ("r", 0, "x", "changed"), ("r", 0, "y", "new")]
        put(source, "c", [event("z", "new")])
        wait(lambda: len(rows) >= 5)
        assert rows[4:] == [("r", 1, "z", "new")]
    finally:
        query.stop()
