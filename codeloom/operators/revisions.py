"""Patches, revisions and time travel: an append-only log of operations and the views over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.tables import stored


def first_by(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by seq."""
    struct = F.struct(seq, *[c for c in rows.columns if c not in (*keys, seq)])
    return rows.groupBy(*keys).agg(F.min(struct).alias("r")).select(*keys, "r.*")


def dedupe_edges(ops: DataFrame) -> DataFrame:
    """ops(edge_id, seq, attrs): first position, last attributes; both are combined before the shuffle."""
    return ops.groupBy("edge_id").agg(F.min("seq").alias("seq"), F.max_by("attrs", "seq").alias("attrs"))


def snapshot(log: DataFrame, rev: int) -> DataFrame:
    """log(id, rev, op, value) as it stands at a revision: the last operation of each id, unless it deletes."""
    last = log.where(F.col("rev") <= rev).groupBy("id").agg(F.max_by(F.struct("op", "value", F.col("rev").alias("at")), "rev").alias("r"))
    return last.where("r.op <> 'DeleteNode'").select("id", "r.value", F.col("r.at").alias("rev"))


def intervals(log: DataFrame) -> DataFrame:
    """(id, created_rev, deleted_rev, value): for how long each version of an id was visible."""
    w = Window.partitionBy("id").orderBy("rev")
    return log.withColumn("deleted_rev", F.lead("rev").over(w)).where("op <> 'DeleteNode'").select("id", F.col("rev").alias("created_rev"), "deleted_rev", "value")


def as_of(versions: DataFrame, rev: int) -> DataFrame:
    return versions.where((F.col("created_rev") <= rev) & (F.col("deleted_rev").isNull() | (F.col("deleted_rev") > rev)))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of snapshots(id, value): added, removed or modified."""
    both = before.select("id", F.col("value").alias("v0"), F.lit(True).alias("in0")).join(after.select("id", F.col("value").alias("v1"), F.lit(True).alias("in1")), "id", "full")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("v0").eqNullSafe(F.col("v1")), "modified")
    return both.select("id", change.alias("change")).where("change is not null")


def rev_timestamp(revs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(rev) -> the timestamp of that revision, or of the nearest one before; revs(rev, ts)."""
    from codeloom.operators.asof import asof_join

    found = asof_join(asked.select("rev").distinct(), revs.select("rev", "ts"), "rev", values=["ts"])
    return found.where("at_right is not null").select("rev", "ts")


def conflicts(claims: DataFrame) -> DataFrame:
    """claims(entity, field, value): live claims of one field with different values."""
    return claims.groupBy("entity", "field").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Positional comparison of lines: (key, line, old, new) where they differ; both have (key, text)."""
    lines = lambda d, name: d.select("key", F.posexplode(F.split("text", "\n", -1)).alias("line", name))
    return lines(old, "old").join(lines(new, "new"), ["key", "line"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def reconcile(previous: DataFrame, current: DataFrame, edges: DataFrame) -> DataFrame:
    """Operations that retire what a file no longer has: DeleteNode, then DeleteEdge of incident edges, by op_seq."""
    gone = previous.select("id").join(current.select("id"), "id", "left_anti")
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("id")).join(gone, "id", "left_semi").select("edge_id").distinct()
    ops = gone.select(F.lit("DeleteNode").alias("op"), "id", F.lit(0).alias("class")).unionByName(ends.select(F.lit("DeleteEdge").alias("op"), F.col("edge_id").alias("id"), F.lit(2).alias("class")))
    return ops


def commit(log: DataFrame, patches: DataFrame, base_rev: int | None = None) -> tuple[str, DataFrame]:
    """(status, log after): patches(patch_id, seq, payload) not in the log(patch_id, rev, seq, payload) yet are appended with the next revisions."""
    now = int(log.agg(F.coalesce(F.max("rev"), F.lit(0))).first()[0])
    if base_rev is not None and base_rev != now:
        return "BaseRevMismatch", log
    new = first_by(patches.join(log.select("patch_id"), "patch_id", "left_anti"), ["patch_id"], "seq")
    if new.isEmpty():
        return "Idempotent", log
    placed = numbered(new.withColumn("_at", F.struct("seq", "patch_id")), "_at", "rev", now).drop("_at")
    return "Ok", log.unionByName(placed.select(*log.columns))


def numbered(rows: DataFrame, order: str, name: str, base: int = 0) -> DataFrame:
    """rows with base + 1, base + 2, ... by a unique order column.

    The rows are written once, dealt by ranges of the order, with the number of
    their range; what is counted and what is numbered are that one table, so
    bounds that another sampling would draw elsewhere don't matter.  No task
    sees more than a range, and the driver one count for each.
    """
    ranged = stored(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    total, start = base, {}
    for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        start[r["_range"]] = total
        total += r["n"]
    if not start:
        return rows.withColumn(name, F.lit(0).cast("long"))
    bases = rows.sparkSession.createDataFrame(list(start.items()), "_range int, _base long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.join(F.broadcast(bases), "_range").withColumn(name, (within + F.col("_base")).cast("long")).drop("_range", "_base")


def next_edges(chunks: DataFrame) -> DataFrame:
    """chunks(file, seq, id, container): NEXT edges between neighbours of the full list that both have no container."""
    w = Window.partitionBy("file").orderBy("seq")
    rows = chunks.withColumn("next_id", F.lead("id").over(w)).withColumn("next_container", F.lead("container").over(w))
    return rows.where("next_id is not null and container is null and next_container is null").select(F.col("id").alias("src"), F.col("next_id").alias("dst"))


def replaces(path: Column, hash_: Column, extractors: list[str], ws: Column) -> Column:
    """Patch ids that a file's patch replaces: the previous hash under each extractor, and the legacy id."""
    from codeloom import ids

    return F.array(*[ids.patch_id(ws, path, hash_, F.lit(e)) for e in extractors], ids.legacy_patch_id(ws, path, hash_))


def unified_diff(old: DataFrame, new: DataFrame, around: int = 3) -> DataFrame:
    """(key, n, line): hunks of a unified diff with `around` lines of context, of old(key, text) and new(key, text) that differ.

    A file's longest common subsequence is sequential, so files are compared in
    Python, one at a time and in parallel with each other.
    """
    import difflib
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, at, lines = [], [], []
            for key, a, b in zip(batch["key"], batch["old"], batch["new"], strict=True):
                found = difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm="", n=around)
                for n, line in enumerate(x for k, x in enumerate(found) if k > 1):
                    keys.append(key)
                    at.append(n)
                    lines.append(line)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "n": pd.Series(at, dtype="int32"), "line": pd.Series(lines, dtype=object)})

    both = old.select("key", F.col("text").alias("old")).join(new.select("key", F.col("text").alias("new")), "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.mapInPandas(run, f"key {old.schema['key'].dataType.simpleString()}, n int, line string")


def hunks_in_span(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, n, line, at) of hunks(key, n, line) within spans(key, first, last) of the new text; removed lines also right behind the span."""
    header = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    w = Window.partitionBy("key").orderBy("n")
    rows = hunks.withColumn("start", F.when(header != "", header.cast("int")))
    rows = rows.withColumn("hunk", F.count("start").over(w)).withColumn("from", F.last("start", True).over(w)).where("start is null")
    steps = F.when(F.startswith("line", F.lit("-")), 0).otherwise(1)
    before = F.coalesce(F.sum(steps).over(Window.partitionBy("key", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", F.col("from") + before).join(spans, "key")
    removed = F.startswith("line", F.lit("-"))
    return rows.where((F.col("at") >= F.col("first")) & (F.col("at") <= F.when(removed, F.col("last") + 1).otherwise(F.col("last")))).select("key", "n", "line", "at")


def span_changes(changes: DataFrame) -> DataFrame:
    """(id, before, after) of changes(id, seq, side, first, last) to a symbol: its lines at the last change that knows them on either side."""
    known = changes.where("first is not null and last is not null")
    side = lambda s: F.max_by(F.when(F.col("side") == s, F.struct("first", "last")), F.when(F.col("side") == s, F.col("seq"))).alias(s)
    return known.groupBy("id").agg(side("before"), side("after"))


def diff_mode(options: DataFrame) -> DataFrame:
    """options(summary, content, full, limit, ..) with `conflict`: which of them exclude each other, the one that decides named first."""
    has_limit = F.col("limit").isNotNull()
    conflict = F.when(F.col("summary") & F.col("content"), "summary excludes content").when(F.col("summary") & (F.col("full") | has_limit), "summary ignores full and limit").when(F.col("full") & has_limit, "full excludes limit")
    return options.withColumn("conflict", conflict)


def diff_view(changes: DataFrame, limit: int | None = 100, full: bool = False, entity: str | None = None) -> DataFrame:
    """changes(id, change) in order, of one entity or all, up to the limit unless all are asked for."""
    rows = changes if entity is None else changes.where(F.col("id") == entity)
    rows = rows.orderBy("change", "id")
    return rows if full or limit is None else rows.limit(limit)
