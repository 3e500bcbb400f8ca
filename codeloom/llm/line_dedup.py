"""Line dedup by winnowing.

Of every `min_lines` consecutive lines of a document the one with the least
hash is a fingerprint, so any repeated run of at least that many lines shares
one.  Fingerprints that occur at two places are extended both ways: every run
of min_lines lines around one is compared with those around the others, and
lines of runs that start at an earlier place, by (id, line), are deleted.
Runs next to each other make up maximal repeats.

With `min_words`, shorter runs are found as well: those of that many words or
more, and documents of fewer than min_lines lines as a whole, wherever their
lines stood before.  These are compared as they are, without fingerprints.

Lines without a word belong to no run and stay.  Null text stays null and has
no lines.  Rows that share an id but not the text are told apart by the text;
equal rows count as one place and lose the same lines.  A null id orders after
all others.  Very long texts are read whole, in slices of bounded bytes; an
empty table gives no rows.  Columns beside doc_id and text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from codeloom.llm import _tables, _text
from codeloom.llm._features import _LINE


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, words) of each line that has a word."""
    lines = _text.words(data, offsets, _LINE)
    inside = _text.SPACE[data]
    begins = np.concatenate([[0], np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))])
    # A line's first byte may follow another document's last one.
    words = begins[lines.end] - begins[np.minimum(lines.start + 1, lines.end)] + inside[lines.start]
    some = words > 0
    return lines.doc[some], lines.hashes[0][some], words[some]


def fingerprints(docs: DataFrame, t: int) -> DataFrame:
    """(h, doc_id, text_key, place, context): selected lines, and the hashes of t - 1 lines before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch, "text"):
                doc, h, _ = _lines(data, offsets)
                of = np.searchsorted(doc, np.arange(b - a + 1))
                if len(h) < t:
                    continue
                # Least hash of each window, the last of equal ones.
                place = np.arange(len(h))
                start = place[np.repeat(of[1:], np.diff(of)) - place >= t]
                best = start.copy()
                for k in range(1, t):
                    better = h[start + k] <= h[best]
                    best[better] = start[better] + k
                best = np.unique(best)
                d = doc[best]
                context = np.zeros((len(best), 2 * t - 1), np.uint64)
                for k in range(2 * t - 1):
                    at = best + k - (t - 1)
                    ok = (at >= of[d]) & (at < of[d + 1])
                    context[ok, k] = h[at[ok]] | np.uint64(1)
                flat = pa.array(context.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, 2 * t - 1, dtype=np.int32)), flat)
                rows = pa.array(d + a)
                yield pa.RecordBatch.from_arrays([pa.array(h[best].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((best - of[d]).astype(np.int32)), lists], ["h", "doc_id", "text_key", "place", "context"])

    return docs.mapInArrow(run, "h long, doc_id long, text_key long, place int, context array<long>")


def short_runs(docs: DataFrame, t: int, min_words: int) -> DataFrame:
    """(w, doc_id, text_key, start, size, own): all runs of fewer than t lines; own are those of min_words, and whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch, "text"):
                doc, h, words = _lines(data, offsets)
                of = np.searchsorted(doc, np.arange(b - a + 1))
                left = np.repeat(of[1:], np.diff(of)) - np.arange(len(h))
                total = np.concatenate([[0], np.cumsum(words)])
                for size in range(1, t):
                    at = np.flatnonzero(left >= size)
                    if not len(at):
                        continue
                    d = doc[at]
                    own = (total[at + size] - total[at] >= min_words) | (np.diff(of)[d] == size)
                    w = _text.mix(_text.roll(h, size)[at] + np.uint64(size))
                    rows = pa.array(d + a)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - of[d]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(own)], ["w", "doc_id", "text_key", "start", "size", "own"])

    return docs.mapInArrow(run, "w long, doc_id long, text_key long, start int, size int, own boolean")


def _later(runs: DataFrame) -> DataFrame:
    """The own ones of runs(w, doc_id, text_key, start, size, own) that stand at an earlier place as well."""
    first = runs.groupBy("w").agg(F.min(F.struct("doc_id", "start", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("own").alias("some")).where("n > 1 and some").select("w", "first")
    late = runs.where("own").join(first, "w")
    return late.where((F.col("doc_id") > F.col("first.doc_id")) | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") > F.col("first.start"))))


def repeated(docs: DataFrame, t: int, min_words: int | None = None) -> DataFrame:
    """(doc_id, text_key, places): later runs, as t times the number of their first line, among those with a word, and their lines less one."""
    prints = _tables.stored(fingerprints(docs, t))
    shared = prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    runs = prints.join(shared, "h").select("doc_id", "text_key", "place", "context", F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("k"))
    runs = runs.select("doc_id", "text_key", (F.col("place") - (t - 1) + F.col("k")).alias("start"), F.slice("context", F.col("k") + 1, t).alias("lines")).where(~F.array_contains("lines", 0))
    runs = _tables.stored(runs.select("doc_id", "text_key", "start", F.xxhash64("lines").alias("w")).distinct())
    late = _later(runs.withColumns({"size": F.lit(t), "own": F.lit(True)}))
    if min_words is not None:
        # Written once, as they are read for the first places and for the later ones.
        late = late.unionByName(_later(_tables.stored(short_runs(docs, t, min_words))))
    return late.groupBy("doc_id", "text_key").agg(F.collect_set(F.col("start").cast("long") * t + F.col("size") - 1).alias("places"))


#: Columns of this operator on their way; columns of docs keep their names.
ID, KEY, PLACES, LINES, REMOVED = (f"_line_dedup_{c}" for c in ("id", "key", "places", "lines", "removed"))


def _cut(docs: DataFrame, t: int) -> DataFrame:
    """docs with the lines of the runs at PLACES taken out of text; REMOVED says how many."""
    text, places = docs.columns.index("text"), docs.columns.index(PLACES)
    names = [*docs.columns, REMOVED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = bytes([0x20, *range(0x09, 0x0E)])
        for batch in batches:
            texts, counts = [], []
            for value, at in zip(batch.column(text), batch.column(places), strict=True):
                lines = (value.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                some = np.array([k for k, line in enumerate(lines) if line.strip(blank)], np.int64)
                start, more = np.divmod(np.asarray(at.values), t)
                gone = np.unique(np.concatenate([start[more >= k] + k for k in range(t)]))
                drop = set(some[gone].tolist())
                texts.append(b"\n".join(line for k, line in enumerate(lines) if k not in drop).decode("utf-8", "surrogatepass"))
                counts.append(len(drop))
            columns = [pa.array(texts, pa.string()) if k == text else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names)

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(REMOVED, LongType()))


def cut_lines(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """docs with all its columns, text without later repeats of runs of min_lines lines or of min_words words or more, and LINES and REMOVED."""
    _tables.bounded_batches(docs.sparkSession)
    keyed = docs.withColumn("text", F.col("text").cast("string"))
    keyed = keyed.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(_tables.NO_ID))).withColumn(KEY, F.xxhash64("text"))
    late = repeated(keyed.select(F.col(ID).alias("doc_id"), F.col(KEY).alias("text_key"), "text"), min_lines, min_words)
    late = _tables.stored(late.select(F.col("doc_id").alias(ID), F.col("text_key").alias(KEY), F.col("places").alias(PLACES)))
    ids = _tables.stored(late.select(ID).distinct())
    ids = _tables.small(ids)
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias(LINES)
    none = F.lit(0).cast("long").alias(REMOVED)
    rest = keyed.join(ids, ID, "left_anti").select(*docs.columns, lines, none)
    some = keyed.join(ids, ID, "left_semi").join(late, [ID, KEY], "left")
    same = some.where(F.col(PLACES).isNull()).select(*docs.columns, lines, none)
    cut = _cut(some.where(F.col(PLACES).isNotNull()).select(*docs.columns, lines, PLACES), min_lines)
    return rest.unionByName(same).unionByName(cut.select(*docs.columns, LINES, REMOVED))


def line_dedup(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """doc_id, text, n_lines and n_removed of every row of docs."""
    return cut_lines(docs.select("doc_id", "text"), min_lines, min_words).withColumnsRenamed({LINES: "n_lines", REMOVED: "n_removed"})
