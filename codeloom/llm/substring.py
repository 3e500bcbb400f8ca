"""Exact substring dedup over words.

Fixed-block anchors.  Every document's non-overlapping blocks of BLOCK words
are the reference index; every rolling window of BLOCK words of every document
probes it.  A repeat of `window` = 2 * BLOCK - 1 words holds a whole reference
block of either document, so each place of a repeat is hit.  Hits are then
extended both ways: every window around a hit is compared, as a whole, with
all windows around hits elsewhere, and the words of windows that start in a
document with a smaller id are removed; windows next to each other make up
maximal repeats.

Both exchanges move packed arrays, a few bytes a word, grouped by a slice of
the hash space; the number of slices follows the bytes of the texts, so that
one slice fits a task, and beyond TASKS of them a task takes several, one after
the other.  What a task can tell by itself does not travel: of a
block or window that it meets often, it sends one witness and answers the
others at once, so a passage that very many documents share reaches its slice
once a task's unit of words, not once a document.  Anchors carry 40 bits of
hash in a slice by all 64 (a false hit costs work, never results), windows 64 bits and independent
bits that choose the slice.

Null and empty texts have no words and keep nothing.  Rows that share an id
are not smaller than each other, so neither loses words to the other; a null
id orders after all others.  Texts shorter than a window stay whole; very long
ones are read whole, a slice of words at a time.  Repeated rows get equal
results, an empty table none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables, _text

#: Words that a task packs at a time, and entries of a slice of the hash space.
UNIT, SLICE = 1 << 19, 1 << 19
#: Shuffle partitions at most.
TASKS = 20_000
#: Bytes of text that a word takes, for the number of slices only.
WORD_BYTES = 6


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of the values, byte by byte: high bytes that are all zero cost next to nothing once compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _plain(data: memoryview, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").reshape(-1), at + n * width


def pack(part: np.ndarray, code: np.ndarray, width: int, row: np.ndarray, place: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
    """(part, blob): the entries of each part; row is the index of an entry's document in keys, ascending."""
    order = np.argsort(part, kind="stable")
    part, code, row, place = part[order], code[order], row[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    blobs = []
    for a, b in zip(cut, [*cut[1:], len(part)], strict=False):
        r = row[a:b]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        counts = np.diff(np.concatenate([first, [b - a]]))
        head = np.array([len(first), b - a], "<u8").tobytes()
        blobs.append(head + b"".join(_planes(k[r[first]].view(np.uint64), 8) for k in keys) + _planes(counts, 4) + _planes(code[a:b], width) + _planes(place[a:b], 4))
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "blob"])


def unpack(blobs: pa.ChunkedArray, width: int, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(code, row, place, keys) of all entries of a part; row is an index into keys."""
    codes, rows, places, found, base = [], [], [], [[] for _ in range(keys)], 0
    for blob in blobs:
        data = blob.as_buffer()
        docs, n = (int(x) for x in np.frombuffer(data, "<u8", 2))
        at = 16
        for k in range(keys):
            values, at = _plain(data, at, docs, 8)
            found[k].append(values.view(np.int64))
        counts, at = _plain(data, at, docs, 4)
        code, at = _plain(data, at, n, width)
        place, at = _plain(data, at, n, 4)
        codes.append(code)
        rows.append(np.repeat(np.arange(base, base + docs, dtype=np.int32), counts.astype(np.int64)))
        places.append(place.astype(np.int32))
        base += docs
    return np.concatenate(codes), np.concatenate(rows), np.concatenate(places), [np.concatenate(k) for k in found]


def replies(row: np.ndarray, place: np.ndarray, keys: list[np.ndarray], parts: int) -> pa.Table:
    """Places for documents, packed by a hash of the document: a row for each group of documents, not for each document."""
    group = (_text.mix(keys[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64) if len(row) else row
    return pa.Table.from_batches([pack(group[row] if len(row) else row, place.astype(np.uint64), 4, row, np.zeros(len(row), np.int64), keys)])


def collected(df: DataFrame, names: list[str], parts: int) -> DataFrame:
    """One row per document with all its places, from packed replies."""

    def run(table: pa.Table) -> pa.Table:
        place, row, _, keys = unpack(table.column("blob"), 4, len(names))
        place, keys = place.astype(np.int64), [k[row] for k in keys]
        order = np.lexsort([place, *reversed(keys)])
        place, keys = place[order], [k[order] for k in keys]
        new = np.ones(len(place), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(place)]]).astype(np.int32)), pa.array(place.astype(np.int32)))
        return pa.Table.from_arrays([*(pa.array(k[first]) for k in keys), lists], [*names, "places"])

    return df.repartition(min(parts, TASKS), "part").groupBy("part").applyInArrow(run, ", ".join(f"{n} long" for n in names) + ", places array<int>")


def _text_key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _groups(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the group of equal codes for each entry, size of each group)."""
    _, group, size = np.unique(code, return_inverse=True, return_counts=True)
    return group, size


#: Entries of a slice, or answers that a task found itself, which pass by.
PACKED = "part long, blob binary, told boolean"


def _marked(packed: pa.Table | pa.RecordBatch, told: bool) -> pa.RecordBatch:
    table = packed if isinstance(packed, pa.Table) else pa.Table.from_batches([packed])
    table = table.append_column("told", pa.array(np.full(len(table), told)))
    return table.combine_chunks().to_batches()[0] if len(table) else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.bool_())], ["part", "blob", "told"])


def _dealt(packed: DataFrame, parts: int, match: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Answers to packed(part, blob, told): match answers the entries of a slice."""

    def run(table: pa.Table) -> pa.Table:
        told = table.column("told")
        some, passed = table.filter(pc.invert(told)), table.filter(told).select(["part", "blob"])
        return pa.concat_tables([match(some), passed]) if len(some) else passed

    return packed.repartition(min(parts, TASKS), "part").groupBy("part").applyInArrow(run, "part long, blob binary")


def anchors(docs: DataFrame, block: int, parts: int) -> DataFrame:
    """(doc_id, places): where a rolling block of a document is a reference block elsewhere."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        words = docs_so_far = 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, row, place, ids = [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept.clear()
            # Next to a reference block of this unit every other entry is a hit; one block speaks for all to other tasks.
            fixed = place % block == 0
            group, size = _groups(code)
            blocks = np.bincount(group, fixed, len(size)).astype(np.int64)
            hit = (blocks[group] > fixed) & (size[group] > 1)
            witness = np.zeros(len(code), bool)
            at = np.flatnonzero(fixed)
            witness[at[np.unique(group[at], return_index=True)[1]]] = True
            yield _marked(replies(row[hit], place[hit], [ids], parts), True)
            send = ~hit | witness
            code, row, place = code[send], row[send], place[send]
            yield _marked(pack((_text.mix(code) % np.uint64(parts)).astype(np.int64), code & np.uint64((1 << 40) - 1), 5, row, place, [ids]), False)

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b, data, offsets in _text.slices(batch, "text"):
                w = _text.words(data, offsets)
                at, code = w.grams(block)
                doc = w.doc[at]
                kept.append((code, (doc + docs_so_far).astype(np.int32), (at - w.of[doc]).astype(np.int32), ids[a:b]))
                docs_so_far += b - a
                words += len(at)
                if words >= UNIT:
                    yield from flush()
                    words = docs_so_far = 0
        if words:
            yield from flush()

    def match(table: pa.Table) -> pa.Table:
        code, row, place, keys = unpack(table.column("blob"), 5, 1)
        fixed = place % block == 0
        index, count = np.unique(code[fixed], return_counts=True)
        if not len(index):
            return replies(row[:0], place[:0], keys, parts)
        at = np.minimum(np.searchsorted(index, code), len(index) - 1)
        # A reference block finds itself: only another one counts.
        hit = (index[at] == code) & (~fixed | (count[at] > 1))
        return replies(row[hit], place[hit], keys, parts)

    return collected(_dealt(docs.mapInArrow(probe, PACKED), parts, match), ["doc_id"], parts)


def repeats(hits: DataFrame, block: int, window: int, parts: int) -> DataFrame:
    """(doc_id, text_key, places): windows around hits whose words also start in a document with a smaller id."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        words = docs_so_far = 0

        def flush() -> Iterator[pa.RecordBatch]:
            part, code, row, place, ids, keys = [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept.clear()
            # What has a smaller id in this unit is late; one window of the smallest speaks for all to other tasks.
            group, size = _groups(code)
            low = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(low, group, ids[row])
            late = ids[row] > low[group]
            yield _marked(replies(row[late], place[late], [ids, keys], parts), True)
            send = ~late
            yield _marked(pack(part[send], code[send], 8, row[send], place[send], [ids, keys]), False)

        for batch in batches:
            ids = np.asarray(batch.column(0))
            places = batch.column(2)
            for a, b, data, offsets in _text.slices(batch, "text"):
                w = _text.words(data, offsets, hashes=2)
                near = np.zeros(len(w.start) + 1, bool)
                for k in range(a, b):
                    p = np.asarray(places[k].values) + w.of[k - a]
                    p = p[p < w.of[k - a + 1]]  # places of another text with this id
                    for back in range(block):
                        near[np.maximum(p - back, w.of[k - a])] = True
                at, code = w.grams(window)
                use = near[at]
                at, code = at[use], code[use]
                part = (_text.roll(w.hashes[1], window)[at] % np.uint64(parts)).astype(np.int64)
                doc = w.doc[at]
                raw = data.tobytes()
                kept.append((part.astype(np.int32), code, (doc + docs_so_far).astype(np.int32), (at - w.of[doc]).astype(np.int32), ids[a:b], np.array([_text_key(raw[offsets[k] : offsets[k + 1]]) for k in range(b - a)], np.int64)))
                docs_so_far += b - a
                words += len(at)
                if words >= UNIT:
                    yield from flush()
                    words = docs_so_far = 0
        if words:
            yield from flush()

    def match(table: pa.Table) -> pa.Table:
        code, row, place, keys = unpack(table.column("blob"), 8, 2)
        order = np.argsort(code, kind="stable")
        code, ids = code[order], keys[0][row[order]]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        low = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.concatenate([first, [len(code)]])))
        late = np.zeros(len(code), bool)
        late[order] = ids > low
        return replies(row[late], place[late], keys, parts)

    return collected(_dealt(hits.select("doc_id", "text", "places").mapInArrow(extend, PACKED), parts, match), ["doc_id", "text_key"], parts)


def _rest(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """What is left of docs(doc_id, text, places) without the words of the windows at places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if places.is_valid and len(places):
                    edge = np.zeros(n + 1, np.int64)
                    at = np.unique(np.asarray(places.values))
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + with_text], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    return docs.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def substring_dedup(docs: DataFrame, block: int = 7, with_text: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): words, words removed and what is kept, without repeats of 2 * block - 1 words or more."""
    spark = docs.sparkSession
    _tables.bounded_batches(spark)
    window = 2 * block - 1
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_tables.NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = 1 + int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]) // (WORD_BYTES * SLICE)
    hits = _tables.stored(anchors(docs, block, parts))
    ids = _tables.stored(hits.select("doc_id").distinct())
    some = docs.join(_tables.small(ids), "doc_id", "left_semi")
    late = _tables.stored(repeats(some.join(hits, "doc_id"), block, window, parts))
    _tables.dropped(hits, ids)
    ids = _tables.stored(late.select("doc_id").distinct())
    ids = _tables.small(ids)
    # Only texts that lose words are joined with them; all others pass by.
    key = _keyed(docs.join(ids, "doc_id", "left_semi"))
    cut = key.join(late, ["doc_id", "text_key"], "left").select("doc_id", "text", "places")
    whole = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"))
    out = _rest(cut, window, with_text).unionByName(_rest(whole, window, with_text))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _tables.NO_ID, F.col("doc_id")))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the key of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_text_key((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["doc_id", "text", "text_key"])

    return docs.mapInArrow(run, "doc_id long, text string, text_key long")
