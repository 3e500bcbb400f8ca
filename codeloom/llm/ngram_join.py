"""N-gram Jaccard join: documents whose sets of word shingles are at least so similar, exactly.

Universe-partition pigeonhole.  Sizes fall into bands; a band's scheme hashes
the universe of shingles into m segments, a quarter more than H + 1, where H is
the largest symmetric difference that two sets of its sizes may have and still
be linked.

Allocation by cost, in two steps, for a set x whose partners differ from it by
at most H(x).  Segments with few shingles are the likeliest to be shared by
chance, so x indexes its H(x) + 1 + r fullest segments only, with r an eighth of
H.  Then segments are counted, and of these x leaves out the r that most sets
share.  Linked sets agree on m - H(x) segments or more.  Both keep a prefix of
these by fullness, of more than r; and of that prefix the rarest is left out by
neither, as all of it would have to be left out with it.  A set whose segments
but for r are its own is linked with nothing and leaves here.

In a bucket every class is compared with the smallest first, and only classes
that this leaves in different components with each other.  Where these are
more than such a comparison takes, a few further classes, drawn by hash, are
compared with all, as long as that halves what is left.  What remains
costly is split by one-deletion neighbourhoods: of H // 2 + 1 segments of the
universe, linked sets have one in which they differ by one shingle at most, so
both emit each of these segments whole and less one shingle, and meet there.
All candidates are verified on the exact sets.

Copies (equal sets) are one class from the start.  A parity sketch of each set
bounds the difference of two sets from below, so pairs that are not linked
hardly ever need their sets.  Components are exact, whatever the group sizes:
no bucket, partner or row is capped.

Classes are 64-bit fingerprints of sets of 64-bit shingle hashes.  Null, empty
and word-less texts have no shingles, no links, and are their own component.
A text of fewer words than a shingle is one shingle; very long texts have more
segments in proportion.  A row's component is that of its text, also where rows
share an id; a null id orders after all others.  Empty tables give no rows;
other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables, _text
from codeloom.llm._features import keyed
from codeloom.llm._text import mix

#: Ratio of a band's sizes; segments beyond H + 1, and indexed ones that may be left out, as shares of H.
BAND, SPARE, RESERVE = 1.6, 4, 8
#: Classes of a costly bucket that are compared with all others in a round.
PIVOTS = 4
#: Comparisons that cost as much as a row of a one-deletion neighbourhood.
NEIGHBOUR = 4
#: 64-bit words of a parity sketch.
SKETCH = 32
ODD = [f"o{k}" for k in range(SKETCH)]
#: Classes a task remembers so as not to send a copy's signatures again (only to save work).
REMEMBERED = 1 << 20
#: Schemes that a key can tell apart; 64 bands of ratio 1.6 reach beyond 10**12 shingles.
SCHEMES = 64


def bands(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends of size bands, segments, largest differences H) for similarity num/den, for sizes up to top."""
    ends, segments, most = [1], [], []
    while ends[-1] <= top:
        b = ends[-1]
        end = max(b * den // num + 1, int(b * BAND))
        small = end - 1
        h = (small + small * den // num) * (den - num) // (den + num)
        ends.append(end)
        # Without a difference only equal sets are linked, and those are one class.
        segments.append(h + 2 + h // SPARE if h else 1)
        most.append(h)
    if len(segments) > SCHEMES:
        raise ValueError(f"sets of {top} shingles need more than {SCHEMES} bands")
    return np.array(ends), np.array(segments), np.array(most)


class Sets:
    """The distinct shingles of each document of a slice, ordered by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int) -> None:
        docs = len(offsets) - 1
        w = _text.words(data, offsets, _text.SPACE, lower=True)
        at, h = w.grams(n)
        doc = w.doc[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < n))
        if len(short):
            h = np.concatenate([h, np.array([_text.roll(w.hashes[0][w.of[d] : w.of[d + 1]], int(w.counts[d]))[0] for d in short], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)])
            doc = np.concatenate([doc, short])
        key = keyed(doc, h, docs)
        order = np.argsort(key, kind="stable")
        key, h, doc = key[order], h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        self.h, self.doc = h[new], doc[new]
        self.of = np.searchsorted(self.doc, np.arange(docs + 1))
        self.size = np.diff(self.of)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.h))])
        self.cls = mix(total[self.of[1:]] - total[self.of[:-1]] + self.size.astype(np.uint64)).view(np.int64)


def _segments(sets: Sets, which: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in which, number, content hash, shingles) of every segment of the chosen documents, cut into m segments each."""
    first = np.concatenate([[0], np.cumsum(m)])
    size = sets.size[which]
    row = np.repeat(np.arange(len(which)), size)
    element = np.repeat(sets.of[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    h = sets.h[element]
    place = first[row] + ((h >> np.uint64(20)) % m[row].astype(np.uint64)).astype(np.int64)
    content = np.zeros(first[-1], np.uint64)
    np.add.at(content, place, mix(h ^ np.uint64(0xA0761D6478BD642F)))
    owner = np.repeat(np.arange(len(which)), m)
    return owner, np.arange(first[-1]) - first[owner], content, np.bincount(place, minlength=first[-1])


def _key(content: np.ndarray, number: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    k = mix(content + mix(number.astype(np.uint64) + (scheme.astype(np.uint64) << np.uint64(40))))
    return ((k & ~np.uint64(SCHEMES - 1)) | scheme.astype(np.uint64)).view(np.int64)


def _schemes(size: np.ndarray, ends: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, scheme, H of the document there): a document takes its own band's scheme, and the one below if it has a partner there."""
    has = np.flatnonzero(size > 0)
    own = np.searchsorted(ends, size[has], "right") - 1
    below = (own > 0) & ((ends[own] - 1) * den >= size[has] * num)
    partner = np.concatenate([size[has] * den // num, ends[own[below]] - 1])
    doc = np.concatenate([has, has[below]])
    return doc, np.concatenate([own, own[below] - 1]), (size[doc] + partner) * (den - num) // (den + num)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_tables.NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def prints(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, cls, keys) of every row: keys are the hashes of the fullest segments under the scheme of the own band and of the one below.

    A copy that a task meets again has no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch, "text"):
                s = Sets(data, offsets, n)
                ends, m, top = bands(num, den, int(s.size.max(initial=1)))
                doc, scheme, most = _schemes(s.size, ends, num, den)
                new = np.array([c not in seen for c in s.cls.tolist()], bool)
                new &= np.isin(np.arange(len(s.cls)), np.unique(s.cls, return_index=True)[1])
                if len(seen) < REMEMBERED:
                    seen.update(s.cls.tolist())
                use = new[doc] & (m[scheme] > 1)
                doc, scheme, most = doc[use], scheme[use], most[use]
                owner, number, content, held = _segments(s, doc, m[scheme])
                # The fullest first; of equally full ones by content, so that sets that agree on segments agree on their order.
                order = np.lexsort([number, mix(content + number.astype(np.uint64)), -held, owner])
                first = np.concatenate([[0], np.cumsum(m[scheme])])
                rank = np.arange(len(order)) - first[owner[order]]
                kept = order[rank < (most + 1 + top[scheme] // RESERVE)[owner[order]]]
                of, key = doc[owner[kept]], _key(content[kept], number[kept], scheme[owner[kept]])
                by_doc = np.argsort(of, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[by_doc], np.arange(b - a + 1)).astype(np.int32)), pa.array(key[by_doc]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(s.size.astype(np.int64)), pa.array(s.cls), lists], ["doc_id", "n_shingles", "cls", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, cls long, keys array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(cls, size, o0.., shingles) of every row; o0.. hold a parity sketch, a bit for each of 64 * SKETCH buckets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.slices(batch, "text"):
                s = Sets(data, offsets, n)
                bits = np.zeros((b - a) * 64 * SKETCH, np.uint8)
                np.add.at(bits, s.doc * (64 * SKETCH) + (mix(s.h ^ np.uint64(0x94D049BB133111EB)) % np.uint64(64 * SKETCH)).astype(np.int64), 1)
                odd = np.packbits(bits.reshape(b - a, -1) & 1, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(s.of.astype(np.int32)), pa.array(s.h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.cls), pa.array(s.size.astype(np.int32)), *(pa.array(odd[:, k]) for k in range(SKETCH)), lists], ["cls", "size", *ODD, "shingles"])

    return docs.select("text").mapInArrow(run, "cls long, size int, " + ", ".join(f"{o} long" for o in ODD) + ", shingles array<long>")


def _close(x: str, y: str, num: int, den: int) -> Column:
    """Whether two sets may be linked, by size and parity sketch.

    A shingle that only one of them has flips one bit, so the bits that differ are at most as many as such shingles.
    """
    flipped = sum((F.bit_count(F.col(f"{x}.{o}").bitwiseXOR(F.col(f"{y}.{o}"))) for o in ODD), F.lit(0))
    return flipped * (num + den) <= (F.col(f"{x}.size") + F.col(f"{y}.size")) * (den - num)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough: by their sketches first, then by their exact sets."""
    sketch = sets.select("cls", "size", *ODD)
    x, y = (sketch.select(F.col("cls").alias(c), F.struct("size", *ODD).alias(t)) for c, t in (("a", "x"), ("b", "y")))
    pairs = pairs.join(y, "b").join(x, "a").where(_close("x", "y", num, den)).select("a", "b")
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("same", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("same") * F.lit(den) >= F.lit(num) * (F.size("sa") + F.size("sb") - F.col("same"))).select("a", "b")


def _neighbours(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, variant, whole, cls, comp) of members(key, cls, comp): segments, and segments less one shingle, of H // 2 + 1 segments of each set.

    Two linked sets differ in H shingles at most, so one of these segments differs by one shingle at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, cls, comp, shingles in zip(*(batch.column(k) for k in range(4)), strict=True):
                h = np.array(shingles.values, np.int64).view(np.uint64)
                _, _, most = bands(num, den, len(h) * den // num + 1)
                m = int(most[key.as_py() & (SCHEMES - 1)]) // 2 + 1
                # Other bits than those of the index: what meets in a bucket has no segment in common here for that.
                part = ((mix(h) >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
                mixed = mix(h ^ np.uint64(0xA0761D6478BD642F))
                content = np.zeros(m, np.uint64)
                np.add.at(content, part, mixed)
                number = mix(np.arange(m).astype(np.uint64))
                variant = np.concatenate([mix(content + number), mix(content[part] - mixed + number[part])])
                rows = len(variant)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, key.as_py())), pa.array(variant.view(np.int64)), pa.array(np.arange(rows) < m), pa.array(np.full(rows, cls.as_py())), pa.array(np.full(rows, comp.as_py()))], ["key", "variant", "whole", "cls", "comp"])

    return members.join(sets, "cls").select("key", "cls", "comp", "shingles").mapInArrow(run, "key long, variant long, whole boolean, cls long, comp long")


def buckets(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(key, low, cls): the indexed segments of each class of prints(cls, keys) that another class shares.

    The plan is the same at every size: both exchanges move a key and at most a
    class for each segment.
    """
    rows = rows.where(F.size("keys") > 0).select("cls", F.explode("keys").alias("key"))
    # Copies from several tasks count as sharers here; they are told apart below.
    shared = _tables.stored(rows.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1"))
    members = rows.join(shared.hint("merge"), "key").select("cls", F.col("key").bitwiseAND(SCHEMES - 1).alias("scheme"), F.struct("n", "key").alias("segment"))
    _, _, most = bands(num, den, 10**9)
    reserve = F.element_at(F.array(*[F.lit(int(h) // RESERVE) for h in most]), (F.col("scheme") + 1).cast("int"))
    # The costliest segments that a class may leave out are left out.
    segments = F.sort_array(F.collect_set("segment"), asc=False)
    kept = members.groupBy("cls", "scheme").agg(segments.alias("segments")).withColumn("spare", reserve).where(F.size("segments") > F.col("spare"))
    left = _tables.stored(kept.select("cls", F.explode(F.slice("segments", F.col("spare") + 1, F.size("segments") - F.col("spare"))).alias("segment")).select("segment.key", "cls"))
    _tables.dropped(shared)
    low = left.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("key", "low")
    out = _tables.stored(left.join(low, "key").select("key", "low", "cls"))
    _tables.dropped(left)
    return out


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp(cls, comp) after links(a, b) between classes, stored."""
    of = lambda c: comp.select(F.col("cls").alias(c), F.col("comp").alias(f"c{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = _tables.stored(_tables.components(ends))
    every = comp.unionByName(joined.select(F.col("id").alias("cls"), F.col("id").alias("comp")).join(comp.select("cls"), "cls", "left_anti"))
    return _tables.stored(every.join(joined, every.comp == joined.id, "left").select("cls", F.coalesce("component", "comp").alias("comp")))


def _open(members: DataFrame, comp: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, cls, comp, left, many, costly) of members(key, cls) in buckets with several components; left are the pairs across them.

    many: more than a round of pivots compares; costly: more than the rows of one-deletion neighbourhoods.
    """
    rows = members.join(comp, "cls", "left").join(sizes, "cls").select("key", "cls", F.coalesce("comp", "cls").alias("comp"), "size")
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows"))
    whole = parts.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("left"), F.sum("rows").alias("rows"), F.sum("n").alias("n")).where("left > 0")
    return _tables.stored(rows.drop("size").join(whole.select("key", "left", (F.col("left") > F.col("n") * PIVOTS).alias("many"), (F.col("left") > F.col("rows") * NEIGHBOUR).alias("costly")), "key"))


def unconnected(rest: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): candidates among rest(key, cls, comp, costly), classes of one bucket in different components."""
    sketched = lambda rows: rows.join(sets.select("cls", "size", *ODD), "cls")
    pair = lambda x, on, but: x.alias("x").join(x.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on] + [F.col("x.comp") != F.col("y.comp"), but, _close("x", "y", num, den)]).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    rest = rest.select("key", "cls", "comp", "costly")
    plain = pair(sketched(rest.where("not costly").drop("costly")), ["key"], F.expr("x.cls < y.cls"))
    near = pair(sketched(_neighbours(rest.where("costly").drop("costly"), sets, num, den)), ["key", "variant"], F.expr("(x.whole or y.whole) and x.cls <> y.cls"))
    return plain.unionByName(near).distinct()


def class_components(docs: DataFrame, n: int, num: int, den: int, rows: DataFrame) -> DataFrame:
    """(cls, comp): the component of every class of docs that has a link; rows is prints(docs)."""
    members = buckets(rows, num, den)
    # Exact sets of the classes that share an indexed segment with another.
    chosen = members.select("cls").distinct()
    first = _tables.stored(rows.select("doc_id", "cls").join(chosen, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
    some = _tables.small(first.select("doc_id").distinct(), first)
    sets = _sets(_texts(docs).join(some, "doc_id", "left_semi"), n).join(first.select("cls"), "cls", "left_semi")
    sets = _tables.stored(sets.dropDuplicates(["cls"]))
    _tables.dropped(first)
    star = members.where("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b")).distinct()
    found = _tables.stored(verified(star, sets, num, den))
    comp = _tables.stored(_tables.components(found).select(F.col("id").alias("cls"), F.col("component").alias("comp")))
    # Classes of one bucket that are not connected yet, but for the smallest one, which has been compared with all.
    rest = members.where("cls <> low").select("key", "cls")
    sizes = sets.select("cls", "size")
    open_ = _open(rest, comp, sizes)
    costs = lambda: float(open_.where("many").agg(F.coalesce(F.sum("left"), F.lit(0.0))).first()[0])
    now, turn = costs(), 0
    while now:
        costly = open_.where("many").select("key", "cls", "comp")
        sketch = sets.select("cls", "size", *ODD)
        drawn = costly.groupBy("key").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("cls", F.lit(turn * PIVOTS + j)).alias("h"), "cls", "comp")) for j in range(PIVOTS)])).alias("pivots"))
        drawn = drawn.select("key", F.explode("pivots").alias("p")).select("key", F.col("p.cls").alias("a"), F.col("p.comp").alias("ca"))
        # A pivot meets the classes of its bucket that its sketch does not rule out; other pairs are not even made.
        x, y = costly.join(sketch, "cls").alias("x"), drawn.join(sketch.withColumnRenamed("cls", "a"), "a").alias("y")
        tried = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.ca")) & _close("x", "y", num, den)).select("y.a", F.col("x.cls").alias("b")).distinct()
        comp = _merged(comp, _tables.stored(verified(tried, sets, num, den)))
        open_ = _open(open_.select("key", "cls"), comp, sizes)
        before, now, turn = now, costs(), turn + 1
        if now > before / 2:
            break
    late = _tables.stored(verified(unconnected(open_, sets, num, den), sets, num, den))
    _tables.dropped(members, sets, found, open_)
    return comp if late.isEmpty() else _merged(comp, late)


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles and component_id, the smallest id reachable over links."""
    _tables.bounded_batches(docs.sparkSession)
    rows = _tables.stored(prints(docs, n, num, den))
    ids = _tables.stored(rows.select("doc_id", "n_shingles", "cls"))
    low = ids.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    low = _tables.stored(low)
    comp = _tables.stored(class_components(docs, n, num, den, rows))
    _tables.dropped(rows)
    top = low.join(comp, "cls")
    top = top.join(top.groupBy("comp").agg(F.min("rep").alias("component")), "comp")
    ids = ids.join(low, "cls", "left").join(top.select("cls", "component"), "cls", "left")
    ids = ids.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component"))
    back = lambda c: F.when(F.col(c) != _tables.NO_ID, F.col(c))
    return ids.select(back("doc_id").alias("doc_id"), "n_shingles", back("component").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, less those whose component has a smaller id.

    Of rows that share both id and text one stays.  Rows without an id cannot be told apart and stay.
    """
    joined = _tables.stored(ngram_join(docs, n, num, den))
    gone = _tables.stored(joined.where("component_id <> doc_id").select("doc_id").distinct())
    left = docs.join(_tables.small(gone), "doc_id", "left_anti")
    again = _tables.stored(joined.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    some = _tables.small(again)
    return left.join(some, "doc_id", "left_anti").unionByName(left.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
