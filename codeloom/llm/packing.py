"""Best-fit packing of documents into training sequences of a fixed number of words.

Conflict-constrained best fit: a bin takes at most one piece of a source and
one of a cluster of copies.  Open bins are ordered by residual; the bins of a
residual, of a source and of a cluster are bitmaps.  For each piece, longest
first, the successor search goes from the residual of exactly its length
upwards and stops at the tightest bin without a conflict; if no open bin is
free of conflicts it opens a new one at once.

Pieces are dealt by a hash into shards of about SHARD, which are packed on
their own, so no task sees more than that, however large a source or a group of
copies is.  The hash is that of the row's number in the order of id, source,
cluster and length, so neither rows without an id nor rows that repeat one meet
in one shard, and bins do not depend on how the table is laid out: rows that are
equal in all of these are interchangeable.  Bins that a shard leaves with more
than a fiftieth of their room are opened again, and their pieces dealt to fewer
shards, as long as one shard is not enough and bins are more than a fiftieth
above what words, the largest source and the largest cluster need at least, and
as long as a round saves a hundredth of them.

A cluster is the documents whose words are the same but for case and white
space; other clusters, as of near copies, can be given as a column.  Texts
longer than a sequence are cut into pieces; every word is packed.  Null, empty
and word-less texts have nothing to pack and give no row, nor does an empty
table.  A null source is no source and conflicts with nothing.  Repeated rows
are copies and never share a bin.  Of equally tight bins the oldest is taken;
equal pieces are placed by source, cluster and id.  Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables
from codeloom.operators.revisions import numbered

#: Pieces of a shard, and the share of a bin that may stay empty.
SHARD, SLACK = 8192, 0.02


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.residuals: list[int] = []
        self.at: dict[int, int] = {}
        self.of_source: dict[str, int] = {}
        self.of_cluster: dict[int, int] = {}
        self.filled: list[int] = []
        self.open = 0

    def place(self, length: int, source: str | None, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece."""
        blocked = self.of_cluster.get(cluster, 0) | (0 if source is None else self.of_source.get(source, 0))
        chosen = -1
        if self.open & ~blocked:
            for k in range(bisect_left(self.residuals, length), len(self.residuals)):
                if free := self.at[self.residuals[k]] & ~blocked:
                    chosen = (free & -free).bit_length() - 1
                    break
        if chosen < 0:
            chosen = len(self.filled)
            self.filled.append(0)
        else:
            self._take(self.capacity - self.filled[chosen], chosen)
        offset = self.filled[chosen]
        self.filled[chosen] += length
        self._put(self.capacity - self.filled[chosen], chosen)
        bit = 1 << chosen
        if source is not None:
            self.of_source[source] = self.of_source.get(source, 0) | bit
        self.of_cluster[cluster] = self.of_cluster.get(cluster, 0) | bit
        return chosen, offset

    def _put(self, residual: int, number: int) -> None:
        if residual:
            if residual not in self.at:
                insort(self.residuals, residual)
            self.at[residual] = self.at.get(residual, 0) | 1 << number
            self.open |= 1 << number

    def _take(self, residual: int, number: int) -> None:
        left = self.at[residual] & ~(1 << number)
        self.open &= ~(1 << number)
        if left:
            self.at[residual] = left
        else:
            del self.at[residual]
            self.residuals.pop(bisect_left(self.residuals, residual))


SCHEMA = "doc_id long, piece long, bin_id long, bin_offset long, first_word long, n_words long"


def _packed(pieces: DataFrame, capacity: int, shards: int, turn: int) -> DataFrame:
    """pieces(doc_id, piece, first_word, n_words, source, cluster, salt) with bin_id, bin_offset and filled, the words of the bin."""

    def run(table: pa.Table) -> pa.Table:
        bins, at, offset = Bins(capacity), [], []
        rows = table.select(["n_words", "source", "cluster", "doc_id", "piece", "salt"]).to_pylist()
        order = sorted(range(len(rows)), key=lambda k: (-rows[k]["n_words"], rows[k]["source"] or "", rows[k]["cluster"], rows[k]["doc_id"] is None, rows[k]["doc_id"] or 0, rows[k]["piece"], rows[k]["salt"]))
        for k in order:
            b, o = bins.place(rows[k]["n_words"], rows[k]["source"], rows[k]["cluster"])
            at.append(b)
            offset.append(o)
        number = (turn << 58) + (table.column("shard")[0].as_py() << 26)
        table = table.take(pa.array(order, pa.int64())).drop_columns(["shard"])
        for name, values in (("bin_id", [number + b for b in at]), ("bin_offset", offset), ("filled", [bins.filled[b] for b in at])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    columns = "doc_id long, piece long, first_word long, n_words long, source string, cluster long, salt long"
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("salt", "piece", F.lit(turn)), F.lit(shards)))
    return dealt.select(*(c.split()[0] for c in columns.split(", ")), "shard").groupBy("shard").applyInArrow(run, columns + ", bin_id long, bin_offset long, filled long")


def best_fit(docs: DataFrame, capacity: int = 2048, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """One row per piece of docs(doc_id, text, source): its bin, its place there and the words it holds."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), *([F.col(cluster).alias("given")] if cluster else []), words.alias("w"))
    group = F.xxhash64("given") if cluster else F.xxhash64(F.transform("w", lambda w: F.lower(w)))
    narrow = _tables.stored(rows.select("doc_id", "source", group.alias("cluster"), F.size("w").cast("long").alias("n"), F.rand(1).alias("r")).where("n > 0"))
    # Equal rows are dealt out among the ranges of the order by a random number, which decides nothing else.
    numbers = numbered(narrow.withColumn("o", F.struct("doc_id", "source", "cluster", "n", "r")), "o", "number")
    rows = _tables.stored(numbers.select("doc_id", "source", "cluster", "n", F.xxhash64("number").alias("salt"), F.ceil(F.col("n") / capacity).alias("pieces")))
    _tables.dropped(narrow)
    # A document's pieces go to shards of their own, so that one long text does not fill one shard.
    left = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    left = left.withColumn("first_word", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("n") - F.col("first_word")))
    count = int(rows.agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0])
    done, bins, turn = [], None, 0
    while True:
        shards = max(1, count // shard)
        packed = _tables.stored(_packed(left, capacity, shards, turn))
        if turn == 0:
            _tables.dropped(rows)
        loose = F.col("filled") < capacity * (1 - SLACK)
        first = (F.col("bin_offset") == 0).cast("long")
        now = packed.agg(F.count_if(loose).alias("pieces"), F.coalesce(F.sum(F.when(loose, F.col("n_words"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(loose, first)), F.lit(0)).alias("bins"), F.coalesce(F.sum(first), F.lit(0)).alias("all")).first()
        count, turn = int(now.pieces), turn + 1
        if shards == 1 or not count or turn == 16 or (bins is not None and now.all > bins * 0.99):
            done.append(packed)
            break
        least = max([int(now.words) / capacity, *(int(packed.where(loose & F.col(c).isNotNull()).groupBy(c).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]) for c in ("source", "cluster"))])
        if now.bins <= least * (1 + SLACK):
            done.append(packed)
            break
        bins = int(now.bins)
        done.append(packed.where(~loose))
        left = packed.where(loose).drop("bin_id", "bin_offset", "filled")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*(c.split()[0] for c in SCHEMA.split(", ")))
