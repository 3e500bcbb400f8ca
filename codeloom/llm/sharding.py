"""Rendezvous hashing of stable record keys over weighted shards.

A record's score for a shard of weight w is w / -ln(u), u in (0, 1) from 52 bits
of md5(`<key>:<shard>`); the record goes to the shard with the highest score
(of equal ones the lower number).  A shard gets records in proportion to its
weight.  The score for a shard does not know of the others, so one more shard
takes records only into itself, a removed one gives only its own away, and a
larger weight only draws records in.  Nothing is stored or looked up.

Law `key`: the key and the weights decide.  Rows of one key share a shard,
however many they are; a null key is one key, the text `null`.

Slots number a shard's rows from 0 by key, checksum and size of the text.  The
narrow rows are written, dealt by ranges of that order and written again with
the number of their range; a range's first slot is the sum of the counts
before it.  A random number per row, written before it is used, ends the order,
so that ranges also cut through a key that repeats; it decides between rows
that are equal in all that is returned, and nothing else.

Null texts have size 1 and the checksum of no bytes, like empty ones; very long
texts are only measured.  Repeated rows have slots of their own.  An empty table
gives no rows.  Other columns are not read by `shards`, and kept by `write`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import _tables

BITS = 52


def scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, -shard) of a key's shards."""
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, BITS // 4), 16, 10).cast("double")
        # With equal weights the order of the bits is that of the scores, without their rounding.
        value = bits if len(set(weights)) == 1 else F.lit(float(weight)) / -F.log((bits + 0.5) / float(1 << BITS))
        return F.struct(value.alias("score"), F.lit(-shard).alias("shard"))

    return F.array(*(score(s, w) for s, w in enumerate(weights)))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return -F.array_max(scores(key, weights))["shard"]


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs(key, text): size, checksum, shard, slot in it, and the shard with one more of weight `added`."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), [*weights, added]).alias("grown_shard"), F.rand(1).alias("salt"))
    narrow = _tables.stored(rows)
    order = [F.col("key").asc_nulls_last(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("salt").asc()]
    ranged = _tables.stored(narrow.repartitionByRange(F.col("shard").asc(), *order).withColumn("range", F.spark_partition_id()))
    _tables.dropped(narrow)
    # A row for each range and shard that meet: at most the number of ranges and that of shards together.
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "range", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy(*order)) - 1
    out = ranged.join(F.broadcast(starts), ["shard", "range"]).withColumn("slot", F.col("start") + within)
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id", files: int = 16) -> None:
    """All columns of docs as Parquet in a folder a shard (column `shard`, which replaces one of docs), each dealt into `files` files whatever keys repeat."""
    rows = docs.withColumn("shard", shard_of(F.col(key), weights))
    rows.withColumn("_file", F.floor(F.rand(1) * files)).repartition(len(weights) * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
