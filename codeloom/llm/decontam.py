"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Rarity is document frequency, counted over all documents.  The index stores
postings (term, document, position) of the KEYS rarest terms of every
benchmark window.  A window's lists, each moved by the term's offset in the
window, are intersected document by document, from the rarest term on: first
starts at which the others follow at exactly their offsets, or within SLOP
words of them.  Starts that are left are held against the whole window, a chunk
of the text at a time, which gives exact phrases; the others are proximity
matches.

A window that stands in several items is one window.  Windows of fewer
different terms have fewer lists.  Null and empty texts have no words, and are
clean.  Repeated rows have equal results; rows that share an id are told apart
by their text.  A very long text is one list of positions a term.  Without
benchmark or documents nothing is hit, and empty documents give no rows.
Repeated item_ids count once; a null item_id has no name and is left out.  Ties
in frequency are broken by the term.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables

KEYS, SLOP = 3, 4


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, split at every ASCII character that is neither letter nor digit."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(win, terms, items): distinct windows; an item with fewer words is one window."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    rows = items.select("item", F.explode(F.transform(starts, lambda k: F.slice("w", k, length))).alias("terms"))
    rows = rows.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select(F.xxhash64("terms").alias("win"), "terms", "items")


def key_terms(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(win, keys): array of (term, offset) of the KEYS rarest terms of each window, rarest first; windows with a term that no document has are gone."""
    terms = wins.select("win", F.posexplode("terms").alias("offset", "term"))
    wanted = _tables.stored(terms.select("term").distinct())
    held = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counts = _tables.stored(held.join(_tables.small(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    # One place of a term in a window is enough.
    first = terms.groupBy("win", "term").agg(F.min("offset").alias("offset")).join(counts, "term", "left")
    ranked = first.groupBy("win").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term", "offset"))), 1, KEYS).alias("keys"), F.min(F.col("df").isNotNull()).alias("known"))
    out = _tables.stored(ranked.where("known").select("win", F.transform("keys", lambda k: F.struct(k["term"].alias("term"), k["offset"].alias("offset"))).alias("keys")))
    _tables.dropped(wanted, counts)
    return out


#: Positions of a block: lists meet by document, term and block, so that a term that is frequent in a long text is many keys.
BLOCK = 16


def postings(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(term, doc_id, text_key, pos) of all terms of keys(win, keys) in docs(doc_id, text_key, text), terms as their hashes."""
    terms = _tables.stored(keys.select(F.explode("keys.term").alias("term")).distinct())
    held = docs.select("doc_id", "text_key", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(_tables.small(terms), "term")
    # Rows that share id and text have one list.
    return _tables.stored(held.select(F.xxhash64("term").alias("term"), "doc_id", "text_key", "pos"))


def intersected(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(win, doc_id, text_key, start): starts of windows whose key terms all stand in their places, or within SLOP of them."""
    place = ["doc_id", "text_key"]
    key = lambda k: F.get("keys", F.lit(k))
    wide = keys.select("win", *(x for k in range(KEYS) for x in (F.when(key(k).isNotNull(), F.xxhash64(key(k)["term"])).alias(f"t{k}"), key(k)["offset"].alias(f"o{k}"))))
    wide = _tables.stored(wide.withColumn("term", F.col("t0")))
    out = index.join(_tables.small(wide), "term").select(*place, "win", (F.col("pos") - F.col("o0")).alias("start"), *(f"{c}{k}" for k in range(1, KEYS) for c in "to")).distinct()
    block = lambda c: F.floor(c / BLOCK)
    other = index.select(*place, "term", "pos", block(F.col("pos")).alias("block"))
    for k in range(1, KEYS):
        at = F.col("start") + F.col(f"o{k}")
        asked = out.where(F.col(f"t{k}").isNotNull()).withColumn("term", F.col(f"t{k}")).withColumn("at", at).withColumn("block", F.explode(F.sequence(block(at - SLOP), block(at + SLOP))))
        hits = asked.join(other, [*place, "term", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= SLOP).select(*out.columns).distinct()
        out = hits.unionByName(out.where(F.col(f"t{k}").isNull()))
    return out.select("win", *place, "start")


#: Words of a text that its starts are held against at a time.
CHUNK = 1024


def occurrences(docs: DataFrame, wins: DataFrame, length: int = 10) -> DataFrame:
    """(doc_id, text_key, win, start, length, exact) of docs(doc_id, text_key, text): exact phrase and proximity matches of windows of at most `length` words."""
    place = ["doc_id", "text_key"]
    keys = key_terms(docs, wins)
    index = postings(docs, keys)
    chunk = F.floor(F.greatest("start", F.lit(0)) / CHUNK)
    found = intersected(index, keys).groupBy(*place, chunk.alias("chunk")).agg(F.collect_list(F.struct("win", "start")).alias("found"))
    found = _tables.stored(found)
    _tables.dropped(index, keys)
    # Each text is split once and goes on in chunks, so that no row holds all starts of a text.
    some = docs.join(_tables.small(found.select(*place), found), place, "left_semi").dropDuplicates(place).select(*place, words(F.col("text")).alias("w"))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / CHUNK), F.lit(0)).cast("int")), lambda k: F.slice("w", k * CHUNK + 1, CHUNK + length - 1))
    # Outer forms, as for inner ones a filter on the list would be pushed down, with the words split again.
    some = some.select(*place, F.posexplode_outer(cuts).alias("k", "w")).where("k is not null").withColumn("chunk", F.col("k").cast("long"))
    some = some.join(_tables.small(found), [*place, "chunk"]).select(*place, "chunk", "w", F.explode_outer("found").alias("c")).where("c is not null")
    here = F.slice("w", F.greatest("c.start", F.lit(0)) - F.col("chunk") * CHUNK + 1, length)
    near = some.select(*place, "c.win", "c.start", here.alias("here")).join(_tables.small(wins.select("win", "terms"), wins), "win")
    exact = (F.col("start") >= 0) & (F.slice("here", 1, F.size("terms")) == F.col("terms"))
    return near.select(*place, "win", "start", F.size("terms").alias("length"), exact.alias("exact")).where(F.col("exact") | (F.col("length") > 1))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """One row per row of docs(doc_id, text): words, words inside windows of benchmark items, those items, proximity matches."""
    wins = _tables.stored(windows(benchmark, length))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_tables.NO_ID)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    found = _tables.stored(occurrences(rows, wins, length).dropDuplicates(["doc_id", "text_key", "win", "start"]))
    place = ["doc_id", "text_key"]
    hit = found.where("exact").select(*place, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.where("exact").select(*place, "win").distinct().join(_tables.small(wins.select("win", "items"), wins), "win").select(*place, F.explode("items").alias("item")).groupBy(*place).agg(F.array_sort(F.collect_set("item")).alias("items"))
    # A proximity match counts where its window has no exact one.
    near = found.where("not exact").select(*place, "win").distinct().join(found.where("exact").select(*place, "win").distinct(), [*place, "win"], "left_anti").groupBy(*place).agg(F.count(F.lit(1)).alias("n_near"))
    marks = _tables.stored(hit.join(items, place, "full").join(near, place, "full"))
    _tables.dropped(found, wins)
    n_words = rows.select("doc_id", "text_key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = n_words.join(_tables.small(marks), place, "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.when(F.col("doc_id") != _tables.NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of a benchmark item; rows without an id stay."""
    marked = _tables.stored(decontaminate(docs, benchmark, length).where("contaminated and doc_id is not null").select("doc_id").distinct())
    return docs.join(_tables.small(marked), "doc_id", "left_anti")
