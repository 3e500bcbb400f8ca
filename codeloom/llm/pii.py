"""Personal data: pattern spans, and terms that give protected entities away, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found
by linear-time forms of their patterns and checked (parts, Luhn, digits).

Every value found is a protected entity, and so is every opaque string: 16
letters and digits or more, with some of both, as keys and tokens are.  Opaque
strings are spans of kind `term` themselves.  A term gives an entity away as far
as knowing it leaves little to be known.  Of the entity's information content
log2(N / c(e)), pointwise mutual information log2(N * c(t, e) / (c(t) * c(e)))
is what the term tells; with one more text that holds the term alone, so that a
few co-occurrences don't look like certainty, there remain
    log2((c(t) + 1) / c(t, e)) bits,
whatever the number N of texts.  c(t) and c(e) are the different texts that hold
the term or the entity, c(t, e) those in which the term stands within REACH
characters of the entity.  Terms are words of three letters or more.  They need
SUPPORT such texts at least, and to stand there between different words: at
least SUPPORT pairs of a word before and a word after, and half as many as
texts.  So what near copies of one text share is one occurrence, not
many.  If REMOVE bits or fewer remain, all occurrences of the term in texts with
the entity are spans of kind `term` and become [TERM] in the sanitised text; up
to GENERALISE bits they are spans of kind `broad` and become the name of their
class: [NAME] with a capital, else [WORD].  Other terms are left.

Counting starts from the words beside entities: a term that already stands there
in too many texts is out, and only what is left is looked for in all texts.

All counts are over all documents, each different text once.  Null and empty
texts have no spans, and an empty table gives no rows.  Very long texts are
searched whole; positions are summed in blocks.  Equal starts are ordered by
kind as listed.  Results depend on the text alone, so repeated rows and rows
that share an id get those of their text; a null id is kept as null.  Other
columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _tables

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
#: A match starts where a run of its first class starts, or where the match before ended; possessive runs never backtrack.
#: Of cards, runs of too few digits, which would fail the check, are not even matched.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
REACH, SUPPORT, REMOVE, GENERALISE = 64, 2, 0.6, 1.0
#: Prefix sums go over blocks of so many matches, so that texts with very many matches don't cost the square.
BLOCK = 256


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digit = lambda k: F.substring(digits, k, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + F.when((n - k) % 2 == 1, doubled(digit(k))).otherwise(digit(k)))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.split(match, r"\.")
        return F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(parts, lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def placed(rows: DataFrame, patterns: dict[str, str], wanted: Callable[[str, Column], Column] = lambda name, m: F.lit(True)) -> DataFrame:
    """rows(.., text) with a column for each name of patterns: array of (start, end, value) of its wanted matches.

    Step by step in columns, as what a lambda refers to is evaluated again for each element: matches, the lengths
    from one match's end to the next one's, their sums by block, and only then places.
    """
    found, step, block = ({k: f"_{name}_{k}" for k in patterns} for name in ("found", "step", "block"))
    out = rows.withColumns({found[k]: F.regexp_extract_all("text", F.lit(patterns[k]), F.lit(0)) for k in patterns})
    none = F.array().cast("array<int>")
    gap = lambda k: F.slice(F.split("text", patterns[k], -1), F.lit(1), F.size(found[k]))
    out = out.withColumns({step[k]: F.when(F.size(found[k]) > 0, F.zip_with(found[k], gap(k), lambda m, g: F.length(m) + F.length(g))).otherwise(none) for k in patterns})
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(step[k]) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(step[k], b * BLOCK + 1, BLOCK)))
    out = out.withColumns({block[k]: F.when(F.size(step[k]) > 0, blocks(k)).otherwise(none) for k in patterns})

    def places(name: str) -> Column:
        def place(x: Column) -> Column:
            k = x["k"]
            end = total(F.slice(block[name], F.lit(1), F.floor(k / BLOCK).cast("int"))) + total(F.slice(step[name], (F.floor(k / BLOCK) * BLOCK).cast("int") + 1, k % BLOCK + 1))
            return F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))

        return F.transform(F.filter(F.transform(found[name], lambda m, k: F.struct(k.alias("k"), m.alias("value"))), lambda x: wanted(name, x["value"])), place)

    return out.withColumns({k: places(k) for k in patterns}).select(*rows.columns, *patterns)


def with_base(rows: DataFrame) -> DataFrame:
    """rows(.., text) with base: array of (start, rank, kind, end, value) by start, then kind as listed."""
    ranked = lambda rank, kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return placed(rows, PATTERNS, valid).withColumn("base", F.array_sort(F.concat(*(ranked(rank, k) for rank, k in enumerate(KINDS))))).select(*rows.columns, "base")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


#: Opaque strings, and words of three letters or more.
_OPAQUE = r"(?<![\p{L}\p{N}])(?=\p{L}*\p{N})(?=\p{N}*\p{L})[\p{L}\p{N}_]{16,}+"
_WORD = r"\p{L}{3,}+"
#: Addresses in letters that the pattern of e-mail does not know; a term in one is removed with the whole of it.
_ADDRESS = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+"
_EXTRA = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _meet(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def remaining(c_t: Column, c_te: Column) -> Column:
    """Bits of the entity's information content that the term leaves."""
    return F.log2((c_t + 1) / c_te)


#: Characters of a piece of text, so that a window is cut from at most three of them, however long the text is.
PIECE = 4096


def _beside(pieces: Column, start: Column, end: Column) -> Column:
    """Words, lower-cased, with the word before and after each, of the REACH characters on either side of a span; words that a window cuts are left out."""

    def cut(at: Column, length: Column) -> Column:
        k = F.floor(at / PIECE).cast("int")
        return F.substring(F.concat_ws("", F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit(""))), (at - k * PIECE + 1).cast("int"), length)

    # One character more on the outer side shows whether the outermost word goes on there.
    first = F.greatest(start - REACH - 1, F.lit(0))
    left, right = cut(first, start - first), cut(end, F.lit(REACH + 1))
    left = F.when(start > REACH, F.regexp_replace(left, r"\A\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) > REACH, F.regexp_replace(right, r"\p{L}+\z", "")).otherwise(right)
    some = lambda t: F.regexp_extract_all(F.lower(t), F.lit(_WORD), F.lit(0))
    near = lambda w, k: F.coalesce(F.get(w, k), F.lit(""))
    told = lambda w: F.transform(w, lambda t, k: F.struct(t.alias("term"), F.xxhash64(near(w, k - 1), near(w, k + 1)).alias("between")))
    return F.concat(told(some(left)), told(some(right)))


def revealing(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(text_key, extra): opaque strings and revealing terms of texts with entities, for rows(text) with spans(text_key, text, base)."""
    # Written before lambdas refer to it, as they would evaluate the patterns again for each element.
    once = spans.where(F.col("text").isNotNull()).dropDuplicates(["text_key"]).withColumn("pieces", F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % PIECE), F.lit(0)))
    held = _tables.stored(placed(once.select("text_key", "base", "pieces", "text"), {"address": _ADDRESS, "opaque": _OPAQUE}))
    inside = lambda x, y: F.exists(y, lambda s: _meet(x, s))
    # An address that is no base span is removed with the whole of it.
    every = held.withColumn("address", F.filter("address", lambda a: ~inside(a, "base"))).withColumn("opaque", F.filter("opaque", lambda o: ~inside(o, "base")))
    wide = lambda t: F.coalesce(F.get(F.filter("address", lambda a: _meet(t, a)), F.lit(0)), t)
    values = F.transform("base", lambda s: F.struct(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))
    secrets = F.transform("opaque", lambda s: F.struct(F.concat(F.lit("opaque:"), s["value"]).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))
    near = F.transform(F.concat(values, secrets), lambda e: F.struct(e["entity"].alias("entity"), _beside(F.col("pieces"), e["start"], e["end"]).alias("words")))
    at = _tables.stored(every.select("text_key", F.explode(near).alias("e")).select("text_key", "e.*"))
    beside = at.select("text_key", "entity", F.explode("words").alias("w")).select("text_key", "entity", "w.*")
    holders = at.select("text_key", "entity").distinct()
    shared = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e")).where(F.col("c_e") >= SUPPORT).select("entity")
    told = beside.join(shared, "entity").groupBy("term", "entity").agg(F.count_distinct("text_key").alias("c_te"), F.count_distinct("between").alias("contexts")).where((F.col("c_te") >= SUPPORT) & (F.col("contexts") >= SUPPORT) & (F.col("contexts") * 2 >= F.col("c_te")))
    # A term is in at least as many texts as it stands in beside any entity.
    least = beside.select("term", "text_key").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    told = _tables.stored(told.join(least, "term").where(remaining(F.col("least"), F.col("c_te")) <= GENERALISE).select("term", "entity", "c_te"))
    asked = _tables.stored(told.select("term").distinct())
    own = every.select("text_key", F.explode(F.array_distinct(F.transform("opaque", wide))).alias("at")).select("text_key", _span(F.col("at"), "term", "code").alias("span"))
    each, left = own, [held, at, told, asked]
    if not asked.isEmpty():
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
        c_t = rows.select(F.md5("text").alias("text_key"), F.explode(words).alias("term")).join(_tables.small(asked), "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
        sure = _tables.stored(told.join(c_t, "term").withColumn("bits", remaining(F.col("c_t"), F.col("c_te"))).where(F.col("bits") <= GENERALISE).select("term", "entity", "bits"))
        # The places of these terms in the texts that hold the entity.
        marks = _tables.stored(sure.join(holders, "entity").groupBy("text_key", "term").agg(F.min("bits").alias("bits")))
        texts = every.join(_tables.small(marks.select("text_key").distinct(), marks), "text_key", "left_semi").select("text_key", "address", F.array_join("pieces", "").alias("text"))
        found = _tables.stored(placed(texts, {"word": _WORD}).drop("text"))
        found = found.select("text_key", F.explode(F.transform("word", lambda t: F.struct(wide(t).alias("at"), F.lower(t["value"]).alias("term")))).alias("t")).select("text_key", "t.*").join(marks, ["text_key", "term"])
        each = each.unionByName(found.select("text_key", F.when(F.col("bits") <= REMOVE, _span(F.col("at"), "term", "word")).otherwise(_span(F.col("at"), "broad", "word")).alias("span")))
        left += [sure, marks]
    # Of one place the stronger kind.
    each = each.groupBy("text_key", "span.start", "span.end").agg(F.min("span").alias("span"))
    out = _tables.stored(each.groupBy("text_key").agg(F.array_sort(F.collect_list("span")).cast(_EXTRA).alias("extra")))
    _tables.dropped(*left)
    return out


def _span(at: Column, kind: str, value: str) -> Column:
    return F.struct(at["start"].alias("start"), F.lit(len(KINDS) + (kind == "broad")).alias("rank"), F.lit(kind).alias("kind"), at["end"].alias("end"), F.lit(value).alias("value"))


def find(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): counts and digest of base spans, all spans, and with_text the sanitised text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_tables.NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Written once: base spans, and the texts that have some or an opaque string.  128 bits stand for a text.
    marked = (F.size("base") > 0) | F.rlike("text", F.lit(_OPAQUE))
    spans = _tables.stored(with_base(rows).select("doc_id", F.md5("text").alias("text_key"), "base", marked.alias("marked"), F.when(marked | F.lit(with_text), F.col("text")).alias("text")))
    extra = revealing(rows, spans.where("marked"))
    out = spans.join(_tables.small(extra), "text_key", "left")
    none = F.array().cast(_EXTRA)
    # A term inside a base span is part of it.
    outside = F.filter(F.coalesce("extra", none), lambda t: ~F.exists("base", lambda s: _meet(t, s)))
    every = F.array_sort(F.concat("base", outside))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    columns = [F.when(F.col("doc_id") != _tables.NO_ID, F.col("doc_id")).alias("doc_id"), *(count(k) for k in KINDS), F.size(outside).cast("long").alias("n_term"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans")]
    if with_text:
        # Overlapping spans are blanked from the last one's start on; what overlaps is left to the earlier span.
        pieces = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.when(s["kind"] != "broad", F.upper(s["kind"])).when(s["value"] == "code", "CODE").when(F.rlike(F.substring(F.col("text"), s["start"] + 1, F.lit(1)), F.lit(r"\p{Lu}")), "NAME").otherwise("WORD"), F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))
        columns.append(F.concat(pieces["out"], F.substring(F.col("text"), pieces["at"] + 1, F.length("text"))).alias("sanitised"))
    return out.select(*columns)
