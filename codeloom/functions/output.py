"""Records for people and programs: edges, nodes, trees and per-command records as lines, values shaped for JSON, options and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X


def round_float(x: Column, decimals: int = 2) -> Column:
    """To so many decimals, halves upwards."""
    return F.floor(x * 10**decimals + 0.5) / 10**decimals


def json_without_nulls(**fields: Column) -> Column:
    """A JSON object of the fields that are not null, in their order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def compact_tree(rows: DataFrame) -> DataFrame:
    """(id, json) of tree nodes rows(id, name, kind, relation, path, cycle, resolved): without ids, and with flags only where they say something."""
    return rows.select("id", json_without_nulls(name=F.col("name"), kind=F.col("kind"), rel=F.col("relation"), path=F.col("path"), cycle=F.when(F.col("cycle"), True), resolved=F.when(~F.col("resolved"), False)).alias("json"))


def _resolved() -> Column:
    return (F.coalesce("name", F.lit("")) != "") & ~X.raw_id(F.coalesce("name", F.lit("")))


def edge_records(found: DataFrame, relation: str, targets: DataFrame) -> DataFrame:
    """(target, seq, line): for each of targets(target) a header with totals and a record per neighbour found(target, id, name, kind, path).

    A neighbour whose name is missing or is an id is unresolved; a target without
    neighbours gets a diagnostic.
    """
    rows = found.withColumn("resolved", _resolved())
    counts = rows.groupBy("target").agg(F.count(F.lit(1)).alias("total"), F.count_if("resolved").alias("known"))
    heads = targets.select("target").distinct().join(counts, "target", "left").fillna(0, ["total", "known"])
    head = heads.select("target", F.lit(0).alias("seq"), X.llm_line(relation, target=F.col("target"), total=F.col("total"), resolved=F.col("known"), unresolved=F.when(F.col("total") > F.col("known"), F.col("total") - F.col("known"))).alias("line"))
    none = heads.where("total = 0").select("target", F.lit(1).alias("seq"), X.llm_line("diagnostic", code=F.lit("no_edges"), message=F.lit(f"No {relation} edges found.")).alias("line"))
    placed = rows.withColumn("seq", F.row_number().over(Window.partitionBy("target").orderBy("name", "id")))
    known = X.llm_line("ref", name=F.col("name"), kind=F.col("kind"), id=F.substring("id", 1, 8), path=F.col("path"))
    unknown = X.llm_line("ref", kind=F.col("kind"), id=F.substring("id", 1, 8), resolved=F.lit("false"))
    return head.unionByName(none).unionByName(placed.select("target", "seq", F.when(F.col("resolved"), known).otherwise(unknown).alias("line")))


def edge_json(found: DataFrame, relation: str) -> DataFrame:
    """(target, json): results of found(target, id, name, kind, path) with diagnostics and a summary, one object a target."""
    ok = _resolved()
    ref = F.struct(F.when(ok, F.col("name")).alias("name"), F.col("kind").alias("kind"), F.when(ok, F.col("id")).alias("id"), F.col("path").alias("path"), F.when(~ok, False).alias("resolved"), F.when(~ok, F.col("id")).alias("rawId"))
    rows = found.withColumn("_ok", ok).withColumn("_ref", ref).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "id", "_ref"))), lambda r: r["_ref"]).alias("results"), F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("resolved"))
    lost = F.when(F.col("total") > F.col("resolved"), F.array(F.struct(F.lit("dangling_reference_filtered").alias("code"))))
    summary = F.struct("total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"))
    return rows.select("target", F.to_json(F.struct("results", F.lit("graph").alias("resultSource"), lost.alias("diagnostics"), summary.alias("summary"))).alias("json"))


#: Fields of the records of each kind, in their order; the first column is the record's name.
RECORDS = {
    "node": ("id", "kind", "name", "path"),
    "patch": ("id", "rev", "source", "intent"),
    "intent": ("id", "statement", "status", "parent"),
    "diff": ("change", "id", "name", "kind"),
    "match": ("path", "line", "text"),
    "conflict": ("id", "a", "b", "field"),
    "explain": ("name", "role", "confidence", "importance", "category", "text"),
    "context": ("seed", "kind", "id", "score"),
    "decision": ("id", "title", "rationale", "rev"),
    "bug": ("id", "title", "status", "severity"),
    "located": ("id", "path", "start", "end", "container", "stale"),
    "rank": ("rank", "name", "id", "kind", "score"),
    "hit": ("name", "kind", "id", "path", "weight"),
    "depends": ("name", "kind", "rel", "parent", "depth", "cycle"),
    "trace": ("name", "kind", "rel", "parent", "depth"),
    "region": ("label", "kind", "level", "files", "confidence", "parent"),
    "smell": ("smell", "file", "confidence"),
    "entry": ("kind", "name", "path"),
    "history": ("rev", "patch", "op"),
    "entity": ("id", "kind", "name", "claims", "edges"),
}


def records(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    """(keys.., line): each row as a record of a kind: those of its fields that the rows have and that are neither null nor empty."""
    fields = {c: F.col(c) for c in RECORDS[kind] if c in rows.columns}
    return rows.select(*keys, X.llm_line(kind, **fields).alias("line"))


def as_json(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    """(keys.., json): each row as an object with the fields of its kind, without nulls."""
    return rows.select(*keys, json_without_nulls(**{c: F.col(c) for c in RECORDS[kind] if c in rows.columns}).alias("json"))


def as_text(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    """(keys.., line): each row as its fields' values in columns, for reading."""
    return rows.select(*keys, F.concat_ws("  ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 12, " ") for c in RECORDS[kind] if c in rows.columns]).alias("line"))


def option_number(value: Column, example: str = "12") -> Column:
    """struct(value, error): a whole number from 1 on, as picks, budgets and revisions must be; anything else is refused, not repaired."""
    ok = F.rlike(F.trim(value), F.lit(r"^[0-9]+$")) & (F.length(F.regexp_replace(F.trim(value), "^0+", "")) <= 15)
    number = F.when(ok, F.trim(value).try_cast("long"))
    good = F.coalesce(number >= 1, F.lit(False))
    return F.struct(F.when(good, number).alias("value"), F.when(~good, F.concat(F.lit("expected a positive whole number such as "), F.lit(example), F.lit(", not "), F.coalesce(value, F.lit("nothing")))).alias("error"))


#: Codes of errors by the status of an answer, and whether trying again may help.
STATUS = [(400, "bad_request", False), (401, "unauthorized", False), (403, "forbidden", False), (404, "not_found", False), (409, "conflict", True), (413, "too_large", False), (422, "invalid", False), (429, "rate_limited", True), (500, "server_error", True), (502, "unavailable", True), (503, "unavailable", True), (504, "timeout", True)]


def parse_error(text: Column) -> Column:
    """struct(status, code, message, retry) of an error: a status in front, a JSON body with code and message, a broken connection, or a plain text."""
    status = F.regexp_extract(text, r"^\s*(\d{3})\b", 1).try_cast("int")
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    code = F.coalesce(F.get_json_object(body, "$.code"), F.get_json_object(body, "$.error.code"))
    message = F.coalesce(F.get_json_object(body, "$.message"), F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.error"))
    broken = F.rlike(text, F.lit("(?i)ECONNREFUSED|fetch failed|connection refused"))
    late = F.rlike(text, F.lit("(?i)ETIMEDOUT|timed? ?out|aborted"))
    known, again = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for number, name, retry in STATUS:
        known = F.when(status == number, name).otherwise(known)
        again = F.when(status == number, F.lit(retry)).otherwise(again)
    out = F.coalesce(code, known, F.when(broken, "unreachable").when(late, "timeout").otherwise("error"))
    plain = F.trim(F.regexp_replace(text, r"^\s*\d{3}\s*:?\s*", ""))
    return F.struct(status.alias("status"), out.alias("code"), F.coalesce(message, plain).alias("message"), F.coalesce(again, broken | late).alias("retry"))


def error_record(text: Column) -> Column:
    e = parse_error(text)
    return X.llm_line("error", code=e["code"], message=e["message"], status=e["status"], retry=F.when(e["retry"], "true"))
