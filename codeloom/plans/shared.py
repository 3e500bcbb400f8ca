"""Fixtures that several modules of queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import graph
from codeloom.operators import revisions as V

OPERATION = "case event_type when 'error' then 'DeleteNode' when 'click' then 'UpsertEdge' when 'purchase' then 'AssertClaim' else 'UpsertNode' end"
LOG_SQL = f"""log as (select row_number() over (order by ts, event_id) as rev, ts, user_id || ':' || coalesce(json_extract_string(props, '$.k'), '') as id, {OPERATION} as op, value from events)"""
SNAPSHOT_SQL = "(select id, value, rev from (select *, row_number() over (partition by id order by rev desc) as rn from log where rev <= {r}) where rn = 1 and op <> 'DeleteNode')"


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a log of operations (rev, ts, id, op, value), numbered by time."""
    rows = graph.table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    out = V.numbered(rows, "o", "rev")
    return out.select("rev", "ts", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("id"), F.expr(OPERATION).alias("op"), "value")
