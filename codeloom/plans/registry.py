"""Registration of queries with the same question in SQL, and fixtures stated once for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom import graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_TABLE = re.compile(r"\{([a-z]\w*)\}")


def query(sql: str | None = None, on_graph: bool = False) -> Callable:
    """Register a query under its function's name; on_graph puts nodes and edges before the SQL."""

    def put(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            body = _TABLE.sub(r"\1", sql.strip())
            if on_graph:
                recursive = "recursive " if "--recursive" in body else ""
                body = f"with {recursive}{graph.GRAPH_SQL.strip()}" + (f",\n{body.removeprefix('with ').replace('--recursive', '')}" if body.startswith("with ") else f"\n{body}")
            ORACLE_SQL[f.__name__] = body
        return f

    return put


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A small table stated in SQL over driver tables, which are named in braces."""
    names = set(_TABLE.findall(sql))
    return spark.sql(sql, **{n: graph.table(spark, sf_dir, n) for n in names})
