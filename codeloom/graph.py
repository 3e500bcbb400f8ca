"""The property graph: a star schema as nodes and edges, and the same in SQL.

nodes(id, kind, name, path, role) and edges(src, dst, predicate); edges are
distinct.  Tables are clustered by nothing but their scans: every operator
below filters by kind or predicate first, so the branches of the union that
it does not need are pruned by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.tables import bounded_tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_tasks(spark, *[f"{sf_dir}/{name}.parquet" for name in ("orders", "customer")])
    t = lambda name: table(spark, sf_dir, name)
    production = F.lit("production").alias("role")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "test").when(F.col("c_mktsegment") == "FURNITURE", "fixture").otherwise("production")
    customer_path = F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_name"))
    row = lambda df, key, kind, name, path, role=production: df.select(key.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), role.alias("role"))
    parts = [
        row(t("region"), _key("R", "r_regionkey"), "system", F.col("r_name"), F.lit("")),
        row(t("nation"), _key("N", "n_nationkey"), "subsystem", F.col("n_name"), F.lit("")),
        row(t("customer"), _key("C", "c_custkey"), "file", F.col("c_name"), customer_path, segment),
        row(t("supplier"), _key("S", "s_suppkey"), "file", F.col("s_name"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_name"))),
        row(t("part").select("p_brand").distinct(), _key("B", "p_brand"), "class", F.col("p_brand"), F.concat(F.lit("brand/"), F.col("p_brand"))),
        row(t("part"), _key("P", "p_partkey"), "function", F.col("p_name"), F.concat(F.lit("brand/"), F.col("p_brand"))),
        row(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), _key("O", "o_orderkey"), "method", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), customer_path),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_tasks(spark, *[f"{sf_dir}/{name}.parquet" for name in ("orders", "customer", "lineitem")])
    t = lambda name: table(spark, sf_dir, name)
    row = lambda df, src, dst, predicate: df.select(src.alias("src"), dst.alias("dst"), F.lit(predicate).alias("predicate"))
    lines = t("lineitem")
    unique = [
        row(t("nation"), _key("R", "n_regionkey"), _key("N", "n_nationkey"), "IN_REGION"),
        row(t("customer"), _key("N", "c_nationkey"), _key("C", "c_custkey"), "IN_REGION"),
        row(t("supplier"), _key("N", "s_nationkey"), _key("S", "s_suppkey"), "IN_REGION"),
        row(t("orders"), _key("C", "o_custkey"), _key("O", "o_orderkey"), "CONTAINS"),
        row(t("part"), _key("B", "p_brand"), _key("P", "p_partkey"), "CONTAINS"),
        # Deduplicated on narrow integer keys, before ids are built.
        row(lines.select("l_orderkey", "l_partkey").distinct(), _key("O", "l_orderkey"), _key("P", "l_partkey"), "CALLS"),
        row(lines.select("l_orderkey", "l_suppkey").distinct(), _key("O", "l_orderkey"), _key("S", "l_suppkey"), "REFERENCES"),
        row(lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct(), _key("C", "o_custkey"), _key("S", "l_suppkey"), "IMPORTS"),
    ]
    out = unique[0]
    for p in unique[1:]:
        out = out.unionByName(p)
    return out


GRAPH_SQL = """
nodes as (
  select 'R:' || r_regionkey as id, 'system' as kind, r_name as name, '' as path, 'production' as role from region
  union all select 'N:' || n_nationkey, 'subsystem', n_name, '', 'production' from nation
  union all select 'C:' || c_custkey, 'file', c_name, 'nation/' || c_nationkey || '/' || c_name,
    case c_mktsegment when 'BUILDING' then 'test' when 'FURNITURE' then 'fixture' else 'production' end from customer
  union all select 'S:' || s_suppkey, 'file', s_name, 'nation/' || s_nationkey || '/' || s_name, 'production' from supplier
  union all select distinct 'B:' || p_brand, 'class', p_brand, 'brand/' || p_brand, 'production' from part
  union all select 'P:' || p_partkey, 'function', p_name, 'brand/' || p_brand, 'production' from part
  union all select 'O:' || o_orderkey, 'method', 'Order#' || o_orderkey, 'nation/' || c_nationkey || '/' || c_name, 'production'
    from orders join customer on o_custkey = c_custkey),
edges as (
  select 'R:' || n_regionkey as src, 'N:' || n_nationkey as dst, 'IN_REGION' as predicate from nation
  union select 'N:' || c_nationkey, 'C:' || c_custkey, 'IN_REGION' from customer
  union select 'N:' || s_nationkey, 'S:' || s_suppkey, 'IN_REGION' from supplier
  union select 'C:' || o_custkey, 'O:' || o_orderkey, 'CONTAINS' from orders
  union select 'B:' || p_brand, 'P:' || p_partkey, 'CONTAINS' from part
  union select 'O:' || l_orderkey, 'P:' || l_partkey, 'CALLS' from lineitem
  union select 'O:' || l_orderkey, 'S:' || l_suppkey, 'REFERENCES' from lineitem
  union select 'C:' || o_custkey, 'S:' || l_suppkey, 'IMPORTS' from lineitem join orders on l_orderkey = o_orderkey)
"""
