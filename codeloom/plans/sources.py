"""Queries of discovery, manifests, trackers and extraction, over sources that are generated from part and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import graph
from codeloom.plans.registry import fixture, query
from codeloom.sources import extract as E
from codeloom.sources import files as S

_TS = """t as (select p_partkey as k, 'src/m' || p_partkey || '.ts' as path, 'import D, {{ a' || (p_partkey % 9) || ' as b }} from ''./m' || (p_partkey % 7) || ''';' || chr(10) || 'export class K' || p_partkey || ' extends Base' || (p_partkey % 5) || ' implements I {{' || chr(10) || '  go(x: Foo' || (p_partkey % 4) || ') {{' || chr(10)
 || '    x.stop();' || chr(10) || '    b(1);' || chr(10) || '  }}' || chr(10) || '}}' || chr(10) || case when p_partkey % 2 = 0 then 'function top() {{' || chr(10) || '  const b = 1;' || chr(10) || '  b(2);' || chr(10) || '}}' || chr(10) else '' end as content from {part})""".replace("{{", "\x01").replace("}}", "\x02")


def _braces(sql: str) -> str:
    return sql.replace("\x01", "' || chr(123) || '").replace("\x02", "' || chr(125) || '")


_TS = _braces(_TS)


def _ts(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, f"with {_TS} select path, 'typescript' as language, content from t")


@query("""select 'src/m' || p_partkey || '.ts' as path, 'K' || p_partkey as name, 'class' as kind, null as container, 2 as first_line, 7 as last_line from {part} union all select 'src/m' || p_partkey || '.ts', 'go', 'method', 'K' || p_partkey, 3, 6 from {part}
union all select 'src/m' || p_partkey || '.ts', 'top', 'function', null, 8, 11 from {part} where p_partkey % 2 = 0""")
def extract_containers(spark, sf):  # noqa: ANN001, ANN201
    return E.extract(_ts(spark, sf)).where("row = 'entity' and kind <> 'file'").select("path", "name", "kind", "container", "first_line", "last_line")


@query("""with p as (select p_partkey as k, 'src/m' || p_partkey || '.ts' as path, 'K' || p_partkey as c from {part})
select path, null as source, './m' || (k % 7) as target, 'IMPORTS' as predicate from p union all select path, c, 'Base' || (k % 5), 'EXTENDS' from p union all select path, c, 'I', 'EXTENDS' from p union all select path, c || '.go', 'stop', 'CALLS' from p union all select path, c || '.go', 'b', 'CALLS' from p
union all select path, c || '.go', 'Foo' || (k % 4) || '.stop', 'CALLS' from p union all select path, c || '.go', 'Foo' || (k % 4), 'REFERENCES' from p union all select path, 'top', 'b', 'CALLS' from p where k % 2 = 0""")
def extract_relations(spark, sf):  # noqa: ANN001, ANN201
    return E.extract(_ts(spark, sf)).where("row = 'relationship'").select("path", "source", "target", "predicate")


@query(f"""with {_TS}, d as (select path, 1 as seq, 'K' || k as name, 'class' as kind, 2 as a, 7 as b, content from t union all select path, 2, 'go', 'method', 3, 6, content from t union all select path, 3, 'top', 'function', 8, 11, content from t where k % 2 = 0),
x as (select *, array_to_string(string_split(content, chr(10))[a:b], chr(10)) as body, strlen(array_to_string(string_split(content, chr(10))[1:a - 1], chr(10))) + 1 as s from d) select path, name, kind, s as start_byte, s + strlen(body) as end_byte, substr(sha256(body), 1, 16) as content_hash from x""")
def extract_chunks(spark, sf):  # noqa: ANN001, ANN201
    files = _ts(spark, sf)
    return E.chunks(E.extract(files), files).select("path", "name", "kind", "start_byte", "end_byte", "content_hash")


@query("""with p as (select p_partkey as k, 'src/m' || p_partkey || '.ts' as path from {part}) select path, 'import' as row, './m' || (k % 7) as package, 'D' as local, 'default' as other from p union all select path, 'import', './m' || (k % 7), 'b', 'a' || (k % 9) from p
union all select path, 'export', null, 'K' || k, 'K' || k from p union all select path, 'covered', 'top', 'b', null from p where k % 2 = 0""")
def js_bindings(spark, sf):  # noqa: ANN001, ANN201
    return E.bindings(_ts(spark, sf)).select("path", "row", "package", "local", "other")


@query("select 'h' || p_partkey || '.h' as path, case when p_partkey % 3 = 0 then 'cpp' else 'c' end as language from {part}")
def header_language(spark, sf):  # noqa: ANN001, ANN201
    h = graph.table(spark, sf, "part").select(F.concat(F.lit("h"), F.col("p_partkey").cast("string"), F.lit(".h")).alias("path"), F.when(F.col("p_partkey") % 3 == 0, "namespace x { }").otherwise("struct y { int z; };").alias("content"))
    return h.select("path", E.sniffed(F.col("path"), F.col("content"), S.language(F.col("path"))).alias("language"))


_WALK = "w as (select o_orderkey as k, '/root/' || case o_orderkey % 6 when 0 then 'src/' when 1 then 'node_modules/x/' when 2 then '.git/' when 3 then 'lib/tests/' when 4 then 'deep/er/' else '' end || 'f' || o_orderkey || case o_orderkey % 5 when 0 then '.ts' when 1 then '.pb.go' when 2 then '.bin' when 3 then '.PY' else '.tfvars' end as path from {orders})"


@query(f"with {_WALK} select path, case k % 5 when 0 then 'typescript' when 3 then 'python' else 'hcl' end as language from w where k % 6 in (0, 4, 5) and k % 5 in (0, 3, 4)")
def walked_files(spark, sf):  # noqa: ANN001, ANN201
    return S.walk(fixture(spark, sf, f"with {_WALK} select path from w"), "/root").select("path", "language")


@query("""with m as (select 'r' || n_nationkey as repo, n_name as nm, n_nationkey % 3 as t from {nation}) select repo, '@x/' || lower(nm) as name from m where t = 0 union all select repo, lower(nm) from m where t = 1 union all select repo, 'example.org/' || lower(nm) from m where t = 2""")
def package_names(spark, sf):  # noqa: ANN001, ANN201
    n, low = graph.table(spark, sf, "nation"), F.lower("n_name")
    t = F.col("n_nationkey") % 3
    content = F.when(t == 0, F.concat(F.lit('{"name": "@x/'), low, F.lit('"}'))).when(t == 1, F.concat(F.lit('[package]\nversion = "1"\nname = "'), low, F.lit('"\n[dependencies]\nx = "1"'))).otherwise(F.concat(F.lit("module example.org/"), low, F.lit("\n\ngo 1.22\n")))
    return S.package_names(n.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo"), F.when(t == 0, "package.json").when(t == 1, "Cargo.toml").otherwise("go.mod").alias("path"), content.alias("content")))


@query("""select 'w' || n_regionkey as root, 'm' || n_nationkey as member, substr(sha256('system:w' || n_regionkey), 1, 8) as system_id from {nation} where n_nationkey % 4 <> 0 and n_regionkey in (select n_regionkey from {nation} where n_nationkey % 4 <> 0 group by 1 having count(*) >= 2) and n_regionkey <> 2""")
def detected_systems(spark, sf):  # noqa: ANN001, ANN201
    n = graph.table(spark, sf, "nation")
    root = F.concat(F.lit("w"), F.col("n_regionkey").cast("string")).alias("root")
    files = n.select(root, F.concat(F.lit("m"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 4 == 0, "/readme.md").otherwise("/go.mod")).alias("path"))
    return S.systems(files.unionByName(spark.sql("select 'w2' as root, '.git/HEAD' as path")))


@query("select o_orderkey as path from {orders} where o_orderkey % 4 <> 0")
def unmodified_files(spark, sf):  # noqa: ANN001, ANN201
    o = graph.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    return S.unmodified(o, o.select("path", F.when(F.col("path") % 4 == 0, F.col("modified")).otherwise(F.col("modified") + F.expr("interval 1 day")).alias("modified"))).select("path")


@query("""with u as (select 'github://a/b/issues/' || doc_id as uri, coalesce(text, '') as t, doc_id from documents), h as (select *, sha256(uri) as h from u)
select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as id, 'intent' as kind, case when length(t) > 2000 then 2003 else length(t) end as body_chars from h""")
def issue_nodes(spark, sf):  # noqa: ANN001, ANN201
    d = graph.table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    issues = d.select(F.lit("a/b").alias("repo"), F.col("doc_id").alias("number"), F.lit("t").alias("title"), none.alias("author"), F.lit("open").alias("state"), F.array().cast("array<string>").alias("labels"), none.alias("created_at"), F.col("text").alias("body"))
    return S.issue_ops(issues).select("id", "kind", F.length(F.get_json_object("attrs", "$.body")).alias("body_chars"))
