"""Registered queries of the engine and the same questions in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import graph, ids
from codeloom.functions import text as X
from codeloom.operators import analytics as A
from codeloom.operators import context as C
from codeloom.operators import indexes as I
from codeloom.operators import resolve as R
from codeloom.operators import revisions as V
from codeloom.operators import traverse as W
from codeloom.plans.registry import ORACLE_SQL, QUERIES, query
from codeloom.plans.shared import LOG_SQL, SNAPSHOT_SQL, event_log
from codeloom.sources import extract as E
from codeloom.sources import files as S
from codeloom.streaming import watch
from codeloom.tables import stored

def _g(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.nodes(spark, sf), graph.edges(spark, sf)


# ---- identity, listing, statistics ------------------------------------------------------------------------------


@query("""select id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as det_id
from (select id, sha256('fixture:' || lower(path) || ':' || id) as h from nodes)""", True)
def det_node_ids(spark, sf):  # noqa: ANN001, ANN201
    return graph.nodes(spark, sf).select("id", ids.node_id(F.lit("fixture"), F.col("path"), F.col("id")).alias("det_id"))


def _rank(name: str, predicates: list[str], kind: str, of: str) -> None:
    other = "src" if of == "dst" else "dst"
    listed = ", ".join(f"'{p}'" for p in predicates)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        nodes, edges = _g(spark, sf)
        return A.rank_by(edges, nodes, predicates, kind, 10, of)

    run.__name__ = name
    query(f"""select n.id, n.name, count(distinct e.{other}) as score from edges e join nodes n on n.id = e.{of}
where e.predicate in ({listed}) and n.kind = '{kind}' group by 1, 2 order by score desc, id limit 10""", True)(run)


_rank("rank_dependents", ["CALLS", "REFERENCES", "IMPORTS"], "function", "dst")
_rank("rank_callers", ["CALLS", "REFERENCES"], "file", "dst")
_rank("rank_importers", ["IMPORTS"], "file", "dst")
_rank("rank_members", ["CONTAINS"], "class", "src")


@query("select kind, count(*) as n from nodes group by rollup (kind)", True)
def stats_rollup(spark, sf):  # noqa: ANN001, ANN201
    return graph.nodes(spark, sf).rollup("kind").agg(F.count(F.lit(1)).alias("n"))


@query("select predicate, count(*) as n from edges group by 1", True)
def stats_predicates(spark, sf):  # noqa: ANN001, ANN201
    return graph.edges(spark, sf).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("select path, count(*) as n, min(name) as first_name, max(name) as last_name from nodes where kind = 'function' group by path", True)
def inventory_by_file(spark, sf):  # noqa: ANN001, ANN201
    return graph.nodes(spark, sf).where("kind = 'function'").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("""select n.id, n.name, n.kind, count(e.src) as degree from nodes n left join
(select src, dst from edges union all select dst, src from edges) e on e.src = n.id where n.kind in ('class', 'subsystem') group by 1, 2, 3""", True)
def entity_degree(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    both = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.where("kind in ('class', 'subsystem')").join(both, nodes.id == both.src, "left").select("id", "name", "kind", F.coalesce("degree", F.lit(0)).alias("degree"))


# ---- traversal ---------------------------------------------------------------------------------------------------


def _expand(name: str, direction: str, predicates: list[str] | None, seeds_where: str, seeds_sql: str) -> None:
    cond = f" and predicate in ({', '.join(repr(p) for p in predicates)})" if predicates else ""
    out = f"select src as id, dst as there, predicate from edges where src in ({seeds_sql}){cond}"
    back = f"select dst as id, src as there, predicate from edges where dst in ({seeds_sql}){cond}"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        nodes, edges = _g(spark, sf)
        return W.expand(edges, nodes.where(seeds_where).select("id"), direction, predicates)

    run.__name__ = name
    query({"out": out, "in": back, "both": f"{out} union {back}"}[direction], True)(run)


_expand("expand_in", "in", None, "kind in ('class', 'method')", "select id from nodes where kind in ('class', 'method')")
_expand("expand_out", "out", None, "kind = 'subsystem'", "select id from nodes where kind = 'subsystem'")
_expand("expand_both", "both", None, "kind = 'class'", "select id from nodes where kind = 'class'")
_expand("callers", "in", ["CALLS", "REFERENCES"], "kind = 'function'", "select id from nodes where kind = 'function'")
_expand("callees", "out", ["CALLS", "REFERENCES"], "kind = 'method'", "select id from nodes where kind = 'method'")
_expand("imports", "out", ["IMPORTS"], "role = 'test'", "select id from nodes where role = 'test'")
_expand("imported_by", "in", ["IMPORTS"], "kind = 'file'", "select id from nodes where kind = 'file'")
_expand("contains", "out", ["CONTAINS"], "kind in ('class', 'file')", "select id from nodes where kind in ('class', 'file')")


@query("""with --recursive
r as (select 'S:0' as id union select e.src from r join edges e on e.dst = r.id and e.predicate <> 'IN_REGION')
select id from r""", True)
def closure_dependents(spark, sf):  # noqa: ANN001, ANN201
    edges = graph.edges(spark, sf)
    return W.closure(edges, spark.createDataFrame([("S:0",)], "id string"), "in", ["CALLS", "IMPORTS", "REFERENCES", "CONTAINS"]).select("id")


@query("""with --recursive
u as (select src as a, dst as b from edges where predicate = 'CONTAINS' union select dst, src from edges where predicate = 'CONTAINS'),
r as (select 'B:Brand#11' as id, 0 as depth union select u.b, r.depth + 1 from r join u on u.a = r.id where r.depth < 4)
select id, min(depth) as depth from r group by id""", True)
def closure_depths(spark, sf):  # noqa: ANN001, ANN201
    edges = graph.edges(spark, sf)
    return W.closure(edges, spark.createDataFrame([("B:Brand#11",)], "id string"), "both", ["CONTAINS"], 4)


@query("""select e1.dst as id, e1.src as ancestor, 1 as distance from edges e1 where e1.predicate = 'IN_REGION'
union all select e1.dst, e2.src, 2 from edges e1 join edges e2 on e2.dst = e1.src and e2.predicate = 'IN_REGION' where e1.predicate = 'IN_REGION'""", True)
def ancestors(spark, sf):  # noqa: ANN001, ANN201
    return W.ancestors(graph.edges(spark, sf))


@query("""select n.name as region, count(*) as n from nodes f join edges e on e.dst = f.id and e.predicate = 'IN_REGION' join nodes n on n.id = e.src and n.kind = 'subsystem'
where f.kind = 'file' group by 1""", True)
def bucket_by_region(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return W.bucket_by_region(nodes.where("kind = 'file'").select("id"), edges, nodes)


@query("""select src as id, kind, count(*) as n, min(name) as first_name from edges e join nodes n on n.id = e.dst where e.predicate in ('CONTAINS', 'IN_REGION') group by 1, 2""", True)
def overview_children(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    child = edges.where("predicate in ('CONTAINS', 'IN_REGION')").join(nodes, F.col("dst") == F.col("id"))
    return child.groupBy(F.col("src").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query("""with k as (select e.src as parent, n.id, n.name from edges e join nodes n on n.id = e.dst where e.predicate = 'CONTAINS' and n.kind = 'function')
select id, parent, rn, n_siblings from (select id, parent, row_number() over (partition by parent order by name, id) as rn, count(*) over (partition by parent) - 1 as n_siblings from k) where rn <= 5""", True)
def siblings(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    nodes, edges = _g(spark, sf)
    k = edges.where("predicate = 'CONTAINS'").join(nodes.where("kind = 'function'"), F.col("dst") == F.col("id")).select(F.col("src").alias("parent"), "id", "name")
    n = k.groupBy("parent").agg((F.count(F.lit(1)) - 1).alias("n_siblings"))
    top = k.withColumn("rn", F.row_number().over(Window.partitionBy("parent").orderBy("name", "id"))).where("rn <= 5")
    return top.join(n, "parent").select("id", "parent", "rn", "n_siblings")


# ---- search and resolution ----------------------------------------------------------------------------------------


_SCORE = """30 - case when lower(name) = lower('{t}') then 30 when starts_with(lower(name), lower('{t}')) then 15 else 0 end
 - case when kind in ('class', 'object', 'trait', 'interface', 'module', 'file') then 3 when kind in ('function', 'method') then 1 else 0 end"""


@query(f"""with w as (select *, case when lower(name) = 'red plate' then 100 when contains(lower(name), 'red plate') then 60 when contains(lower(path), 'red plate') then 40 else 0 end as weight from nodes),
c as (select *, {_SCORE.format(t='red plate')} as resolver from (select * from w where weight > 0 order by weight desc, id limit 60)),
r as (select *, case when weight >= 100 then case when resolver <= -3 then 0 when resolver <= 0 then 1 else 2 end when weight >= 60 then 3 else 4 end as tier,
  -weight + case when weight >= 60 then resolver else 0 end as sub_score from c)
select id, name, kind, weight, tier, sub_score from r order by tier, sub_score, case when kind in ('class', 'file', 'function', 'method') then 0 else 1 end, lower(name), id limit 20""", True)
def search_tiers(spark, sf):  # noqa: ANN001, ANN201
    return A.search(graph.nodes(spark, sf), "red plate", 20)


_SYMBOLS = ["Brand#11", "red plate", "Order#1", "FRANCE", "EUROPE"]
_SYMBOLS_SQL = " union all ".join(f"select '{s}' as symbol" for s in _SYMBOLS)
_RESOLVE_SQL = f"""s as ({_SYMBOLS_SQL}),
c as (select symbol, id, kind, name, path,
 case when lower(name) = lower(symbol) then 0 when starts_with(lower(name), lower(symbol)) then 15 else 30 end
 - case when kind in ('class', 'object', 'trait', 'interface', 'module', 'file') then 3 when kind in ('function', 'method') then 1 else 0 end
 - case when regexp_matches(symbol, '^[A-Z][A-Za-z0-9]*$') and lower(name) = lower(symbol) and kind in ('class', 'interface', 'trait', 'object') then 4 else 0 end as score
 from nodes join s on contains(lower(name), lower(symbol)))"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return A.resolve_scores(graph.nodes(spark, sf), spark.createDataFrame([(s,) for s in _SYMBOLS], "symbol string"))


@query(f"with {_RESOLVE_SQL} select symbol, id, cast(score as integer) as score from c", True)
def resolve_scores(spark, sf):  # noqa: ANN001, ANN201
    return _resolved(spark, sf).select("symbol", "id", "score")


@query(f"""with {_RESOLVE_SQL},
k as (select *, case kind when 'class' then 1 when 'interface' then 2 when 'function' then 3 when 'method' then 4 when 'file' then 5 else 6 end as kr from c),
r as (select *, row_number() over w as rn, count(*) over (partition by symbol) as n, lead(score) over w as s2, lead(kind) over w as k2, case when lead(score) over w = score then lead(kr) over w end as r2 from k window w as (partition by symbol order by score, kr, id)),
v as (select *, case when n = 1 then 'sole' when score + 3 <= s2 then 'gap' when s2 > score then 'tier' when r2 > kr then 'preferred-kind'
 when kind in ('class', 'object', 'trait', 'interface', 'module', 'file') and k2 not in ('class', 'object', 'trait', 'interface', 'module', 'file') then 'container' else 'ambiguous' end as verdict from r where rn = 1)
select symbol, n, verdict, case when verdict <> 'ambiguous' then id end as pick, cast(score as integer) as score from v""", True)
def resolve_verdicts(spark, sf):  # noqa: ANN001, ANN201
    return A.resolve_verdicts(_resolved(spark, sf))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), q as (select v as q from e where vec_id = 0)
select vec_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) as score from e, q order by score desc, vec_id limit 10""")
def semantic_topk(spark, sf):  # noqa: ANN001, ANN201
    return A.semantic_topk(graph.table(spark, sf, "embeddings"), 0, 10)


@query("""with f as (select * from nodes where kind = 'file'), g as (select split_part(path, '/', 2) as grp, count(*) filter (role not in ('test', 'fixture')) as shown, count(*) filter (role in ('test', 'fixture')) as tests from f group by 1)
select f.id, case when shown > 0 then tests else 0 end as hidden from f join g on g.grp = split_part(f.path, '/', 2) where role not in ('test', 'fixture') or shown = 0""", True)
def role_filter(spark, sf):  # noqa: ANN001, ANN201
    files = graph.nodes(spark, sf).where("kind = 'file'").withColumn("grp", F.split_part("path", F.lit("/"), F.lit(2)))
    return A.role_filter(files, ["grp"]).select("id", "hidden")


@query("select id, name from nodes where contains(path, 'nation/1') and not contains(path, 'nation/12') and kind not in ('method')", True)
def path_filter(spark, sf):  # noqa: ANN001, ANN201
    return A.path_filter(graph.nodes(spark, sf), "nation/1", "nation/12", ("method",)).select("id", "name")


# ---- facts, roles, risk, smells, regions --------------------------------------------------------------------------


_FACTS_SQL = """fi as (select dst as id, count(distinct src) filter (predicate in ('CALLS', 'REFERENCES')) as callers, count(distinct src) filter (predicate = 'IMPORTS') as importers,
  count(distinct src) filter (predicate in ('CALLS', 'REFERENCES', 'IMPORTS')) as dependents, min(src) filter (predicate = 'CONTAINS') as container_id from edges group by 1),
fo as (select src as id, count(distinct dst) filter (predicate in ('CALLS', 'REFERENCES')) as callees, count(distinct dst) filter (predicate = 'CONTAINS') as members from edges group by 1),
facts as (select n.*, coalesce(callers, 0) as callers, coalesce(importers, 0) as importers, coalesce(dependents, 0) as dependents, coalesce(callees, 0) as callees, coalesce(members, 0) as members, container_id
  from nodes n left join fi on fi.id = n.id left join fo on fo.id = n.id)"""


@query(f"with {_FACTS_SQL} select id, callers, importers, dependents, callees, members, container_id from facts", True)
def facts(spark, sf):  # noqa: ANN001, ANN201
    return A.facts(*_g(spark, sf), names=False).select("id", "callers", "importers", "dependents", "callees", "members", "container_id")


@query(f"""with {_FACTS_SQL},
h as (select id, callers, dependents, importers, members, callers >= 8 or dependents >= 10 or importers >= 5 or (members >= 10 and callers >= 3) as high, callers <= 2 and dependents >= 8 as choke from facts)
select id, case when choke or high then 'high' when dependents = 0 and callers <= 1 and importers = 0 and members <= 1 then 'low' else 'medium' end as level,
 case when choke then 'pipeline-choke-point' when high then 'broad-shared-dependency' when callers <= 2 and dependents <= 3 then 'localized-helper' else 'normal' end as category from h""", True)
def importance(spark, sf):  # noqa: ANN001, ANN201
    f = A.facts(*_g(spark, sf), names=False)
    level, category = A.importance(F.col("callers"), F.col("dependents"), F.col("importers"), F.col("members"), F.col("dependents"))
    return f.select("id", level.alias("level"), category.alias("category"))


@query(f"""with {_FACTS_SQL} select id, case
 when kind = 'class' and callers > 0 and callees = 0 and members <= 2 then 'data-model' when kind in ('function', 'method') and callers = 0 and callees > 0 then 'entry-point'
 when callees >= 5 and callers <= 2 then 'orchestrator' when kind in ('file', 'module') and members > 0 then 'container' when callers >= 3 and members = 0 and callees <= 2 then 'shared-utility'
 when kind in ('function', 'method', 'class') then 'localized-helper' else 'unknown' end as inferred_role from facts""", True)
def role_inference(spark, sf):  # noqa: ANN001, ANN201
    return A.infer_role(A.facts(*_g(spark, sf))).select("id", "inferred_role")


@query(f"""with {_FACTS_SQL}, m as (select e.src as id, count(distinct c.src) as member_callers from edges e join edges c on c.dst = e.dst and c.predicate in ('CALLS', 'REFERENCES') where e.predicate = 'CONTAINS' group by 1),
b as (select f.*, coalesce(member_callers, 0) as mc, importers + dependents + coalesce(member_callers, 0) as total from facts f left join m on m.id = f.id),
c as (select *, case when kind in ('class', 'file') and (importers >= 5 or dependents >= 8 or mc >= 20) then 'shared' when kind in ('function', 'method') and callers >= 5 then 'shared'
  when callers + importers + dependents <= 2 then 'localized' else 'unknown' end as category from b)
select id, category, case when category = 'shared' then case when total >= 15 then 'high' else 'medium' end when category = 'localized' then 'low' when total >= 10 then 'medium' else 'low' end as risk_level from c""", True)
def risk_level(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    calls = edges.where("predicate in ('CALLS', 'REFERENCES')").select(F.col("src").alias("caller"), "dst")
    members = edges.where("predicate = 'CONTAINS'").select("src", "dst").join(calls, "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("caller").alias("member_callers"))
    f = A.facts(nodes, edges, names=False).join(members, "id", "left").withColumn("member_callers", F.coalesce("member_callers", F.lit(0))).withColumn("buckets", F.lit(0))
    return A.risk(f).select("id", "category", "risk_level")


_SMELL_SQL = """d as (select id, count(distinct other) filter (not member) as fan, count(distinct other) filter (member) as chunks from (
  select src as id, dst as other, predicate = 'CONTAINS' as member from edges where predicate <> 'IN_REGION' union all select dst, src, false from edges where predicate not in ('IN_REGION', 'CONTAINS')) group by 1),
f as (select n.id, coalesce(fan, 0) as fan, coalesce(chunks, 0) as chunks from nodes n left join d on d.id = n.id where kind in ('file', 'class'))"""


@query(f"""with {_SMELL_SQL} select id, 'orphan' as smell, cast(0.8 as double) as confidence from f where fan = 0 and chunks = 0
union all select id, 'god_module', least(1.0, 0.5 + case when chunks >= 20 then 0.25 else 0 end + case when fan >= 15 then 0.25 else 0 end)::double from f where chunks >= 20 or fan >= 15
union all select id, 'weak_component', 0.6::double from f where fan = 1 and chunks <= 1""", True)
def smells(spark, sf):  # noqa: ANN001, ANN201
    return A.smells(*_g(spark, sf))


def _file_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = nodes.where("kind = 'file'").select("id", F.col("id").alias("file"))
    held = edges.where("predicate = 'CONTAINS'").select(F.col("dst").alias("id"), F.col("src").alias("file"))
    return own.unionByName(held)


_COUPLING_SQL = """fo as (select id, id as file from nodes where kind = 'file' union all select dst, src from edges where predicate = 'CONTAINS'),
coupling as (select least(a.file, b.file) as a, greatest(a.file, b.file) as b, sum(case predicate when 'IMPORTS' then 3.0 when 'CALLS' then 2.0 else 1.0 end)::double as weight
 from edges e join fo a on a.id = e.src join fo b on b.id = e.dst where predicate in ('IMPORTS', 'CALLS', 'REFERENCES') and a.file <> b.file group by 1, 2)"""


@query(f"with {_COUPLING_SQL} select a, b, weight from coupling", True)
def coupling(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return A.coupling(edges, _file_of(nodes, edges))


_REGION_SQL = f"""{_COUPLING_SQL}, mem as (select dst as id, src as region from edges where predicate = 'IN_REGION' and src like 'N:%'),
rw as (select a, b, weight, ma.region as ra, mb.region as rb from coupling join mem ma on ma.id = a join mem mb on mb.id = b),
ins as (select ra as region, sum(weight) as internal from rw where ra = rb group by 1),
ends as (select region, sum(weight) as external, count(distinct id) as boundary from (select ra as region, a as id, weight from rw where ra <> rb union all select rb, b, weight from rw where ra <> rb) group by 1),
sc as (select m.region, m.files, coalesce(internal, 0.0) as internal, coalesce(external, 0.0) as external, coalesce(boundary, 0) as boundary from (select region, count(*) as files from mem group by 1) m left join ins on ins.region = m.region left join ends on ends.region = m.region),
regions as (select region, files, internal::double as internal, external::double as external, boundary, round(case when internal + external > 0 then internal / (internal + external) else 0 end, 4)::double as cohesion, round(boundary / files, 4)::double as boundary_ratio,
 round(case when internal + external > 0 then internal / (internal + external) else 0 end * (1 - boundary / files), 4)::double as confidence from sc)"""


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _g(spark, sf)
    member = edges.where("predicate = 'IN_REGION' and src like 'N:%'").select(F.col("dst").alias("id"), F.col("src").alias("region"))
    return A.region_scores(A.region_links(edges, _file_of(nodes, edges), member), member)


@query(f"with {_REGION_SQL} select *, case when confidence >= 0.75 then 'Well-defined' when confidence >= 0.5 then 'Moderate' else 'Fuzzy' end as label from regions", True)
def region_scores(spark, sf):  # noqa: ANN001, ANN201
    return _regions(spark, sf)


@query(f"with {_REGION_SQL} select region, files from regions order by files desc, region limit 10 offset 5", True)
def region_paging(spark, sf):  # noqa: ANN001, ANN201
    return A.page(_regions(spark, sf), [F.desc("files"), F.col("region")], 5, 10).select("region", "files")


@query()
def region_map(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return A.communities(A.coupling(edges, _file_of(nodes, edges)))


@query(f"with {_COUPLING_SQL} select id, 1::bigint as n_regions, 0.0::double as gain from (select a as id from coupling union select b from coupling)", True)
def region_state(spark, sf):  # noqa: ANN001, ANN201
    """What defines the map: every linked file is in one region, and moving it to another one gains nothing."""
    nodes, edges = _g(spark, sf)
    links = stored(A.coupling(edges, _file_of(nodes, edges)))
    member = stored(A.communities(links))
    times = member.groupBy("id").agg(F.count(F.lit(1)).alias("n_regions"))
    return A.gains(links, member).join(times, "id").select("id", "n_regions", F.round("gain", 3).alias("gain"))


@query(f"""with {_SMELL_SQL}, s as (select src as region, f.id, f.chunks, case when chunks >= 20 or fan >= 15 then 1 else 0 end as smelly from f join edges e on e.dst = f.id and e.predicate = 'IN_REGION'),
g as (select region, count(*) as files, sum(chunks) as chunks, sum(smelly) as smelly from s group by 1)
select region, round(0.5 * least(1, chunks / files / 5) + 0.5 * (1 - smelly / files), 4)::double as health, case when 0.5 * least(1, chunks / files / 5) + 0.5 * (1 - smelly / files) >= 0.8 then 'good'
 when 0.5 * least(1, chunks / files / 5) + 0.5 * (1 - smelly / files) >= 0.65 then 'fair' when 0.5 * least(1, chunks / files / 5) + 0.5 * (1 - smelly / files) >= 0.45 then 'weak' else 'poor' end as band from g""", True)
def subsystem_health(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    smelly = A.smells(nodes, edges).where("smell = 'god_module'").select("id").withColumn("smelly", F.lit(1))
    chunks = edges.where("predicate = 'CONTAINS'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    f = nodes.where("kind = 'file'").select("id").join(smelly, "id", "left").join(chunks, "id", "left")
    f = f.join(edges.where("predicate = 'IN_REGION'").select(F.col("dst").alias("id"), F.col("src").alias("region")), "id")
    g = f.groupBy("region").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("smelly"), F.lit(0)).alias("smelly"))
    health = 0.5 * F.least(F.lit(1.0), F.col("chunks") / F.col("files") / 5) + 0.5 * (1 - F.col("smelly") / F.col("files"))
    return g.select("region", F.round(health, 4).alias("health"), F.when(health >= 0.8, "good").when(health >= 0.65, "fair").when(health >= 0.45, "weak").otherwise("poor").alias("band"))


# ---- set operations -----------------------------------------------------------------------------------------------


def _sets(name: str, op: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        edges = graph.edges(spark, sf)
        a, b = (edges.where(F.col("dst") == d).select("src") for d in ("S:0", "S:1"))
        return {"intersect": a.intersect, "except": a.subtract, "union": lambda x: a.union(x).distinct()}[op](b)

    run.__name__ = name
    query(f"select src from edges where dst = 'S:0' {op} select src from edges where dst = 'S:1'", True)(run)


_sets("intersect_dependents", "intersect")
_sets("except_dependents", "except")
_sets("union_dependents", "union")


# ---- revisions ----------------------------------------------------------------------------------------------------


@query(f"with {LOG_SQL} select id, value, rev from {SNAPSHOT_SQL.format(r=5000)}")
def snapshot_at_rev(spark, sf):  # noqa: ANN001, ANN201
    return V.snapshot(event_log(spark, sf), 5000)


@query(f"with {LOG_SQL}, v as (select id, rev as created_rev, lead(rev) over (partition by id order by rev) as deleted_rev, value, op from log) select id, created_rev, deleted_rev, value from v where op <> 'DeleteNode' and created_rev <= 3000 and (deleted_rev is null or deleted_rev > 3000)")
def as_of(spark, sf):  # noqa: ANN001, ANN201
    return V.as_of(V.intervals(event_log(spark, sf)), 3000)


_DIFF_SQL = f"with {LOG_SQL}, a as {SNAPSHOT_SQL.format(r=3000)}, b as {SNAPSHOT_SQL.format(r=6000)}, d as (select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' when a.value is distinct from b.value then 'modified' end as change from a full join b on a.id = b.id)"


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    return V.diff(V.snapshot(log, 3000), V.snapshot(log, 6000))


@query(f"{_DIFF_SQL} select id, change from d where change is not null")
def diff(spark, sf):  # noqa: ANN001, ANN201
    return _diff(spark, sf)


@query(f"{_DIFF_SQL} select change, count(*) as n from d where change is not null group by 1")
def diff_summary(spark, sf):  # noqa: ANN001, ANN201
    return _diff(spark, sf).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {LOG_SQL} select id, count(*) as n, min(rev) as first_rev, max(rev) as last_rev from log group by id")
def history(spark, sf):  # noqa: ANN001, ANN201
    return event_log(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("rev").alias("first_rev"), F.max("rev").alias("last_rev"))


@query(f"with {LOG_SQL}, q as (select unnest([1, 500, 999, 100000000]) as rev) select q.rev, max(ts) as ts from q join log on log.rev <= q.rev group by 1")
def rev_timestamp(spark, sf):  # noqa: ANN001, ANN201
    asked = spark.createDataFrame([(r,) for r in (1, 500, 999, 100000000)], "rev int")
    return V.rev_timestamp(event_log(spark, sf).select("rev", "ts"), asked)


@query("select user_id as entity, event_type as field, count(distinct value) as n_values from events group by 1, 2 having count(distinct value) > 1")
def conflicts(spark, sf):  # noqa: ANN001, ANN201
    return V.conflicts(graph.table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("field"), "value"))


@query("select event_type || ':' || user_id as edge_id, min(event_id) as seq, arg_max(value, event_id) as attrs from events group by 1")
def edge_dedupe_last_attrs(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("edge_id"), F.col("event_id").alias("seq"), F.col("value").alias("attrs"))
    return V.dedupe_edges(e)


@query("select p_name as name, min(p_partkey) as seq, arg_min(p_brand, p_partkey) as brand from part group by 1")
def node_dedupe_first(spark, sf):  # noqa: ANN001, ANN201
    return V.first_by(graph.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("brand")), ["name"], "seq")


@query("select conv_id || ':' || turn as src, conv_id || ':' || nxt as dst from (select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as nxt from conversations) where nxt is not null")
def chunk_next(spark, sf):  # noqa: ANN001, ANN201
    c = graph.table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("seq"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), F.lit(None).cast("string").alias("container"))
    return V.next_edges(c)


@query("select doc_id, substr(sha256(coalesce(text, '')), 1, 16) as content_hash from documents")
def chunk_hash(spark, sf):  # noqa: ANN001, ANN201
    return graph.table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("content_hash"))


@query("""select 'DeleteNode' as op, id, 0 as "class" from nodes where id like 'S:%' and id like '%7'
union all select distinct 'DeleteEdge', src || '>' || dst || '>' || predicate, 2 from edges where (src like 'S:%' and src like '%7') or (dst like 'S:%' and dst like '%7')""", True)
def reconcile_removed(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    suppliers = nodes.where("id like 'S:%'")
    return V.reconcile(suppliers, suppliers.where("id not like '%7'"), edges.withColumn("edge_id", F.concat_ws(">", "src", "dst", "predicate")))


# ---- sources and text ---------------------------------------------------------------------------------------------


@query("""with d as (select doc_id, text, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) as s from documents)
select doc_id, length(coalesce(text, '')) >= 204800 and (list_max(s) >= 20000 or (len(s) <= 50 and length(text) / len(s) >= 2000)) as minified from d""")
def minified(spark, sf):  # noqa: ANN001, ANN201
    return graph.table(spark, sf, "documents").select("doc_id", S.minified(F.coalesce("text", F.lit(""))).alias("minified"))


@query("select source || '/' || doc_id || '.txt' as path, case when doc_id % 10 = 0 then 'deleted' else 'changed' end as status from documents where doc_id % 10 = 0 or doc_id % 2 = 1")
def changed_files(spark, sf):  # noqa: ANN001, ANN201
    d = graph.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    before = d.select("path", F.sha2(F.when(F.col("doc_id") % 2 == 1, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("hash"))
    return S.changed(d.where("doc_id % 10 <> 0"), before)


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)
select doc_id, line_no, line from (select *, row_number() over (partition by doc_id order by line_no) as rn from l where regexp_matches(line, '(?i)license|@[a-z0-9]+')) where rn <= 3""")
def text_search(spark, sf):  # noqa: ANN001, ANN201
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, k: F.struct((k + 1).cast("long").alias("line_no"), x.alias("line"))), lambda s: F.rlike(s["line"], F.lit("(?i)license|@[a-z0-9]+")))
    return graph.table(spark, sf, "documents").select("doc_id", F.explode(F.slice(lines, 1, 3)).alias("m")).select("doc_id", "m.line_no", "m.line")


@query("select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) as lines from documents")
def line_range(spark, sf):  # noqa: ANN001, ANN201
    return graph.table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n", -1), 2, 3), "\n").alias("lines"))


_ROLE_PATHS = """'/' || case p_partkey % 8 when 0 then 'tests/' when 1 then 'src/fixtures/' when 2 then 'vendor/' when 3 then 'scripts/' when 4 then 'gen/' when 5 then 'src/' when 6 then 'app.Tests/' else '' end
 || case p_partkey % 9 when 0 then 'a.test.ts' when 1 then 'b_spec.rb' when 2 then 'fake_c.py' when 3 then 'd.pb.go' when 4 then 'Makefile' when 5 then 'vite.config.js' when 6 then 'UserTests.cs' when 7 then 'seed.sql' else 'main.go' end"""
_ROLE_SQL = f"""p as (select p_partkey as k, p_partkey % 8 as d, p_partkey % 9 as f, p_partkey % 5 as s from part),
r as (select k, case when d in (0, 6) then 0.8 else 0.0 end + case when f in (0, 1, 6) then 0.9 else 0.0 end + case when s = 1 then 0.5 else 0.0 end as test, case when d = 1 then 0.8 else 0.0 end + case when f in (2, 7) then 0.6 else 0.0 end as fixture,
 case when d = 4 or f = 3 then 0.7 else 0.0 end + case when s = 2 then 0.9 else 0.0 end as generated, case when d = 2 then 0.9 else 0.0 end as external, case when d = 3 then 0.6 else 0.0 end + case when f in (4, 5) then 0.7 else 0.0 end as tooling,
 list_filter([case d when 0 then 'path:tests/' when 6 then 'path:.Tests/' end, case f when 0 then 'filename:.test.' when 1 then 'filename:_spec.' when 6 then 'filename:Test(s).' end, case when s = 1 then 'import:python_test_framework' end, case when d = 1 then 'path:fixtures/' end, case f when 2 then 'filename:fake' when 7 then 'filename:seed' end,
  case when d = 4 then 'path:gen/' when f = 3 then 'filename:.pb. (protobuf)' end, case when s = 2 then 'source_marker:code_generated' end, case when d = 2 then 'path:vendor/' end, case when d = 3 then 'path:scripts/' end, case f when 4 then 'filename:Makefile' when 5 then 'filename:.config.' end], lambda x: x is not null) as signals from p),
m as (select *, greatest(test, fixture, generated, external, tooling) as best from r)"""


@query(f"""with {_ROLE_SQL} select k, case when best < 0.5 then 'production' when test = best then 'test' when fixture = best then 'fixture' when generated = best then 'generated' when external = best then 'external' else 'tooling' end as role,
 case when best < 0.5 then 0.5 else round(least(best, 1.0), 2) end::double as confidence, case when best < 0.5 then '' else array_to_string(signals, ',') end as signals from m""")
def file_roles(spark, sf):  # noqa: ANN001, ANN201
    rows = graph.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(_ROLE_PATHS).alias("path"), F.when(F.col("p_partkey") % 5 == 1, "import unittest").when(F.col("p_partkey") % 5 == 2, "x\n// Code generated by y").otherwise("plain").alias("source"))
    role = S.file_role(F.col("path"), F.col("source"))
    return rows.select("k", role["role"].alias("role"), role["confidence"].alias("confidence"), F.array_join(role["signals"], ",").alias("signals"))


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as link from pages")
def html_links(spark, sf):  # noqa: ANN001, ANN201
    return graph.table(spark, sf, "pages").select("page_id", F.explode(E.html_links(F.col("html"))).alias("link"))


@query("select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, count(*) as n from pages group by 1")
def page_hosts(spark, sf):  # noqa: ANN001, ANN201
    return graph.table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id || '.json' as path, unnest(json_keys(min(props))) as name from events group by user_id")
def json_keys(spark, sf):  # noqa: ANN001, ANN201
    files = graph.table(spark, sf, "events").groupBy("user_id").agg(F.min("props").alias("content")).select(F.concat(F.col("user_id").cast("string"), F.lit(".json")).alias("path"), F.lit("json").alias("language"), "content")
    return E.extract(files).where("row = 'entity' and kind = 'config_entry'").select("path", "name")


@query("""select p_partkey, array_to_string(list_sort(list_distinct(['a' || p_size, 'b.' || lower(p_brand[1:5])])), ',') as refs from part""")
def sql_table_refs(spark, sf):  # noqa: ANN001, ANN201
    p = graph.table(spark, sf, "part")
    stmt = F.concat(F.lit("select * from A"), F.col("p_size").cast("string"), F.lit(" x join b."), F.substring("p_brand", 1, 5), F.lit(" y on x.k = y.k join a"), F.col("p_size").cast("string"))
    return p.select("p_partkey", F.array_join(E.sql_table_refs(stmt), ",").alias("refs"))


@query("""with t as (select url as path, unnest(regexp_extract_all(html, '<(a|link|script|img|iframe|source|use)[^>]*>')) as tag from pages),
l as (select path, case when regexp_matches(tag, '^<(script|img|iframe|source)') then regexp_extract(tag, ' src="([^"]+)"', 1) else regexp_extract(tag, ' href="([^"]+)"', 1) end as target from t)
select distinct path, target, 'IMPORTS' as predicate from l where target <> ''""")
def html_extract(spark, sf):  # noqa: ANN001, ANN201
    pages = graph.table(spark, sf, "pages").select(F.col("url").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    # Several pages may have one url.
    return E.extract(pages).where("row = 'relationship'").select("path", "target", "predicate").distinct()


# ---- resolution ---------------------------------------------------------------------------------------------------


@query("""with s as (select l_orderkey as path, 'item' || l_linenumber || '.' || l_partkey as name, l_linenumber * 3 as a, l_linenumber * 3 + l_partkey % 20 as b from lineitem),
l as (select o_orderkey as path, 10 as line from orders) select l.path, line, arg_min(name, (b - a) * 1000000 + a * 1000) as name from l join (select path, min(name) as name, a, b from s group by path, a, b) s on s.path = l.path and line between a and b group by 1, 2""")
def enclosing_scope(spark, sf):  # noqa: ANN001, ANN201
    s = graph.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("item"), F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_linenumber") * 3).cast("long").alias("start"), (F.col("l_linenumber") * 3 + F.col("l_partkey") % 20).alias("end"))
    return R.enclosing(graph.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit(10).alias("line")), s)


@query("""select 'C:' || c_custkey as src, 'S:' || l_suppkey as dst from (select distinct c_custkey, c_nationkey, l_suppkey from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey) join supplier on s_suppkey = l_suppkey
where c_nationkey = s_nationkey or (c_nationkey < s_nationkey and s_nationkey - c_nationkey <= 3)""")
def cross_repo_gate(spark, sf):  # noqa: ANN001, ANN201
    t = lambda n: graph.table(spark, sf, n)
    imports = graph.edges(spark, sf).where("predicate = 'IMPORTS'").select(F.col("src").alias("src_path"), F.col("dst").alias("dst_path"))
    repo = t("customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_nationkey").alias("repo")).unionByName(t("supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_nationkey").alias("repo")))
    nations = t("nation").select(F.col("n_nationkey").alias("src"))
    allowed = nations.join(nations.withColumnRenamed("src", "dst"), (F.col("dst") > F.col("src")) & (F.col("dst") - F.col("src") <= 3))
    return R.gate_cross_repo(imports, repo, allowed).select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))


@query("""with d as (select path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') as parts from nodes where kind = 'file') select distinct array_to_string(parts[-k:], '.') as suffix, path from (select path, parts, unnest(range(1, least(len(parts), 8) + 1)) as k from d)""", True)
def suffix_index(spark, sf):  # noqa: ANN001, ANN201
    return I.suffix_index(graph.nodes(spark, sf).where("kind = 'file'").select("path"))


# ---- context, stitching, savings, output --------------------------------------------------------------------------


@query("""select source, doc_id from (select source, doc_id, row_number() over w as rn, sum(length(text)) over (partition by source order by doc_id rows unbounded preceding) as running from documents window w as (partition by source order by doc_id)) where rn <= 25 and running <= 12000""")
def context_budget(spark, sf):  # noqa: ANN001, ANN201
    d = graph.table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), "text")
    return C.evidence_budget(d, "source").select("source", F.col("id").alias("doc_id"))


@query("""select id, case when seq % 6 = 0 then 0 when seq % 6 = 1 then 10 + seq when seq % 6 = 2 then 20 when seq % 6 = 3 then 21 when seq % 6 = 4 then 30 + least(seq, 10) else 40 end as score from (select 'B:' || n_nationkey as id, n_nationkey as seq from nation)""")
def evidence_rank(spark, sf):  # noqa: ANN001, ANN201
    kind = F.element_at(F.array(*[F.lit(k) for k in ("target", "structural", "claim", "decision", "relationship", "provenance")]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return C.rank_evidence(graph.table(spark, sf, "nation").select(F.concat(F.lit("B:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("seq"), kind.alias("kind"))).select("id", "score")


@query("""select distinct c.n_regionkey as consumer, p.n_regionkey as provider, s_name as name from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation c on c.n_nationkey = c_nationkey
join supplier on s_suppkey = l_suppkey join nation p on p.n_nationkey = s_nationkey where c.n_regionkey <> p.n_regionkey""")
def stitch_edges(spark, sf):  # noqa: ANN001, ANN201
    t = lambda n: graph.table(spark, sf, n)
    nation = t("nation").select("n_nationkey", F.col("n_regionkey").alias("ws"))
    provides = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("ws", F.col("s_name").alias("name"), "s_suppkey")
    use = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "l_suppkey").distinct()
    consumes = use.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t("supplier").select("s_suppkey", F.col("s_name").alias("name")), F.col("l_suppkey") == F.col("s_suppkey")).select("ws", "name")
    return C.stitch(provides.select("ws", "name"), consumes)


@query("select event_type as command, sum(event_id % 1000)::bigint as tokens, round(sum(event_id % 1000) * 33.0 / 1e6, 6) as money, round(sum(event_id % 1000) * 2 / 1e3, 6) as water_ml from events group by 1")
def savings(spark, sf):  # noqa: ANN001, ANN201
    return C.savings(graph.table(spark, sf, "events").select(F.col("event_type").alias("command"), (F.col("event_id") % 1000).alias("tokens")))


@query("select 'node id=' || id || ' kind=' || kind || ' name=' || case when name = '' or regexp_matches(name, '[\\s\"=]') then '\"' || name || '\"' else name end as llm_line from nodes where kind in ('function', 'subsystem')", True)
def llm_lines(spark, sf):  # noqa: ANN001, ANN201
    n = graph.nodes(spark, sf).where("kind in ('function', 'subsystem')")
    return n.select(X.llm_line("node", id=F.col("id"), kind=F.col("kind"), name=F.col("name")).alias("llm_line"))


# ---- event time ---------------------------------------------------------------------------------------------------


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(spark, sf):  # noqa: ANN001, ANN201
    return watch.tumbling(graph.table(spark, sf, "events"))


@query("""with g as (select user_id, ts, event_id, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def event_sessions(spark, sf):  # noqa: ANN001, ANN201
    return watch.sessions(graph.table(spark, sf, "events"))


@query("select time_bucket(interval 10 minute, ts, timestamp '1970-01-01') as start, user_id, event_type, count(*) as n from events group by 1, 2, 3")
def event_dedupe_window(spark, sf):  # noqa: ANN001, ANN201
    return watch.debounced(graph.table(spark, sf, "events"))


@query("select event_type, count(*) as n from events group by 1")
def stream_counts(spark, sf):  # noqa: ANN001, ANN201
    """The events table drained through a stream with a memory sink."""
    name = f"codeloom_events_{abs(hash(sf))}"
    schema = T.StructType(graph.table(spark, sf, "events").schema.fields)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# Further areas register their queries when they are imported.
from codeloom.plans import access, graphs, resolution, sources  # noqa: E402, F401
