"""Queries of lookup, traversal, impact, explanation, patches, contexts and records over the graph of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import graph, ids
from codeloom.functions import output as O
from codeloom.functions import text as X
from codeloom.operators import analytics as A
from codeloom.operators import context as C
from codeloom.operators import explain as N
from codeloom.operators import lookup as L
from codeloom.operators import patches as P
from codeloom.operators import revisions as V
from codeloom.operators import traverse as W
from codeloom.plans.registry import fixture, query


def _g(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.nodes(spark, sf), graph.edges(spark, sf)


def _seeds(spark: SparkSession, *values: str, name: str = "id") -> DataFrame:
    return spark.sql(f"select explode(array({', '.join(repr(v) for v in values)})) as {name}")


def _det(spark: SparkSession, sf: str) -> DataFrame:
    n = graph.nodes(spark, sf)
    return n.select(ids.node_id(F.lit("fixture"), F.col("path"), F.col("id")).alias("id"), "kind", "name", "path")


_DET = "dt as (select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as id, kind, name, path from (select *, sha256('fixture:' || lower(path) || ':' || id) as h from nodes))"


@query(f"with {_DET}, a as (select substr(id, 1, 8) as target from dt where kind = 'class' union select substr(id, 1, 18) from dt where kind = 'subsystem' union select 'ffffffff-none') select a.target, case when count(distinct dt.id) = 1 then 'found' when count(distinct dt.id) > 1 then 'ambiguous' else 'missing' end as status, case when count(distinct dt.id) = 1 then min(dt.id) end as id from a left join dt on starts_with(dt.id, a.target) group by 1", True)
def resolve_prefix(spark, sf):  # noqa: ANN001, ANN201
    d = _det(spark, sf)
    asked = d.where("kind = 'class'").select(F.substring("id", 1, 8).alias("target")).unionByName(d.where("kind = 'subsystem'").select(F.substring("id", 1, 18).alias("target"))).unionByName(_seeds(spark, "ffffffff-none", name="target"))
    return L.resolve_prefix(asked, d)


@query("select id as there, 'S:0' as id, predicate from (select src as id, predicate from edges where dst = 'S:0' union select dst, predicate from edges where src = 'S:0')", True)
def expand_seed(spark, sf):  # noqa: ANN001, ANN201
    return W.expand(graph.edges(spark, sf), _seeds(spark, "S:0"), "both")


@query("select src as there, dst as id, predicate from edges where dst in (select id from nodes where kind = 'method')", True)
def expand_in_methods(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return W.expand(edges, nodes.where("kind = 'method'").select("id"), "in")


@query("select n.name, n.id, e.src as there, e.predicate from nodes n join edges e on e.dst = n.id where n.name in ('red plate', 'FRANCE') and n.kind in ('function', 'subsystem')", True)
def expand_by_name(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return W.expand_by_name(edges, nodes.where("kind in ('function', 'subsystem')"), _seeds(spark, "red plate", "FRANCE", name="name"), "in")


@query("""with s as (select id from nodes where kind in ('class', 'subsystem')), w as (select distinct src as here, dst as there from edges),
h1 as (select s.id, w.there from s join w on w.here = s.id), h2 as (select h1.id, w.there from h1 join w on w.here = h1.there) select distinct id, there from (select * from h1 union select * from h2) where id <> there""", True)
def hops_two(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return W.hops(edges, nodes.where("kind in ('class', 'subsystem')").select("id"), "out", ["CONTAINS", "IN_REGION", "IMPORTS", "CALLS", "REFERENCES"], 2)


@query("""with n as (select id from nodes where kind = 'function'), g as (select distinct dst as id, src as there from edges where predicate in ('CALLS', 'REFERENCES') and dst in (select id from n)),
lines as (select 'doc' || doc_id as path, 'use ' || replace(p_name, ' ', '_') || '(x)' as text from documents join part on p_partkey = doc_id % 50),
c as (select distinct path, regexp_extract(text, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1) as name from lines)
select id, there, 'graph' as source from g union all select nodes.id, c.path, 'text' from nodes join c on c.name = replace(nodes.name, ' ', '_') where nodes.kind = 'function' and nodes.id not in (select id from g)""", True)
def callers_fallback(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    lines = fixture(spark, sf, "select 'doc' || doc_id as path, 1 as line, 'use ' || replace(p_name, ' ', '_') || '(x)' as text from {documents} join {part} on p_partkey = doc_id % 50")
    f = nodes.where("kind = 'function'").select("id", F.replace("name", F.lit(" "), F.lit("_")).alias("name"))
    return W.callers(edges, f, lines)


@query("""with c as (select id, row_number() over (order by id) as seq from nodes where kind = 'class' order by id limit 8), d as (select c.id, c.seq, count(distinct e.dst) as degree from c left join edges e on e.src = c.id and e.predicate = 'CONTAINS' group by 1, 2)
select id, degree, row_number() over (order by degree desc, case when id = 'B:Brand#11' then 0 else 1 end, seq) = 1 as chosen from d""", True)
def trace_target(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    some = nodes.where("kind = 'class'").select("id").orderBy("id").limit(8)
    from pyspark.sql import Window

    return W.trace_target(some.withColumn("seq", F.row_number().over(Window.orderBy("id"))), edges, "out", ["CONTAINS"], "B:Brand#11")


@query("with m as (select distinct dst from edges where predicate = 'IN_REGION') select id, id as holder from nodes where id in (select dst from m) union all select e.dst, e.src from edges e where e.predicate = 'CONTAINS' and e.src in (select dst from m) and e.dst not in (select dst from m)", True)
def effective_regions(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return W.effective_regions(nodes, edges)


@query("""with k as (select e.src as parent, n.id, n.kind, n.name from edges e join nodes n on n.id = e.dst where e.predicate = 'CONTAINS'),
s as (select a.id, a.parent, b.id as sibling, row_number() over (partition by a.id order by b.name, b.id) as rn from k a join k b on b.parent = a.parent and b.id <> a.id) select id, parent, sibling, rn from s where rn <= 5""", True)
def overview_leaf(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return W.overview_leaf(nodes, edges)


@query("""with --recursive
t as (select min(dst) as a, max(dst) as b from edges where predicate = 'IN_REGION' and src = 'N:0' and dst like 'C:%'),
u as (select src as a, dst as b from edges where predicate = 'IN_REGION' union select dst, src from edges where predicate = 'IN_REGION'),
r as (select a as id, 1 as n from t union select u.b, r.n + 1 from r join u on u.a = r.id where r.n < 5)
select min(n) as n_nodes from r join t on t.b = r.id having count(*) > 0""", True)
def shortest_path_len(spark, sf):  # noqa: ANN001, ANN201
    edges = graph.edges(spark, sf)
    region = edges.where("predicate = 'IN_REGION'")
    ends = region.where("src = 'N:0' and dst like 'C:%'").agg(F.min("dst").alias("a"), F.max("dst").alias("b")).first()
    return W.shortest_path(edges, ends.a, ends.b, ["IN_REGION"], 5).select(F.size("path").alias("n_nodes"))


# ---- impact and explanation -----------------------------------------------------------------------------------------

_IMPACT = """t as (select id, kind, name, path from nodes where kind in ('class', 'function', 'subsystem')),
mem as (select src as id, count(*) as members from edges where predicate = 'CONTAINS' group by 1), cal as (select dst as id, count(distinct src) as n from edges where predicate in ('CALLS', 'REFERENCES') group by 1),
cle as (select src as id, count(distinct dst) as n from edges where predicate in ('CALLS', 'REFERENCES') group by 1), imp as (select dst as id, count(distinct src) as n from edges where predicate = 'IMPORTS' group by 1),
mc as (select e.src as id, count(*) as n from (select distinct src, dst from edges where predicate = 'CONTAINS') e join (select distinct src, dst from edges where predicate in ('CALLS', 'REFERENCES')) c on c.dst = e.dst group by 1)"""


@query(f"""with {_IMPACT} select t.id, t.kind in ('class') as is_container, case when t.kind = 'class' then coalesce(members, 0) else 0 end as members, case when t.kind = 'class' then 0 else coalesce(cal.n, 0) end as callers, case when t.kind = 'class' then 0 else coalesce(cle.n, 0) end as callees,
 case when t.kind = 'class' then coalesce(imp.n, 0) else 0 end as importers, case when t.kind = 'class' then coalesce(cal.n, 0) else 0 end as dependents, case when t.kind = 'class' then coalesce(mc.n, 0) else 0 end as member_callers
 from t left join mem on mem.id = t.id left join cal on cal.id = t.id left join cle on cle.id = t.id left join imp on imp.id = t.id left join mc on mc.id = t.id""", True)
def impact(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    i = N.impact(nodes.where("kind in ('class', 'function', 'subsystem')"), nodes, edges, 1)
    return i.select("id", "is_container", "members", "callers", "callees", "importers", "dependents", "member_callers")


_NAMES = "w as (select p_partkey as k, case p_partkey % 9 when 0 then 'HTTPClient' when 1 then 'resolve_entity' when 2 then 'mergeConflicts' when 3 then 'scoreRank' when 4 then 'NodeKind' when 5 then 'parseConfig' when 6 then 'renderGraph' when 7 then 'UserService' else 'plain' end as name, '/src/' || case p_partkey % 4 when 0 then 'impact/x.ts' when 1 then 'model.ts' when 2 then 'clientApi.ts' else 'a.b.ts' end as path from {part})"
_TOKENS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[\\s_\\-./]+'), lambda t: t <> '')"


@query(f"with {_NAMES} select k, array_to_string({_TOKENS.format('name')}, ' ') as words from w")
def word_tokens(spark, sf):  # noqa: ANN001, ANN201
    return fixture(spark, sf, f"with {_NAMES} select * from w").select("k", F.array_join(X.word_tokens(F.col("name")), " ").alias("words"))


@query(f"""with {_NAMES}, t as (select k, list_concat({_TOKENS.format('name')}, {_TOKENS.format("regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '')")}) as ws, {_TOKENS.format('name')} as ns from w)
select k, case when list_has_any(ws, ['conflict', 'merge', 'conflicts']) then 'conflict-resolution' when list_has_any(ws, ['resolve', 'resolution', 'match', 'select', 'pick', 'lookup']) then 'resolution' when list_has_any(ws, ['parse', 'decode', 'read', 'parser', 'lex']) then 'parsing' when list_has_any(ws, ['impact']) then 'impact analysis'
 when list_has_any(ws, ['explain', 'render']) then 'explanation' when list_has_any(ws, ['ingest', 'store', 'save']) then 'ingestion' when list_has_any(ws, ['score', 'rank', 'weight', 'evaluate']) then 'scoring' end as flow,
 case when list_has_any(ns, ['node']) then 'node' when list_has_any(ns, ['edge']) then 'edge' when list_has_any(ns, ['graph']) then 'graph' when list_has_any(ns, ['parse', 'parser']) then 'parse result' when list_has_any(ns, ['context']) then 'context' when list_has_any(ns, ['entity']) then 'entity' when list_has_any(ns, ['config']) then 'configuration' when list_has_any(ns, ['user']) then 'user' else 'domain' end as noun from t""")
def flow_words(spark, sf):  # noqa: ANN001, ANN201
    t = N.words(F.col("name"), F.col("path"))
    return fixture(spark, sf, f"with {_NAMES} select * from w").select("k", N.flow(t)["name"].alias("flow"), N.noun(F.col("name")).alias("noun"))


@query("""with p as (select p_partkey as k, case p_partkey % 7 when 0 then 'class' when 1 then 'box' when 2 then 'entry' when 3 then 'key' when 4 then 'branch' when 5 then 'bus' else 'node' end as kind, case p_partkey % 4 when 0 then 'API / Explain (2f)' when 1 then 'parsers' when 2 then 'Conflict / db' else 'Core' end as label from {part})
select k, case kind when 'class' then 'classes' when 'box' then 'boxes' when 'entry' then 'entries' when 'key' then 'keys' when 'branch' then 'branches' when 'bus' then 'buses' else 'nodes' end as plural,
 case label when 'API / Explain (2f)' then 'API explanation layer' when 'parsers' then 'parser layer' when 'Conflict / db' then 'conflict-resolution and database layer' else 'core layer' end as phrase from p""")
def labels_in_words(spark, sf):  # noqa: ANN001, ANN201
    rows = fixture(spark, sf, "select p_partkey as k, case p_partkey % 7 when 0 then 'class' when 1 then 'box' when 2 then 'entry' when 3 then 'key' when 4 then 'branch' when 5 then 'bus' else 'node' end as kind, case p_partkey % 4 when 0 then 'API / Explain (2f)' when 1 then 'parsers' when 2 then 'Conflict / db' else 'Core' end as label from {part}")
    return rows.select("k", X.plural(F.col("kind")).alias("plural"), X.humanize(F.col("label")).alias("phrase"))


_FACTORS = "q as (select p_partkey as k, p_partkey % 4 as a, p_partkey % 3 as b, p_partkey % 5 as c from {part})"


@query(f"""with {_FACTORS}, f as (select k, case a when 0 then 'parseFile' when 1 then 'pickBest' when 2 then 'resolveName' else 'other' end as name, case b when 0 then 'src/parser/x.ts' when 1 then 'src/resolve.ts' else 'src/conflict/y.ts' end as path, case c when 0 then 'IngestionService' when 1 then 'ConflictService' when 2 then 'Scorer' else null end as container from q),
r as (select * from (values (0, 'parse|tokenize|lex', 'parser', null, 'parsing pipeline', 1), (1, 'parse|tokenize|lex', null, null, 'parsing pipeline', 1), (2, 'resolve|lookup', 'resolve', null, 'resolution flow', 2), (3, 'pick|select|choose|rank', 'resolve', null, 'resolution flow', 3), (11, null, null, 'ingestionservice', 'ingestion pipeline', 2), (12, null, null, 'conflictservice', 'conflict-resolution flow', 4),
 (13, null, null, 'parser', 'parsing pipeline', 2), (14, null, null, 'scorer|ranker', 'scoring pipeline', 2), (15, 'resolve|conflict', 'conflict', null, 'conflict-resolution flow', 5), (16, null, 'conflict', null, 'conflict-resolution flow', 3)) v(o, np, pp, cp, flow, pr)),
s as (select f.k, r.o, r.flow, case when np is not null and regexp_matches(lower(name), np) then 2 else 0 end + case when pp is not null and regexp_matches(lower(path), pp) then 2 else 0 end + case when cp is not null and regexp_matches(lower(coalesce(container, '')), cp) then 3 else 0 end as sc, pr from f cross join r),
b as (select *, row_number() over (partition by k order by sc + pr desc, o) as rn from s where sc > 0)
select f.k, b.flow as flow_name, coalesce(case when sc + pr >= 5 then 'high' when sc + pr >= 3 then 'medium' else 'low' end, 'low') as flow_confidence from f left join b on b.k = f.k and rn = 1""")
def flow_semantics(spark, sf):  # noqa: ANN001, ANN201
    rows = fixture(spark, sf, f"with {_FACTORS} select k, case a when 0 then 'parseFile' when 1 then 'pickBest' when 2 then 'resolveName' else 'other' end as name, case b when 0 then 'src/parser/x.ts' when 1 then 'src/resolve.ts' else 'src/conflict/y.ts' end as path, case c when 0 then 'IngestionService' when 1 then 'ConflictService' when 2 then 'Scorer' else null end as container_name from q")
    return N.flow_semantics(rows).select("k", "flow_name", "flow_confidence")


@query("""with d as (select distinct dst as here, src as there from edges where predicate in ('CALLS', 'IMPORTS', 'REFERENCES')), n as (select dst as id, count(distinct src) as n from edges where predicate in ('CALLS', 'IMPORTS', 'REFERENCES') group by 1)
select nodes.id, least(coalesce(n, 0), 99) as downstream, case when coalesce(n, 0) > 0 then 1 else 0 end as downstream_depth from nodes left join n on n.id = nodes.id where nodes.kind in ('function', 'class', 'method')""", True)
def downstream(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    return N.downstream(edges, nodes.where("kind in ('function', 'class', 'method')"))


@query("select id, case when length(explanation) > 0 and importance in ('high', 'medium', 'low') then 1 end as explained from (select id, 'x' as explanation, 'low' as importance from nodes where kind in ('class', 'function'))", True)
def explained(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    f = N.explained(N.collect_facts(nodes, edges, kinds=("class", "function")))
    return f.select("id", F.when((F.length("explanation") > 0) & F.col("importance").isin("high", "medium", "low"), 1).alias("explained"))


#: Every part calls the one with half its number, so chains are as deep as numbers have bits.
_CHAIN = "pk as (select p_partkey as k, p_name as name, 'brand/' || p_brand as path from {part}), ce as (select 'P:' || pk.k as src, 'P:' || q.k as dst, 'CALLS' as predicate from pk join pk q on q.k = cast(floor(pk.k / 2) as bigint) and q.k <> pk.k)"
_LEVELS = "lv as (select dst as id, src as there, 1 as depth from ce union all select lv.id, ce.src, lv.depth + 1 from lv join ce on ce.dst = lv.there where lv.depth < {depth})"


def _chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, f"with {_CHAIN} select 'P:' || k as id, 'function' as kind, name, path from pk"), fixture(spark, sf, f"with {_CHAIN} select src, dst, predicate from ce")


@query(f"with recursive {_CHAIN}, {_LEVELS.format(depth=N.DOWNSTREAM_DEPTH)} select 'P:' || k as id, least(count(there), {N.DOWNSTREAM_NODES} - 1) as downstream, coalesce(max(depth), 0) as downstream_depth from pk left join lv on lv.id = 'P:' || k group by k")
def downstream_levels(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _chain(spark, sf)
    return N.downstream(edges, nodes)


@query(f"with recursive {_CHAIN}, {_LEVELS.format(depth=3)} select 'P:' || k as id, (select count(*) from lv where lv.id = 'P:' || k) as callers, (select count(*) from ce where src = 'P:' || k) as callees, (select count(*) from lv where lv.id = 'P:' || k) as propagated from pk")
def impact_levels(spark, sf):  # noqa: ANN001, ANN201
    """Impact within three hops."""
    nodes, edges = _chain(spark, sf)
    return N.impact(nodes, nodes, edges, 3).select("id", "callers", "callees", "propagated")


# ---- lookup ----------------------------------------------------------------------------------------------------------


@query("""with a as (select p_brand as target from part union select n_name from nation union select 'C:' || c_custkey from customer union select 'nope'), k as (select id, name from nodes where kind in ('class', 'subsystem', 'file')),
i as (select target from a where contains(target, ':') and target in (select id from k))
select target, 'id' as how, target as id from i union all select target, 'symbol', min(id) from a join k on name = target where target not in (select target from i) group by 1 having count(*) = 1""", True)
def resolve_targets(spark, sf):  # noqa: ANN001, ANN201
    """Classes and subsystems by name, files by id, and a name that is nowhere."""
    nodes, _ = _g(spark, sf)
    t = lambda name, c: graph.table(spark, sf, name).select(c.alias("target"))
    asked = t("part", F.col("p_brand")).union(t("nation", F.col("n_name"))).union(t("customer", F.concat(F.lit("C:"), F.col("c_custkey").cast("string")))).union(_seeds(spark, "nope", name="target")).distinct()
    return L.resolve_file_or_entity(asked, nodes.where("kind in ('class', 'subsystem', 'file')"))


@query("""select n.id, n.kind, n.name, count(distinct cl.event_id) as n_claims, (select count(*) from edges where dst = n.id) as n_in, (select count(*) from edges where src = n.id) as n_out from nodes n left join events cl on 'C:' || cl.user_id = n.id and cl.event_type = 'purchase' where n.kind = 'file' and n.id like 'C:1%' group by 1, 2, 3""", True)
def entity_details(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    claims = graph.table(spark, sf, "events").where("event_type = 'purchase'").select(F.concat(F.lit("C:"), F.col("user_id").cast("string")).alias("entity"), "event_id")
    return L.details(nodes.where("kind = 'file' and id like 'C:1%'"), nodes, edges, claims).drop("edges")


@query("""with n as (select id, name, path, length(name) as a, length(name) + 3 as b from nodes where kind in ('function', 'method')) select n.id, n.path, n.a as start, n.b as "end", p.name as container, p.name || ' > ' || n.name as breadcrumb, n.path like '%7' as stale from n join (select dst, min(src) as parent from edges where predicate = 'CONTAINS' group by 1) e on e.dst = n.id join nodes p on p.id = e.parent""", True)
def located(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    n = nodes.withColumn("start", F.length("name")).withColumn("end", F.length("name") + 3)
    state = nodes.select("path").distinct().select("path", F.when(F.col("path").like("%7"), "modified").otherwise("fresh").alias("state"))
    return L.locate(nodes.where("kind in ('function', 'method')"), n, edges, state)


@query("""with d as (select doc_id, source || '/' || doc_id || '.txt' as path, coalesce(text, '') as content from documents), l as (select *, string_split(content, chr(10)) as ls from d)
select path as target, 'found' as status, path, 1 as first, len(ls) as last, content as text from l where doc_id % 2 = 0
union all select path || ':1-2', 'found', path, 1, least(2, len(ls)), array_to_string(ls[1:2], chr(10)) from l where doc_id % 2 = 1 union all select 'missing.txt', 'missing', null, null, null, null""")
def read_targets(spark, sf):  # noqa: ANN001, ANN201
    d = graph.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    asked = d.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit(":1-2"))).alias("target")).unionByName(_seeds(spark, "missing.txt", name="target"))
    nothing = graph.nodes(spark, sf).where("false").withColumn("start", F.lit(1)).withColumn("end", F.lit(1))
    return L.read(asked, d.select("path", "content"), nothing)


# ---- patches ---------------------------------------------------------------------------------------------------------

_PATCH = """pf as (select distinct 'brand/' || p_brand as path, sha256(p_brand) as source_hash from part),
pe as (select 'brand/' || p_brand as path, p_partkey as seq, p_name as name, 'function' as kind, case when p_partkey % 3 = 0 then 'K' || (p_partkey % 4) end as container from part),
pr as (select 'brand/' || p_brand as path, p_partkey as seq, p_name as src, case p_partkey % 4 when 0 then 'pkg' || (p_partkey % 5) || '::go' else 'shared' end as dst, case when p_partkey % 4 = 1 then 'REFERENCES' else 'CALLS' end as predicate from part)"""


def _patch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p = graph.table(spark, sf, "part")
    path = F.concat(F.lit("brand/"), "p_brand").alias("path")
    files = p.select(F.lit("ws").alias("ws"), path, F.sha2("p_brand", 256).alias("source_hash")).distinct()
    k = F.col("p_partkey")
    entities = p.select(path, k.alias("seq"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.when(k % 3 == 0, F.concat(F.lit("K"), (k % 4).cast("string"))).alias("container"))
    rel = p.select(path, k.alias("seq"), F.col("p_name").alias("src"), F.when(k % 4 == 0, F.concat(F.lit("pkg"), (k % 5).cast("string"), F.lit("::go"))).otherwise("shared").alias("dst"), F.when(k % 4 == 1, "REFERENCES").otherwise("CALLS").alias("predicate"))
    chunks = p.select(path, k.alias("seq"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.when(k % 3 == 0, F.lit("K")).alias("container"), k.cast("int").alias("line_start"))
    return files, entities, rel, chunks


@query(f"""with {_PATCH}, q as (select path, name, count(distinct case when container is null then name else container || '.' || name end) as n, min(case when container is null then name else container || '.' || name end) as k from pe group by 1, 2),
nd as (select path, count(distinct case when container is null then name else container || '.' || name end) as nodes from pe group by 1),
e as (select pr.path, count(distinct (case when q.n = 1 then q.k else pr.src end, pr.predicate, pr.dst)) as edges, count(distinct case when pr.predicate = 'CALLS' and pr.dst like '%::%' then pr.dst end) as externals, count(distinct (case when q.n = 1 then q.k else pr.src end, pr.predicate, pr.dst)) as claims from pr join q on q.path = pr.path and q.name = pr.src group by 1),
c as (select path, count(*) as chunks, count(*) filter (container is null and nc is null and nn is not null) as nexts from (select path, container, lead(seq) over w as nn, lead(container) over w as nc from pe window w as (partition by path order by seq)) group by 1)
select pf.path, nodes + externals + chunks as upsert_nodes, edges + chunks * 2 + nexts as upsert_edges, claims from pf join nd using (path) join e using (path) join c using (path)""")
def patch_counts(spark, sf):  # noqa: ANN001, ANN201
    ops = P.build_patch(*_patch(spark, sf))
    of = lambda t: F.count_if(F.col("op_type") == t)
    return ops.groupBy("path").agg(of("UpsertNode").alias("upsert_nodes"), of("UpsertEdge").alias("upsert_edges"), of("AssertClaim").alias("claims"))


_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


@query(f"""with {_PATCH}, r as (select path, src, predicate, dst, min(seq) as seq from pr where dst = 'shared' group by 1, 2, 3, 4), h as (select path, src, predicate, sha256('ws:brand/target:' || 'Shared.' || predicate) as h from r)
select path, predicate, count(distinct path || src) as n, {_UUID.format('min(h)')} as dst from (select * from h) group by 1, 2""")
def patch_resolved(spark, sf):  # noqa: ANN001, ANN201
    files, entities, rel, chunks = _patch(spark, sf)
    resolved = rel.where("dst = 'shared'").select("path", "src", "predicate", "dst", F.lit(None).cast("string").alias("to_ws"), F.lit("brand/target").alias("to_path"), F.concat(F.lit("Shared."), "predicate").alias("to_key"))
    ops = P.build_patch(files, entities, rel, chunks.where("false"), resolved)
    hit = ops.where("op_type = 'UpsertEdge'").join(resolved.select("path", "predicate", ids.node_id(F.lit("ws"), F.col("to_path"), F.col("to_key")).alias("dst")).distinct(), ["path", "predicate", "dst"])
    srcs = rel.where("dst = 'shared'").select("path", "src", "predicate").distinct()
    return srcs.groupBy("path", "predicate").agg(F.count_distinct("src").alias("n")).join(hit.groupBy("path", "predicate").agg(F.min("dst").alias("dst")), ["path", "predicate"])


@query(f"""with d as (select doc_id, source as path, sha256(coalesce(text, '')) as h, case when doc_id % 2 = 0 then sha256('old' || doc_id) end as p from documents)
select doc_id, {_UUID.format("sha256('ws:' || lower(path) || ':' || h || ':v3')")} as patch_id, case when p is not null then {_UUID.format("sha256('ws:' || lower(path) || ':' || p || ':v3')")} else {_UUID.format("sha256('ws:' || path || ':' || h)")} end as first_replaced, {_UUID.format("sha256('ws:' || lower(path) || ':' || h || ':v1')")} as last_replaced, 'code' as source_type from d""")
def patch_headers(spark, sf):  # noqa: ANN001, ANN201
    d = graph.table(spark, sf, "documents")
    one = d.select("doc_id", F.lit("ws").alias("ws"), F.col("source").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"), F.when(F.col("doc_id") % 2 == 0, F.sha2(F.concat(F.lit("old"), F.col("doc_id").cast("string")), 256)).alias("previous_hash"))
    h = P.headers(one.withColumn("path", F.concat("path", F.lit("\x00"), F.col("doc_id").cast("string"))).withColumn("path", F.substring_index("path", "\x00", 1)), "v3", ["v2", "v1"])
    keyed = one.select("doc_id", ids.patch_id(F.lit("ws"), F.col("path"), F.col("source_hash"), F.lit("v3")).alias("patch_id")).distinct()
    return keyed.join(h.distinct(), "patch_id").select("doc_id", "patch_id", F.col("replaces")[0].alias("first_replaced"), F.element_at("replaces", -1).alias("last_replaced"), "source_type").join(one.select("doc_id", F.when(F.col("previous_hash").isNotNull(), ids.patch_id(F.lit("ws"), F.col("path"), F.col("previous_hash"), F.lit("v3"))).otherwise(ids.legacy_patch_id(F.lit("ws"), F.col("path"), F.col("source_hash"))).alias("first_replaced")), ["doc_id", "first_replaced"])


@query("select user_id || ':' || event_type as id, min(event_id) as op_seq, arg_max(value, event_id) as attrs from events group by 1")
def edge_dedupe(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events")
    key = F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type")
    ops = e.select(F.lit("f").alias("path"), key.alias("id"), F.col("event_id").alias("op_seq"), F.col("value").alias("attrs"), F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.lit("DOES").alias("predicate"))
    return P.dedupe_edges(ops).select("id", "op_seq", "attrs")


@query("""with o as (select event_id, user_id, case event_type when 'error' then 'DeleteNode' when 'signup' then 'UpsertNode' when 'click' then 'DeleteEdge' when 'view' then 'UpsertEdge' else 'AssertClaim' end as t from events)
select event_id, row_number() over (partition by user_id order by case t when 'DeleteNode' then 0 when 'UpsertNode' then 1 when 'DeleteEdge' then 2 when 'UpsertEdge' then 3 else 4 end, event_id) as op_seq from o""")
def op_order(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "DeleteNode").when(F.col("event_type") == "signup", "UpsertNode").when(F.col("event_type") == "click", "DeleteEdge").when(F.col("event_type") == "view", "UpsertEdge").otherwise("AssertClaim")
    ops = e.select(F.col("user_id").alias("path"), F.col("event_id").alias("op_seq"), kind.alias("op_type"), F.col("event_id").cast("string").alias("id"), F.lit(None).cast("string").alias("field"))
    return P.ordered(ops).select(F.col("id").cast("long").alias("event_id"), "op_seq")


@query("""with o as (select event_id, event_type, value from events) select event_id from o where not (event_type = 'signup' and value < 50) and event_type not in ('click', 'purchase')""")
def map_ops(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events")
    t = F.col("event_type")
    ops = e.select("event_id", F.when(t == "signup", "UpsertNode").when(t == "click", "UpsertEdge").when(t == "purchase", "AssertClaim").otherwise("DeleteNode").alias("op_type"), F.when((t == "signup") & (F.col("value") < 50), "chunk").otherwise("file").alias("kind"), F.when(t == "click", "NEXT").alias("predicate"))
    return P.for_map(ops).select("event_id")


@query("""with f as (select user_id as path, bool_or(event_type = 'error') as dels from events group by 1), n as (select path, dels, row_number() over (partition by dels order by path) as n from f) select path, case when dels then n - 1 else (n - 1) // 10 end as batch, case when dels then 'single' else 'bulk' end as how from n""")
def bulk_batches(spark, sf):  # noqa: ANN001, ANN201
    ops = graph.table(spark, sf, "events").select(F.col("user_id").alias("path"), F.when(F.col("event_type") == "error", "DeleteNode").otherwise("UpsertNode").alias("op_type"))
    return P.bulk(ops, 10)


@query("select event_id as patch_id, rev from (select event_id, row_number() over (order by ts, event_id) as rev from events) order by rev desc limit 20")
def patch_list(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return P.patches(V.numbered(e, "o", "rev").select(F.col("event_id").alias("patch_id"), "rev"), 20)


@query("""with o as (select event_id as patch_id, 'u' || user_id as id, case when event_type = 'click' then 'k' || (event_id % 9) end as dst from events), l as (select event_id as patch_id, row_number() over (order by ts, event_id) as rev from events)
select distinct x.id, x.patch_id, l.rev from (select patch_id, id from o union select patch_id, dst from o where dst is not null) x join l on l.patch_id = x.patch_id""")
def patch_provenance(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events")
    ops = e.select(F.col("event_id").alias("patch_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("src"), F.when(F.col("event_type") == "click", F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string"))).alias("dst"))
    log = V.numbered(e.withColumn("o", F.struct("ts", "event_id")), "o", "rev").select(F.col("event_id").alias("patch_id"), "rev")
    return P.provenance(ops, log)


@query("with k as (select id, case when id like 'P:%5' then 'decision' else kind end as kind from nodes) select e.src, e.dst, e.predicate from edges e where e.src in (select id from k where kind = 'decision') and e.dst in (select id from k where kind = 'decision') union all select id, null, kind from k where kind = 'decision'", True)
def reset_code(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    k = nodes.select("id", F.when(F.col("id").like("P:%5"), "decision").otherwise(F.col("kind")).alias("kind"))
    left, kept = P.reset(k, edges, "code")
    return kept.select("src", "dst", "predicate").unionByName(left.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("kind").alias("predicate")))


@query("select cast(max(case when value >= 0 and value = floor(value) then value end) as bigint) as rev from (select event_id::double as value from events union all select -5.0 union all select 1e9 + 0.5)")
def advance_rev(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events").select(F.col("event_id").cast("double").alias("rev"))
    return P.advance(e.unionByName(spark.sql("select -5.0D as rev union all select 1000000000.5D")))


# ---- contexts, maps and records ----------------------------------------------------------------------------------------


@query("""with s as (select 'N:' || n_nationkey as seed from nation), b as (select src as a, dst as b from edges union select dst, src from edges), n1 as (select distinct seed, seed as id, 0 as depth from s union select distinct s.seed, b.b, 1 from s join b on b.a = s.seed),
r as (select n1.*, nodes.kind, nodes.name, row_number() over (partition by seed order by case when depth = 0 then 0 else 1 end, nodes.kind, nodes.name, nodes.id) as rn from n1 join nodes on nodes.id = n1.id) select seed, id, rn from r where rn <= 50""", True)
def bundle_entities(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    seeds = nodes.where("kind = 'subsystem'").select("id")
    claims = spark.createDataFrame([], "id string, entity string, statement string, status string, confidence double")
    return C.bundle(seeds, nodes, edges, claims)["entities"].select("seed", "id", "rn")


@query("""with s as (select 'N:' || n_nationkey as seed from nation), c as (select e.event_id as id, 'N:' || (e.user_id % 25) as entity, case when event_type = 'purchase' then 'active' else 'retracted' end as status, value / 1000 as confidence from events e),
near as (select seed, seed as id, 0 as depth from s union all select s.seed, 'R:' || n_regionkey, 1 from s join nation on 'N:' || n_nationkey = s.seed)
select near.seed, c.id, round(0.6 * pow(0.5, depth) + 0.4 * confidence, 6) as final_score from c join near on near.id = c.entity where status = 'active'""", False)
def claim_scores(spark, sf):  # noqa: ANN001, ANN201
    e = graph.table(spark, sf, "events")
    claims = e.select(F.col("event_id").alias("id"), F.concat(F.lit("N:"), (F.col("user_id") % 25).cast("string")).alias("entity"), F.lit("s").alias("statement"), F.when(F.col("event_type") == "purchase", "active").otherwise("retracted").alias("status"), (F.col("value") / 1000).alias("confidence"))
    near = graph.table(spark, sf, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("seed"), F.col("n_regionkey")).select("seed", F.explode(F.array(F.struct(F.col("seed").alias("id"), F.lit(0).alias("depth")), F.struct(F.concat(F.lit("R:"), F.col("n_regionkey").cast("string")).alias("id"), F.lit(1).alias("depth")))).alias("n")).select("seed", "n.id", "n.depth")
    return C.scored_claims(claims, near).select("seed", "id", "final_score")


_REGIONS = "g as (select p_partkey as id, 'L' || (p_partkey % 13) as label, p_partkey % 3 + 1 as level, p_size as files, round(p_size / 60.0, 2) as confidence, case when p_partkey % 3 < 2 then p_partkey + 1 end as parent, case p_partkey % 3 when 0 then 'module' when 1 then 'subsystem' else 'system' end as kind from {part})"


@query(f"with {_REGIONS} select id, label, files from g where level = 2 and confidence >= 0.2 order by files desc, confidence desc, label, id limit 10")
def map_view(spark, sf):  # noqa: ANN001, ANN201
    return A.map_view(fixture(spark, sf, f"with {_REGIONS} select id, label, level, files, cast(confidence as double) as confidence, parent, kind from g"), 2, 0.2).select("id", "label", "files")


@query(f"with {_REGIONS}, r as (select *, case when kind = 'system' or parent not in (select id from g) then null else parent end as up from g) select id, up as parent, rn, hidden from (select *, row_number() over (partition by up order by files desc, confidence desc, label, id) as rn, greatest(count(*) over (partition by up) - 10, 0) as hidden from r) where rn <= 10")
def region_tree(spark, sf):  # noqa: ANN001, ANN201
    return A.region_tree(fixture(spark, sf, f"with {_REGIONS} select id, label, level, files, cast(confidence as double) as confidence, parent, kind from g"))


@query("select count(*) as files, count(distinct regexp_replace(path, '/[^/]*$', '')) as directories, count(*) * 20 * 4 as edges, case when count(*) * 80 >= 20000000 then 'high' when count(*) * 80 >= 2000000 then 'medium' else 'low' end as risk from nodes where kind = 'file'", True)
def map_preflight(spark, sf):  # noqa: ANN001, ANN201
    return A.map_preflight(graph.nodes(spark, sf).where("kind = 'file'").select("path")).select("files", "directories", "edges", "risk")


@query("select 'nodes' as check, true as ok, (select count(*) from nodes) || ' nodes' as detail union all select 'edges', true, (select count(*) from edges) || ' edges' union all select 'conflicts', false, count(*) || ' conflicts' from (select user_id, event_type from events group by 1, 2 having count(distinct value) > 1) union all select 'schema', true, 'version 3, expected 3'", True)
def health_checks(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges = _g(spark, sf)
    clash = V.conflicts(graph.table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("field"), "value"))
    return A.health_checks(nodes, edges, clash, 3, 3).select("check", "ok", "detail")


@query("select p_partkey as id, p_name as title from part where p_partkey % 3 = 0 and contains(lower(p_name), 'red') order by p_partkey desc limit 15")
def decision_list(spark, sf):  # noqa: ANN001, ANN201
    log = graph.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "decision").otherwise("intent").alias("kind"), F.col("p_name").alias("title"), F.lit("").alias("topic"), F.col("p_partkey").alias("rev"))
    return A.decisions(log, "red", 15).select("id", "title")


@query("""with f as (select 'N:' || n_regionkey as target, 'N:' || n_nationkey as id, case when n_nationkey % 4 = 0 then '' else n_name end as name, 'subsystem' as kind from nation)
select target, 0 as seq, 'callers target=' || target || ' total=' || count(*) || ' resolved=' || count(*) filter (name <> '') || case when count(*) filter (name = '') > 0 then ' unresolved=' || count(*) filter (name = '') else '' end as line from f group by target
union all select target, row_number() over (partition by target order by name, id), case when name <> '' then 'ref name=' || case when contains(name, ' ') then '"' || name || '"' else name end || ' kind=subsystem id=' || substr(id, 1, 8) else 'ref kind=subsystem id=' || substr(id, 1, 8) || ' resolved=false' end from f
union all select 'none', 0, 'callers target=none total=0 resolved=0' union all select 'none', 1, 'diagnostic code=no_edges message="No callers edges found."'""")
def edge_records(spark, sf):  # noqa: ANN001, ANN201
    n = graph.table(spark, sf, "nation")
    found = n.select(F.concat(F.lit("N:"), F.col("n_regionkey").cast("string")).alias("target"), F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("name"), F.lit("subsystem").alias("kind"), F.lit(None).cast("string").alias("path"))
    return O.edge_records(found, "callers", found.select("target").distinct().unionByName(_seeds(spark, "none", name="target")))


@query("select 'rank rank=' || row_number() over (order by p_retailprice desc, p_partkey) || ' name=\"' || p_name || '\" id=P:' || p_partkey || ' kind=function score=' || p_size as line from part")
def rank_records(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    p = graph.table(spark, sf, "part")
    rows = V.numbered(p.withColumn("o", F.struct((-F.col("p_retailprice")).alias("price"), "p_partkey")), "o", "rank").select("rank", F.col("p_name").alias("name"), F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("function").alias("kind"), F.col("p_size").alias("score"))
    _ = Window
    return O.records(rows, "rank")


@query("select n_nationkey as k, case n_nationkey % 5 when 0 then 12 when 1 then null when 2 then null when 3 then 7 else null end::bigint as value, n_nationkey % 5 in (1, 2, 4) as refused from nation")
def option_numbers(spark, sf):  # noqa: ANN001, ANN201
    text = F.element_at(F.array(*[F.lit(x) for x in ("12", "1e3", "0", " 7 ", "3.9")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    o = O.option_number(text)
    return graph.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), o["value"].alias("value"), o["error"].isNotNull().alias("refused"))


@query("select n_nationkey as k, case n_nationkey % 4 when 0 then 'not_found' when 1 then 'BaseRevMismatch' when 2 then 'unreachable' else 'error' end as code, n_nationkey % 4 in (1, 2) as retry, case n_nationkey % 4 when 0 then 'no such entity' when 1 then 'stale base' when 2 then 'fetch failed' else 'odd' end as message from nation")
def error_codes(spark, sf):  # noqa: ANN001, ANN201
    text = F.element_at(F.array(*[F.lit(x) for x in ("404: no such entity", '409: {"code": "BaseRevMismatch", "message": "stale base"}', "fetch failed", "odd")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    e = O.parse_error(text)
    return graph.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), e["code"].alias("code"), e["retry"].alias("retry"), e["message"].alias("message"))
