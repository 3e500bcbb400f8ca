"""Queries of indexes and cross-file resolution, over a synthetic code base made from part.

Every part is a definition and a use: file = key mod 37, eight languages; some
names are unique, some have few definers, some many, some are members; files
import the next and the fifth next, and bind one alias of the next.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import graph
from codeloom.operators import incremental
from codeloom.operators import indexes as I
from codeloom.operators import resolve as R
from codeloom.plans.registry import fixture, query
from codeloom.sources import files as S

FILES = """f as (select fid, 'repo' || (fid % 4) as repo, lang, 'repo' || (fid % 4) || '/src/pkg' || (fid % 6) || '/mod' || fid || ext as path from (
  select distinct p_partkey % 37 as fid,
   case p_partkey % 37 % 8 when 0 then 'typescript' when 1 then 'javascript' when 2 then 'python' when 3 then 'java' when 4 then 'c' when 5 then 'cpp' when 6 then 'csharp' else 'go' end as lang,
   case p_partkey % 37 % 8 when 0 then '.ts' when 1 then '.js' when 2 then '.py' when 3 then '.java' when 4 then '.c' when 5 then '.cpp' when 6 then '.cs' else '.go' end as ext from {part}) t)"""
ENTITIES = """e as (select p_partkey as k, p_partkey % 37 as fid, p_partkey as line, p_partkey + 2 as last_line,
  case when p_partkey % 7 <= 2 then 'only' || p_partkey when p_partkey % 7 <= 4 then 'tri' || cast(floor(p_partkey / 3.0) as bigint) when p_partkey % 7 = 5 then 'common' || (p_partkey % 3)
   when p_partkey % 2 = 1 then 'solo' || p_partkey else 'member' || (p_partkey % 10) end as name,
  case when p_partkey % 7 = 6 then case when p_partkey % 2 = 1 then 'Solo' || p_partkey else 'Klass' || (p_partkey % 5) end end as container from {part})"""
RELATIONS = """nn as (select count(*) as n from {part}),
own as (select fid, min(k) as k from e where k % 7 <= 2 group by fid),
b as (select f.path, 'alias' || f.fid as local, case when o.fid % 2 = 0 then 'pub' || o.fid else o.name end as imported, g.path as target from f join f g on g.fid = (f.fid + 1) % 37 join (select own.fid, e.name from own join e on e.k = own.k) o on o.fid = g.fid),
x as (select f.path, 'pub' || f.fid as public, e.name as local from own join e on e.k = own.k join f on f.fid = own.fid where own.fid % 2 = 0),
r as (select e.k as id, f.path, e.name as src, case e.k % 10 when 0 then 'REFERENCES' when 1 then 'EXTENDS' else 'CALLS' end as predicate,
  case when e.k % 17 = 0 then 'alias' || e.fid when t.container is not null then t.container || '.' || t.name else t.name end as name, case when e.k % 17 = 0 then true when e.k % 51 = 1 then false end as bound
  from e join f on f.fid = e.fid cross join nn join e t on t.k = (e.k * 13 + 7) % nn.n),
i as (select f.path, g.path as target from f join f g on g.fid in ((f.fid + 1) % 37, (f.fid + 5) % 37) where f.fid <> g.fid)"""
BASE = f"{FILES}, {ENTITIES}, {RELATIONS}"
#: Words of a name, of all but generic ones, in SQL.
WORDS = "list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '' and w not in ('run', 'job', 'file', 'files', 'table', 'tables', 'output', 'outputs', 'input', 'inputs', 'background'))"
STEM = "regexp_replace(parse_filename({0}), '\\.[^.]*$', '')"


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    at = lambda sql: fixture(spark, sf, f"with {BASE} {sql}")
    return {
        "files": at("select path, lang as language, repo from f"),
        "entities": at("select f.path, k as seq, name, container, line as start, last_line as end from e join f on f.fid = e.fid"),
        "relationships": at("select id, path, src, name, predicate, bound from r"),
        "imports": at("select path, target from i"),
        "bindings": at("select path, local, imported, target from b"),
        "exports": at("select path, local, public from x"),
    }


_CASCADE = f"""{BASE},
q as (select distinct f.path, e.name, case when container is null then e.name else container || '.' || e.name end as qkey from e join f on f.fid = e.fid),
d as (select path, name, list_sort(list(distinct qkey)) as keys from q group by 1, 2),
com as (select name from q group by name having count(distinct path) >= 5 union select name from q where name in ('get', 'map')),
rel as (select r.*, f.lang, f.repo, case when predicate = 'CALLS' and b.local is not null and b.imported <> 'default' then b.imported else r.name end as asked, b.local is not null as has_binding, b.imported as bi, b.target as bt
  from r join f on f.path = r.path left join b on b.path = r.path and b.local = r.name),
inside as (select distinct r.id from r join e s on s.name = r.src join f on f.fid = s.fid and f.path = r.path join e t on t.name = r.name and t.fid = s.fid where t.line >= s.line and t.last_line <= s.last_line),
t0 as (select id, 0 as tier, 'stop' as verdict, null as target, null as qkey, null::double as confidence from rel where bound = false
  union all select rel.id, 0, 'stop', null, null, null from rel join d on d.path = rel.path and d.name = rel.name where not has_binding or (bound is distinct from true and id in (select id from inside))),
c1 as (select rel.id, 1 as tier, rel.path, src, rel.name, lang, repo, bt as target, d.keys from rel left join x on x.path = bt and x.public = bi join d on d.path = bt and d.name = coalesce(x.local, case when bi <> 'default' then bi end)
  where has_binding and coalesce(bound, true)),
ql as (select *, regexp_extract(asked, '^(.*)\\.([^.]*)$', 1) as qq, regexp_extract(asked, '^(.*)\\.([^.]*)$', 2) as m from rel where asked like '%_._%'),
fam as (select path, case when lang in ('javascript', 'typescript') then 'js' when lang in ('c', 'cpp') then 'c' else lang end as fam from f),
nr as (select ql.id, i.target from ql join i on i.path = ql.path where exists (select 1 from q where q.path = i.target and q.name = m and q.qkey = qq || '.' || m) or exists (select 1 from q where q.path = i.target and q.name = qq)),
n1 as (select id, min(target) as near, count(distinct target) as n from nr group by id),
fr as (select distinct ql.id, q.path as target from ql join q on q.name = m and q.qkey = qq || '.' || m join fam a on a.path = ql.path join fam z on z.path = q.path and z.fam = a.fam where q.path <> ql.path and m not in ('get', 'map')),
f1 as (select id, min(target) as far, count(*) as n from fr group by id),
c2 as (select ql.id, m, qq, case when n1.n = 1 then near when f1.n = 1 then far end as target, coalesce(n1.n = 1, false) as is_near from ql left join n1 on n1.id = ql.id left join f1 on f1.id = ql.id),
k2 as (select c2.*, d.keys from c2 left join d on d.path = c2.target and d.name = c2.m),
t2 as (select id, 2 as tier, case when key is null then 'stop' else 'emit' end as verdict, case when key is not null then target end as target, key as qkey, case when key is not null then case when is_near then 0.9 else 0.7 end end as confidence
  from (select *, case when list_contains(keys, qq || '.' || m) then qq || '.' || m when len(keys) = 1 then keys[1] end as key from k2)),
bare as (select * from rel where asked not like '%_._%'),
c3 as (select bare.id, 3 as tier, bare.path, src, bare.name, lang, repo, i.target, d.keys from bare join i on i.path = bare.path join d on d.path = i.target and d.name = asked),
t4 as (select id, 4 as tier, 'stop' as verdict, null as target, null as qkey, null::double as confidence from bare where asked in (select name from com)),
rare as (select * from bare where asked not in (select name from com)),
i2 as (select distinct a.path, z.target from i a join i z on z.path = a.target where a.path <> z.target and not exists (select 1 from i where i.path = a.path and i.target = z.target)),
c5 as (select rare.id, 5 as tier, rare.path, src, rare.name, lang, repo, i2.target, d.keys from rare join i2 on i2.path = rare.path join d on d.path = i2.target and d.name = asked),
w0 as (select rare.id, 6 as tier, rare.path, src, rare.name, rare.lang, rare.repo, d.path as target, d.keys from rare join d on d.name = asked and d.path <> rare.path join f on f.path = d.path and f.lang = rare.lang where not (rare.lang in ('c', 'cpp') and predicate = 'REFERENCES')),
ov as (select c.*, len(list_intersect(list_distinct(list_concat({WORDS.format('lower(' + STEM.format('target') + ')')}, flatten(list_transform(keys, lambda k: {WORDS.format('k')})))), {WORDS.format('src')})) as overlap,
  coalesce(nullif(list_position(list_transform(range(1, least(len(string_split(path, '/')), len(string_split(target, '/'))) + 1), lambda j: string_split(path, '/')[j] = string_split(target, '/')[j]), false), 0) - 1, least(len(string_split(path, '/')), len(string_split(target, '/')))) as common
  from (select * from c3 union all select * from c5 union all select * from w0) c),
hb as (select id, tier, max(overlap) as best from ov where tier in (3, 5) and overlap > 0 group by 1, 2),
hn as (select ov.id, ov.tier, min(lower({STEM.format('target')})) as hint from ov join hb on hb.id = ov.id and hb.tier = ov.tier and hb.best = ov.overlap group by 1, 2 having min(target) = max(target)),
h as (select id, arg_min(hint, tier) as hint from hn group by id),
oh as (select ov.*, tier <> 6 or coalesce(lower({STEM.format('target')}) = h.hint, false) as hinted from ov left join h on h.id = ov.id),
o2 as (select * from (select *, max(hinted) over (partition by id, tier) as any_hint from oh) where hinted or not any_hint),
a1 as (select *, lower({STEM.format('target')}) = lower(name) as st, regexp_matches(target, '\\.(c|cpp|cc|cxx)$') as impl, lang in ('c', 'cpp') as inc, count(*) over w as n, count(*) filter (regexp_matches(target, '\\.(c|cpp|cc|cxx)$')) over w as n_impl, max(overlap) over w as all_best from o2 window w as (partition by id, tier)),
a2 as (select *, not (inc and n_impl = 1) or impl as inn from a1),
a3 as (select *, max(case when inn then common end) over w as nearest, max(case when inn then overlap end) over w as best from a2 window w as (partition by id, tier)),
a4 as (select *, inn and common = nearest as is_near, inn and overlap = best and best > 0 as is_al, impl and overlap = all_best and all_best > 0 as is_built from a3),
a5 as (select *, count(*) filter (st) over w as c_st, count(*) filter (is_near) over w as c_near, count(*) filter (is_al) over w as c_al, count(*) filter (is_built) over w as c_built, count(*) filter (inn) over w as c_in from a4 window w as (partition by id, tier)),
na as (select id, tier, target, keys from a5 where case when n = 1 then true when lang = 'csharp' and c_st = 1 then st when lang = 'java' and c_near = 1 then is_near when not inc then true when c_in = 1 then inn when c_near = 1 then is_near when c_al = 1 then is_al when c_built = 1 then is_built else inn end
  union all select id, tier, target, keys from c1),
ag as (select id, tier, min(target) as target, any_value(keys) as keys from na group by 1, 2 having min(target) = max(target)),
em as (select id, tier, case when len(keys) = 1 then 'emit' else 'stop' end as verdict, case when len(keys) = 1 then target end as target, case when len(keys) = 1 then keys[1] end as qkey, case when len(keys) = 1 then case tier when 5 then 0.8 when 6 then 0.5 else 0.9 end end as confidence from ag where len(keys) = 1 or tier <> 1),
v as (select id, tier, verdict, target, qkey, confidence from t0 union all select * from t2 union all select * from t4 union all select * from em),
out as (select * from (select *, row_number() over (partition by id order by tier) as rn from v) where rn = 1)"""


@query(f"with {_CASCADE} select id, ['1-same-file', '2-binding', '1b-qualifier', '2-import', 'gate-commodity', '2.5-transitive', '3-global'][tier + 1] as tier, verdict, target, qkey, confidence::double as confidence from out")
def tier_cascade(spark, sf):  # noqa: ANN001, ANN201
    return R.cascade(**_tables(spark, sf))


@query(f"with {_CASCADE} select coalesce(['1-same-file', '2-binding', '1b-qualifier', '2-import', 'gate-commodity', '2.5-transitive', '3-global'][tier + 1], 'none') as tier, coalesce(verdict, 'open') as verdict, count(*) as n from r left join out on out.id = r.id group by 1, 2")
def resolution_statistics(spark, sf):  # noqa: ANN001, ANN201
    t = _tables(spark, sf)
    return R.statistics(R.cascade(**t), t["relationships"])


@query(f"with {BASE} select name from (select name, count(distinct fid) as n from e group by name) where n >= 5")
def commodity_gate(spark, sf):  # noqa: ANN001, ANN201
    return R.commodity(_tables(spark, sf)["entities"])


_INDEX = f"""with {BASE}, dd as (select path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') as parts from f)
select 'stem' as index, {STEM.format('path')} as key, path, null as value from f union select 'path', lower(path), path, null from f
union select 'package', array_to_string(parts[-k:], '.'), path, null from (select dd.path, parts, unnest(range(1, least(len(parts), 8) + 1)) as k from dd join f on f.path = dd.path where lang = 'java')
union select 'go-path', array_to_string(parts[-k:], '/'), path, null from (select dd.path, parts, unnest(range(1, least(len(parts), 8) + 1)) as k from dd join f on f.path = dd.path where lang = 'go')
union select 'go-dir', parts[-1], dd.path, null from dd join f on f.path = dd.path where lang = 'go'
union select 'symbol', name, path, null from e join f on f.fid = e.fid union select 'qkey', name, path, case when container is null then name else container || '.' || name end from e join f on f.fid = e.fid
union select 'public', public, path, local from x"""


@query(_INDEX)
def resolution_index(spark, sf):  # noqa: ANN001, ANN201
    t = _tables(spark, sf)
    return I.build(t["files"], t["entities"], t["exports"])


@query(f"""with {BASE}, a as (select k as id, f.path as target, name, case when k % 2 = 0 then 'Klass' || (k % 5) || '.' || name end as preferred from e join f on f.fid = e.fid),
q as (select distinct f.path, name, case when container is null then name else container || '.' || name end as qkey from e join f on f.fid = e.fid)
select a.id, case when bool_or(qkey = preferred) then max(preferred) when min(qkey) = max(qkey) then min(qkey) end as qkey from a join q on q.path = a.target and q.name = a.name group by a.id""")
def best_key(spark, sf):  # noqa: ANN001, ANN201
    t = _tables(spark, sf)
    asked = fixture(spark, sf, f"with {BASE} select k as id, f.path as target, name, case when k % 2 = 0 then 'Klass' || (k % 5) || '.' || name end as preferred from e join f on f.fid = e.fid")
    return I.best_key(asked, I.build(t["files"], t["entities"])).select("id", "qkey")


_SPECS = "s as (select p_partkey as id, f.path, f.lang as language, g.path as other, case p_partkey % 5 when 0 then regexp_replace(g.path, '^.*/', '') when 1 then 'lib/mod' || g.fid when 2 then '@mod' || g.fid when 3 then 'src.pkg' || (g.fid % 6) else 'x.y.mod' || g.fid end as module from {part} join f on f.fid = p_partkey % 37 join f g on g.fid = (p_partkey * 7 + 3) % 37)"


@query(f"""with {BASE}, {_SPECS}, c as (select id, path, module, unnest(list_distinct(list_filter([module, regexp_replace(module, '^[^a-zA-Z0-9_]+', ''), regexp_replace(module, '\\.(js|ts|mjs|cjs|jsx|tsx|py|scala|java|c|cc|cpp|cxx|h|hh|hpp|hxx|[Ss][Aa][Ss])$', ''),
  regexp_replace(module, '^.*/', ''), regexp_replace(regexp_replace(module, '\\.(js|ts|mjs|cjs|jsx|tsx|py|scala|java|c|cc|cpp|cxx|h|hh|hpp|hxx|[Ss][Aa][Ss])$', ''), '^.*/', ''), case when contains(module, '.') then regexp_extract(module, '\\.([^.]*)$', 1) end], lambda m: coalesce(m, '') <> ''))) as key from s),
dd as (select path, lang, string_split(regexp_replace(path, '/[^/]*$', ''), '/') as parts from f),
pk as (select path, array_to_string(parts[-k:], '.') as key from (select path, parts, unnest(range(1, least(len(parts), 8) + 1)) as k from dd where lang = 'java')),
gp as (select path, array_to_string(parts[-k:], '/') as key from (select path, parts, unnest(range(1, least(len(parts), 8) + 1)) as k from dd where lang = 'go')),
tl as (select id, path, array_to_string(pp[-k:], '/') as key from (select id, path, pp, unnest(range(1, least(len(pp), 8) + 1)) as k from (select id, path, list_filter(string_split(module, '/'), lambda p: p <> '') as pp from s)))
select distinct id, target from (select c.id, c.path, f.path as target from c join f on {STEM.format('f.path')} = c.key union all select s.id, s.path, pk.path from s join pk on pk.key = s.module union all select s.id, s.path, dd.path from s join dd on dd.lang = 'go' and dd.parts[-1] = s.module
 union all select tl.id, tl.path, gp.path from tl join gp on gp.key = tl.key) where target <> path""")
def module_files(spark, sf):  # noqa: ANN001, ANN201
    t = _tables(spark, sf)
    return I.module_files(fixture(spark, sf, f"with {BASE}, {_SPECS} select id, path, module from s"), I.build(t["files"]))


_REL = "rs as (select p_partkey as id, f.path, f.lang as language, case when f.lang = 'python' then case p_partkey % 3 when 0 then '.mod' || g.fid when 1 then '..pkg' || (g.fid % 6) || '.mod' || g.fid else 'os' end when p_partkey % 4 = 0 then '../pkg' || (g.fid % 6) || '/mod' || g.fid when p_partkey % 4 = 1 then './mod' || g.fid || '.js' when p_partkey % 4 = 2 then '../../../repo' || (g.fid % 4) || '/src/pkg' || (g.fid % 6) || '/mod' || g.fid || '.js?raw' else 'react' end as raw from {part} join f on f.fid = p_partkey % 37 join f g on g.fid = (p_partkey * 5 + 1) % 37 where f.lang in ('python', 'typescript', 'javascript'))"


@query(f"""with {BASE}, {_REL}, dd as (select id, path, language, raw, regexp_replace(path, '/[^/]*$', '') as here from rs), t as (select id, path, language,
 case when language = 'python' then case when raw like '..%' then regexp_replace(here, '/[^/]*$', '') || '/' || replace(substr(raw, 3), '.', '/') when raw like '.%' then here || '/' || replace(substr(raw, 2), '.', '/') end
  when raw like './%' then here || '/' || regexp_replace(substr(raw, 3), '[?#].*$', '') when raw like '../../../%' then regexp_replace(here, '(/[^/]*){{2}}$', '') || '|' || regexp_replace(substr(raw, 10), '[?#].*$', '')
  when raw like '../%' then regexp_replace(here, '/[^/]*$', '') || '/' || substr(raw, 4) end as at0 from dd), t1 as (select id, path, language, case when contains(at0, '|') then regexp_extract(at0, '\\|(.*)$', 1) else at0 end as tgt from t where at0 is not null),
c as (select id, path, unnest(case when language = 'python' then [tgt || '/__init__.py', tgt || '.py'] when tgt like '%.js' then case when language = 'javascript' then [tgt, tgt[:-4] || '.ts', tgt[:-4] || '.tsx'] else [tgt[:-4] || '.ts', tgt[:-4] || '.tsx', tgt[:-4] || '.d.ts', tgt] end
  when language = 'javascript' then [tgt || '.js', tgt || '.jsx', tgt || '.mjs', tgt || '.cjs', tgt || '.ts', tgt || '.tsx'] else [tgt || '.ts', tgt || '.tsx', tgt || '.d.ts', tgt || '.js', tgt || '.jsx'] end) as cand, generate_subscripts([1, 2, 3, 4, 5, 6], 1) as k from t1),
hh as (select c.id, c.k, f.path as target from c join f on lower(f.path) = lower(c.cand) where f.path <> c.path) select t1.id, arg_min(hh.target, hh.k) as target from t1 left join hh on hh.id = t1.id group by t1.id""")
def relative_imports(spark, sf):  # noqa: ANN001, ANN201
    t = _tables(spark, sf)
    return I.relative_files(fixture(spark, sf, f"with {BASE}, {_REL} select id, path, language, raw from rs"), I.build(t["files"]))


@query(f"""with {BASE} select repo, path from (select repo, path, row_number() over (partition by repo order by case when regexp_replace(parse_filename(path), '\\.[^.]*$', '') in ('index', 'main') then 0 else 1 end, len(string_split(path, '/')), path) as rn from f) where rn = 1""")
def entry_files(spark, sf):  # noqa: ANN001, ANN201
    return I.entry_files(_tables(spark, sf)["files"])


@query(f"""with {BASE}, bb as (select p_partkey % 37 as fid, p_partkey as seq, 'l' || (p_partkey % 5) as local, case when p_partkey % 6 = 0 then 'default' when p_partkey % 6 = 1 then 'l' || (p_partkey % 5) else 'n' || p_partkey end as imported from {{part}})
select f.path, local, arg_min(imported, seq) as imported from bb join f on f.fid = bb.fid where imported <> 'default' and imported <> local group by 1, 2""")
def call_bindings(spark, sf):  # noqa: ANN001, ANN201
    return I.call_bindings(fixture(spark, sf, f"with {BASE}, bb as (select p_partkey % 37 as fid, p_partkey as seq, 'l' || (p_partkey % 5) as local, case when p_partkey % 6 = 0 then 'default' when p_partkey % 6 = 1 then 'l' || (p_partkey % 5) else 'n' || p_partkey end as imported from {{part}}) select f.path, seq, 'p' as pkg, local, imported from bb join f on f.fid = bb.fid"))


@query("""with u as (select p_partkey % 40 as path, '\\App\\' || p_brand || '\\' || case when p_partkey % 3 = 0 then 'Model' else 'Job' || (p_partkey % 9) end as raw, case when p_partkey % 10 = 0 then 'function' end as kind, p_partkey % 11 = 0 as aliased from {part}),
g as (select path, lower(regexp_replace(raw, '^\\\\+', '')) as fqcn from u where kind is null and not aliased and path % 7 <> 0) select path, string_split(fqcn, '\\')[-1] as local, case when min(fqcn) = max(fqcn) then min(fqcn) end as fqcn from g group by 1, 2""")
def php_imports(spark, sf):  # noqa: ANN001, ANN201
    p = graph.table(spark, sf, "part")
    raw = F.concat(F.lit("\\App\\"), "p_brand", F.lit("\\"), F.when(F.col("p_partkey") % 3 == 0, "Model").otherwise(F.concat(F.lit("Job"), (F.col("p_partkey") % 9).cast("string"))))
    rows = p.select((F.col("p_partkey") % 40).alias("path"), raw.alias("raw"), F.when(F.col("p_partkey") % 10 == 0, "function").alias("kind"), (F.col("p_partkey") % 11 == 0).alias("aliased"))
    return I.php_imports(rows, rows.select("path").distinct().select("path", F.when(F.col("path") % 7 == 0, 2).otherwise(1).alias("n")))


_GO = "g as (select p_partkey as id, 'github.com/acme/repo' || (p_partkey % 3) || '/pkg' || (p_partkey % 5) as module, 'repo' || (p_partkey % 2) || '/pkg' || (p_partkey % 5) as dir from {part})"


@query(f"""with {_GO}, m as (select id, module, dir || '/' || n as target from g cross join (select unnest(['pkg' || 0 || '.go', 'pkg1.go', 'pkg2.go', 'b.go', 'a_test.go']) as n)
 union all select id, module, 'other/pkg' || (id % 5) || '/z.go' from g where id % 4 = 0),
l as (select *, regexp_replace(target, '/[^/]*$', '') as d, regexp_replace(parse_filename(target), '\\.[^.]*$', '') as st from m),
s as (select *, case when d = regexp_extract(module, '(repo[0-9]+/pkg[0-9]+)$', 1) or d like '%/' || regexp_extract(module, '(repo[0-9]+/pkg[0-9]+)$', 1) then length(regexp_extract(module, '(repo[0-9]+/pkg[0-9]+)$', 1)) when d like '%/' || regexp_extract(module, '(pkg[0-9]+)$', 1) then length(regexp_extract(module, '(pkg[0-9]+)$', 1)) else -1 end as len from l),
b as (select * from (select *, max(len) over (partition by id) as best from s) where len = best),
c as (select *, min(d) over (partition by id) = max(d) over (partition by id) as single from b),
p as (select *, count(*) filter (st = lower(parse_filename(d))) over (partition by id) as named from c where single and not ends_with(target, '_test.go'))
select id, target from c where not single union all select id, target from (select id, target, row_number() over (partition by id order by case when named = 1 and st = lower(parse_filename(d)) then 0 else 1 end, length(target) desc, target) as rn from p) where rn = 1""")
def go_imports(spark, sf):  # noqa: ANN001, ANN201
    rows = fixture(spark, sf, f"with {_GO} select id, module, dir from g")
    names = F.explode(F.array(*[F.lit(n) for n in ("pkg0.go", "pkg1.go", "pkg2.go", "b.go", "a_test.go")]))
    m = rows.select("id", "module", "dir", names.alias("n")).select("id", "module", F.concat("dir", F.lit("/"), "n").alias("target"))
    m = m.unionByName(rows.where("id % 4 = 0").select("id", "module", F.concat(F.lit("other/pkg"), (F.col("id") % 5).cast("string"), F.lit("/z.go")).alias("target")))
    return I.go_narrowed(m, m.select(F.col("target").alias("path")).distinct().select("path", F.length("path").alias("n_imports"), F.lit(1).alias("n_entities")))


@query("""with s as (select p_partkey as id, case p_partkey % 6 when 0 then '@acme/' || lower(p_brand) when 1 then lower(p_brand) || '/sub' when 2 then './local' when 3 then 'node:fs' when 4 then upper(p_brand) else 'crate' || (p_partkey % 4) || '::x' end as spec from {part}),
pk as (select distinct lower(p_brand) as name, 'r' || (length(p_brand) + p_partkey % 3) as repo0 from {part} where p_partkey < 20),
reg as (select name as key, min(repo0) as repo from pk group by 1 union all select 'crate1', 'rust' union all select '@acme/' || name, 'scoped' from (select distinct name from pk)),
t as (select id, 0 as rk, spec as key from s where spec not like '.%' union all select id, 1, lower(spec) from s where spec not like '.%' union all select id, 2, regexp_extract(spec, '^(.*?)/', 1) from s where spec like '%/%' and spec not like '.%' union all select id, 3, regexp_extract(spec, '^(.*?)::', 1) from s where spec like '%::%')
select id, arg_min(repo, rk) as repo from t join reg on reg.key = t.key group by id""")
def package_lookup(spark, sf):  # noqa: ANN001, ANN201
    asked = fixture(spark, sf, "select p_partkey as id, case p_partkey % 6 when 0 then '@acme/' || lower(p_brand) when 1 then lower(p_brand) || '/sub' when 2 then './local' when 3 then 'node:fs' when 4 then upper(p_brand) else 'crate' || (p_partkey % 4) || '::x' end as spec from {part}")
    registry = fixture(spark, sf, "with pk as (select distinct lower(p_brand) as name, 'r' || (length(p_brand) + p_partkey % 3) as repo0 from {part} where p_partkey < 20) select name as key, min(repo0) as repo from pk group by 1 union all select 'crate1', 'rust' union all select '@acme/' || name, 'scoped' from (select distinct name from pk)")
    return S.package_of(asked, registry)


@query("""with recursive e as (select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey),
r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, dst from r""")
def repo_closure(spark, sf):  # noqa: ANN001, ANN201
    t = lambda n: graph.table(spark, sf, n)
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    rows = pairs.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return R.repo_closure(rows.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct())


@query(f"""with {BASE}, a as (select id, path, src, name, target from (select r.id, r.path, r.src, r.name, i.target from r join i on i.path = r.path)), rp as (select path, repo from f),
k as (select a.id, a.target, fr.repo = tr.repo or (fr.repo, tr.repo) in (('repo0', 'repo1'), ('repo1', 'repo2')) as near from a join rp fr on fr.path = a.path join rp tr on tr.path = a.target)
select id, target from (select *, bool_or(near) over (partition by id) as anyn from k) where near or not anyn""")
def repository_narrowing(spark, sf):  # noqa: ANN001, ANN201
    t = _tables(spark, sf)
    repo = t["files"].select("path", "repo")
    rows = t["relationships"].join(t["imports"], "path").join(repo, "path").join(repo.select(F.col("path").alias("target"), F.col("repo").alias("to_repo")), "target").withColumn("tier", F.lit(3))
    allowed = spark.sql("select 'repo0' as src, 'repo1' as dst union all select 'repo1', 'repo2'")
    return R.by_repository(rows.select("id", "tier", "target", "repo", "to_repo"), allowed).select("id", "target")


@query("select p_partkey as id, case p_partkey % 6 when 0 then 'x.js' when 1 then 'sub/y.h' when 2 then 'github.com/a/b' when 3 then 'Model' when 4 then 'util' else 'b.sas' end as name from {part}")
def captured_imports(spark, sf):  # noqa: ANN001, ANN201
    raw = ["'./lib/x.js'", '"./sub/y.h"', '"..github.com/a/b"', "App\\Http\\Model", "`pkg/util/*`", "c:\\lib\\b.sas"]
    lang = ["javascript", "c", "go", "php", "scala", "sas"]
    at = (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), at)
    return graph.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), I.captured_import(pick(raw), pick(lang)).alias("name"))


@query("""with s as (select p_partkey % 50 as path, '\n' || 'package p' || (p_partkey % 4) || chr(10) || 'type T' || (p_partkey % 6) || ' struct {' || chr(10) || '}' || chr(10) || 'func F' || p_partkey || '(x int) {' || chr(10) || '}' || chr(10) || 'func (r *R) M' || (p_partkey % 9) || '() {' || chr(10) || 'func small() {' as c from {part} where p_partkey < 50)
select path || '.go' as path, unnest(['p' || (path % 4), 'T' || (path % 6), 'F' || path, 'M' || (path % 9)]) as name from s""")
def go_prescan(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("p_partkey").cast("string")
    c = F.concat(F.lit("\npackage p"), (F.col("p_partkey") % 4).cast("string"), F.lit("\ntype T"), (F.col("p_partkey") % 6).cast("string"), F.lit(" struct {\n}\nfunc F"), k, F.lit("(x int) {\n}\nfunc (r *R) M"), (F.col("p_partkey") % 9).cast("string"), F.lit("() {\nfunc small() {"))
    return I.go_prescan(graph.table(spark, sf, "part").where("p_partkey < 50").select(F.concat(k, F.lit(".go")).alias("path"), c.alias("content")))


# ---- a change of some files -------------------------------------------------------------------------------------------

#: The code base after a change of files 3 and 17: a third of their names are others, every fifth definition is gone, file 3 imports another file.
_CHANGED = "(3, 17)"
NEW_BASE = f"""{FILES}, {ENTITIES.replace('e as (', 'e0 as (')}, {re.sub(r'(?<![a-z0-9_])e(?![a-z0-9_])', 'e0', RELATIONS).replace('r as (', 'r0 as (').replace('i as (', 'i0 as (')},
e as (select k, fid, line, last_line, case when fid in {_CHANGED} and k % 3 = 0 then name || 'x' else name end as name, container from e0 where not (fid in {_CHANGED} and k % 5 = 0)),
r as (select r0.* from r0 join f on f.path = r0.path where not (f.fid in {_CHANGED} and id % 11 = 0)),
i as (select path, case when path like '%mod3.%' and target like '%mod8.%' then (select path from f where fid = 30) else target end as target from i0)"""


@query(f"with {_CASCADE.replace(BASE, NEW_BASE)} select id, ['1-same-file', '2-binding', '1b-qualifier', '2-import', 'gate-commodity', '2.5-transitive', '3-global'][tier + 1] as tier, verdict, target, qkey, confidence::double as confidence from out")
def incremental_resolution(spark, sf):  # noqa: ANN001, ANN201
    """All verdicts after the change, from those before it and what it touches."""
    of = incremental.base(**_tables(spark, sf))
    changed = fixture(spark, sf, f"with {FILES} select path from f where fid in {_CHANGED}")
    at = lambda sql: fixture(spark, sf, f"with {NEW_BASE} {sql}")
    new = {
        "files": at("select path, lang as language, repo from f"), "entities": at("select f.path, k as seq, name, container, line as start, last_line as end from e join f on f.fid = e.fid"), "relationships": at("select id, path, src, name, predicate, bound from r"),
        "imports": at("select path, target from i"), "bindings": at("select path, local, imported, target from b"), "exports": at("select path, local, public from x"),
    }
    delta = incremental.apply(of, changed, **{name: df.join(F.broadcast(changed), "path", "left_semi") for name, df in new.items()})
    return delta.patched(of.verdicts)
