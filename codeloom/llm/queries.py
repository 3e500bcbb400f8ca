"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.chat import digest, format_chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest(format_chat(rows.unionByName(extra)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=10)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.decontam import decontaminate

    # Proximity matches are the operator's own; the contract, which SQL can check, is about exact ones.
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.centroids import ball_kmeans

    return ball_kmeans(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents"), weights=(1.0,) * 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_format": op5_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_sharding": op13_sharding,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_WORDS = "list_filter(string_split_regex({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: The contracts in SQL where SQL can express them; the others are held against brute-force versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": f"""with recursive d as (select doc_id, {_SPACES.format(_LOW)} as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r as (select doc_id as id, doc_id as near from d union select r.id, e.y from r join e on e.x = r.near)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n on n.doc_id = d.doc_id join (select id, min(near) as component_id from r group by 1) c on c.id = d.doc_id""",
    "op5_chat_format": """with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, not contains(text, '<s>') and not contains(text, '</s>') and not contains(text, '[/INST]') and not regexp_matches(text, '<(/?s?)?\\z') and not contains(role, '<s>') and not contains(role, '</s>') and not contains(role, chr(10)) and not starts_with(role, '~') as plain,
  case when role = 'user' then 7 + 8 else 0 end as brackets from c),
f as (select *, 3 + 1 + 4 + brackets + length(role) + length(text) + case when plain then 0 else 1 + length(regexp_replace(text, '[^~<\\[\n]', '', 'g')) + length(regexp_replace(role, '[^~<\\[\n]', '', 'g')) end as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars from f group by conv_id""",
    "op8_decontamination": f"""with b as (select cast(item_id as varchar) as item, {_WORDS.format(_LOW)} as w from benchmark where item_id is not null),
wi as (select distinct item, unnest(case when len(w) >= 10 then list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g, least(len(w), 10) as n from b),
d as (select doc_id, {_WORDS.format(_LOW)} as w from documents), sizes as (select distinct n from wi),
p as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
m as (select distinct doc_id, p.n, k, p.g from p join wi on wi.g = p.g and wi.n = p.n),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(k, k + n)) as place from m) group by 1),
it as (select doc_id, list_sort(list(distinct item)) as items from m join wi on wi.g = m.g and wi.n = m.n group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id""",
    "op9_substring_dedup": f"""with d as (select doc_id, {_SPACES.format("coalesce(text, '')")} as w from documents),
p as (select doc_id, k, array_to_string(w[k:k + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d where len(w) >= 13)),
f as (select g, min(doc_id) as first from p group by 1), late as (select p.doc_id, k from p join f on f.g = p.g where p.doc_id > f.first),
gone as (select distinct doc_id, unnest(range(k, k + 13)) as place from late),
e as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as place from d),
k as (select e.doc_id, count(gone.place) as n_removed, sha256(coalesce(string_agg(case when gone.place is null then x end, ' ' order by e.place), '')) as kept_sha256 from e left join gone on gone.doc_id = e.doc_id and gone.place = e.place group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join k on k.doc_id = d.doc_id""",
}


def _rounds_sql(k: int, rounds: int, dims: int, scale: int) -> str:
    """Lloyd's rounds over whole numbers, one pair of common table expressions a round."""
    away = "list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    out = f"""with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), q) - 1 as c, q as m from v qualify c < {k})"""
    for t in range(rounds + 1):
        out += f""",
a{t} as materialized (select r, any_value(vec_id) as vec_id, any_value(q) as q, min((d, c)) as near from (select v.*, c, {away} as d from v, c{t}) group by r)"""
        if t < rounds:
            out += f""",
s{t} as (select near[2] as c, k, sum(q[k]) as s, count(*) as n from a{t}, range(1, {dims + 1}) as g(k) group by 1, 2),
n{t} as (select c, list((s - ((s % n) + n) % n) // n order by k)::bigint[] as m from s{t} group by c),
c{t + 1} as materialized (select o.c, coalesce(n.m, o.m) as m from c{t} o left join n{t} n on n.c = o.c)"""
    return out + f"""
select vec_id, near[2]::int as cluster, near[1] as distance, sum(near[1]) over (partition by near[2])::bigint as cluster_inertia, sum(near[1]) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c = near[2]"""


ORACLE_SQL["op11_centroid_clustering"] = _rounds_sql(k=16, rounds=3, dims=64, scale=64)

_SCORE = "('0x' || md5(coalesce(doc_id::varchar, 'null') || ':' || s)[1:13])::bigint"
#: The checksum byte by byte: entries of its table by the rule, then one step for each byte.
ORACLE_SQL["op13_sharding"] = f"""with recursive e as (select b, b::bigint as x, 0 as k from range(256) as g(b) union all select b, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from e where k < 8),
t as (select list(x order by b) as entry from e where k = 8),
d as (select doc_id, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, n + 1 as size, xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::bigint), lambda crc, byte: xor(entry[(xor(crc, byte) & 255) + 1], crc >> 8), 4294967295::bigint), 4294967295) as text_crc32 from d, t),
p as (select *, (select max((_score, -s)) from (select {_SCORE} as _score, s from range(8) as g(s)))[2] as a, (select max((_score, -s)) from (select {_SCORE} as _score, s from range(9) as g(s)))[2] as b from c)
select doc_id, size, text_crc32, 'key' as law, (-a)::int as shard, row_number() over (partition by a order by doc_id nulls last, text_crc32, size) - 1 as slot, (-b)::int as grown_shard from p"""
