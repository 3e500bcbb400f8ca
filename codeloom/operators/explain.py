"""Impact and explanation: what a change of an entity touches, what part it plays, and both in words.

Everything is computed for all entities at once, as columns.  Rules and their
labels are fixed values; the sentences are this engine's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import analytics as A
from codeloom.operators import traverse as W

#: Flows by words of a name, with what they are about, the first that applies counts.
FLOWS = [
    ("conflict-resolution", "conflict handling", ("conflict", "merge", "conflicts")),
    ("resolution", "entity resolution", ("resolve", "resolution", "match", "select", "pick", "lookup", "resolver", "matcher", "selector")),
    ("parsing", "input parsing", ("parse", "decode", "read", "tokenize", "lex", "parser", "decoder", "reader", "lexer")),
    ("impact analysis", "impact analysis", ("impact",)),
    ("explanation", "explanation generation", ("explain", "render")),
    ("ingestion", "file ingestion", ("ingest", "store", "persist", "save", "ingestion")),
    ("scoring", "candidate scoring", ("score", "rank", "weight", "evaluate")),
]
#: Parts in a flow by words of a name.
FLOW_ROLES = [
    ("candidate selection", ("pick", "select", "best", "filter", "choose")),
    ("reference resolution", ("resolve", "lookup", "match")),
    ("conflict resolution", ("conflict", "merge")),
    ("candidate scoring", ("score", "rank", "evaluate")),
    ("input parsing", ("parse", "decode", "tokenize")),
    ("output rendering", ("render",)),
    ("semantic inference", ("infer",)),
    ("data ingestion", ("ingest", "store", "persist")),
]
#: What a name is about.
NOUNS = [
    ("node", ("node",)), ("edge", ("edge",)), ("graph", ("graph",)), ("parse result", ("parse", "parser")), ("context", ("context",)), ("entity", ("entity",)),
    ("patch", ("patch",)), ("query", ("query",)), ("configuration", ("config",)), ("user", ("user",)),
]
#: Rules of flows: patterns of name, path and container, the flow, the part in it, priority.
FLOW_RULES = [
    ("parse|tokenize|lex", "parser", None, "parsing pipeline", "parsing step", 1),
    ("parse|tokenize|lex", None, None, "parsing pipeline", "parsing step", 1),
    ("resolve|lookup", "resolve", None, "resolution flow", "resolution step", 2),
    ("pick|select|choose|rank", "resolve", None, "resolution flow", "selection step", 3),
    ("score|weight", None, None, "scoring pipeline", "scoring step", 1),
    ("rank", None, None, "ranking pipeline", "ranking step", 1),
    ("ingest|index", None, None, "ingestion pipeline", "ingestion step", 1),
    ("persist|save|store", None, None, "ingestion pipeline", "persistence step", 1),
    ("render|format|display", None, None, "rendering pipeline", "rendering step", 1),
    ("impact|traverse|walk", None, None, "impact pipeline", "traversal step", 1),
    ("explain|infer|synthesize", None, None, "explanation pipeline", "inference step", 1),
    (None, None, "IngestionService", "ingestion pipeline", "ingestion step", 2),
    (None, None, "ConflictService", "conflict-resolution flow", "conflict resolver", 4),
    (None, None, "Parser", "parsing pipeline", "parsing step", 2),
    (None, None, "Scorer|Ranker", "scoring pipeline", "scoring step", 2),
    ("resolve|conflict", "conflict", None, "conflict-resolution flow", "conflict resolver", 5),
    (None, "conflict", None, "conflict-resolution flow", "conflict resolution step", 3),
]
#: Layers and flows by the name of a region.
REGION_RULES = [
    ("resolve", "resolution pipeline", "resolution pipeline"), ("impact", "impact pipeline", None), ("explain", "explanation pipeline", "explanation subsystem"), ("conflict", "conflict-resolution flow", None), ("ingest", "ingestion pipeline", None),
    ("parse", "parsing pipeline", None), ("scor", "scoring pipeline", None), ("rank", "ranking pipeline", None), ("command", None, "command layer"), ("client", None, "CLI client layer"),
]
#: How deep and how far dependents of dependents are counted.
DOWNSTREAM_DEPTH, DOWNSTREAM_NODES, NAMES = 4, 100, 3
#: Labels whose entities take part in a flow, and those at a boundary.
FLOW_LABELS = ("selection-helper", "resolution-helper", "scoring-helper", "orchestrator", "service-method", "service")
BOUNDARY_LABELS = ("api-client", "adapter")
CALLABLE_LABELS = ("selection-helper", "resolution-helper", "scoring-helper", "service-method", "entry-point", "registration-function", "orchestrator", "localized-helper", "shared-utility")
CALLABLES = ("function", "method", "def", "fun", "constructor")


def _first(rules: list[tuple], tokens: Column, of: int = 0) -> Column:
    """The label of the first rule one of whose words the tokens have."""
    out = F.when(X.has_any(tokens, *rules[0][-1]), F.lit(rules[0][of]))
    for r in rules[1:]:
        out = out.when(X.has_any(tokens, *r[-1]), F.lit(r[of]))
    return out


def words(name: Column, path: Column, container: Column | None = None) -> Column:
    """Tokens of a name, its file's name and its container."""
    file = F.regexp_replace(X.basename(F.coalesce(path, F.lit(""))), r"\.[^.]+$", "")
    return F.concat(*[X.word_tokens(F.coalesce(c, F.lit(""))) for c in ([name, file] if container is None else [name, file, container])])


def flow(tokens: Column) -> Column:
    return F.struct(_first(FLOWS, tokens).alias("name"), _first(FLOWS, tokens, 1).alias("about"))


def flow_role(name: Column, tokens: Column) -> Column:
    return F.coalesce(_first(FLOW_ROLES, X.word_tokens(name)), _first(FLOWS, tokens, 1))


def noun(name: Column) -> Column:
    return F.coalesce(_first(NOUNS, X.word_tokens(name)), F.lit("domain"))


def downstream(edges: DataFrame, nodes: DataFrame, depth: int = DOWNSTREAM_DEPTH) -> DataFrame:
    """(id, downstream, downstream_depth): dependents of dependents of each node, and how deep they go.

    All nodes walk at once, so a hop is one join of pairs.  Pairs are distinct
    and a node stops once it has DOWNSTREAM_NODES, which is where the count is
    cut by definition; that also bounds what a hub hands on.
    """
    from codeloom.tables import dropped, shuffled, stored

    walk = stored(edges.where("predicate in ('CALLS', 'IMPORTS', 'REFERENCES', 'EXTENDS', 'IMPLEMENTS')").select(F.col("dst").alias("here"), F.col("src").alias("there")).where("here <> there").distinct())
    # Neighbours beyond the cut never count, so no more than these are handed on.
    order = Window.partitionBy("here").orderBy("there")
    some = stored(walk.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= DOWNSTREAM_NODES).drop("rn"))
    ids = stored(nodes.select("id").distinct())
    # The first hop is these neighbours themselves: distinct, none seen before, in order and up to the cut.
    now = stored(some.join(shuffled(ids.select(F.col("id").alias("here"))), "here").select(F.col("here").alias("id"), "there", F.lit(1).alias("depth")))
    seen = ids.select("id", F.col("id").alias("there"), F.lit(0).alias("depth")).unionByName(now)
    for k in range(2, depth + 1):
        ahead = now.select("id", F.col("there").alias("here")).join(shuffled(some), "here").select("id", "there").where("id <> there").distinct()
        fresh = ahead.join(shuffled(seen.select("id", "there")), ["id", "there"], "left_anti")
        full = seen.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        room = fresh.join(shuffled(full), "id").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("there"))).where(F.col("rn") + F.col("n") - 1 <= DOWNSTREAM_NODES)
        now = stored(room.select("id", "there", F.lit(k).alias("depth")))
        if now.isEmpty():
            break
        seen = stored(seen.unionByName(now))
    dropped(walk, some)
    return shuffled(seen.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("downstream"), F.max("depth").alias("downstream_depth")))


def top_names(edges: DataFrame, nodes: DataFrame, predicates: list[str], most: int = NAMES) -> DataFrame:
    """(id, names): the first names, by id, of those that depend on each node; ids without a name don't count."""
    named = nodes.select(F.col("id").alias("src"), "name").where(~X.raw_id(F.coalesce("name", F.lit(""))) & (F.coalesce("name", F.lit("")) != ""))
    rows = edges.where(F.col("predicate").isin(predicates)).select("src", "dst").distinct().join(named, "src")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("rn") <= most)
    return rows.groupBy(F.col("dst").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda s: s["name"]).alias("names"))


def collect_facts(nodes: DataFrame, edges: DataFrame, history: DataFrame | None = None, state: DataFrame | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """A.facts (of nodes of these kinds, if any are given, over the whole graph) with downstream counts, first callers, the region path, the number of patches(id, n) and whether the file is stale(path, state)."""
    asked = nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds))
    f = (A.facts(nodes, edges) if kinds is None else A.facts(nodes, edges).where(F.col("kind").isin(*kinds))).join(downstream(edges, asked), "id", "left").join(top_names(edges, nodes, ["CALLS", "REFERENCES"]).withColumnRenamed("names", "top_callers"), "id", "left")
    f = f.withColumn("downstream", F.coalesce("downstream", F.lit(0))).withColumn("downstream_depth", F.coalesce("downstream_depth", F.lit(0)))
    f = f.join(region_names(nodes, edges), "id", "left")
    f = f.join(history.select("id", F.col("n").alias("patches")), "id", "left") if history is not None else f.withColumn("patches", F.lit(0))
    f = f.join(state.select("path", (F.col("state") != "fresh").alias("stale")), "path", "left") if state is not None else f.withColumn("stale", F.lit(False))
    return f.withColumn("patches", F.coalesce("patches", F.lit(0))).withColumn("stale", F.coalesce("stale", F.lit(False)))


def region_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, subsystem, module): the nearest regions of these kinds above each node, its container's if it is in none itself."""
    above = W.ancestors(edges).join(nodes.where("kind in ('subsystem', 'module')").select(F.col("id").alias("ancestor"), "kind", "name"), "ancestor")
    near = above.groupBy("id").agg(F.min(F.when(F.col("kind") == "subsystem", F.struct("distance", "name"))).alias("s"), F.min(F.when(F.col("kind") == "module", F.struct("distance", "name"))).alias("m"))
    near = near.select(F.col("id").alias("holder"), F.col("s.name").alias("subsystem"), F.col("m.name").alias("module"))
    return W.effective_regions(nodes, edges).join(near, "holder").select("id", "subsystem", "module")


def role_confidence(f: DataFrame) -> DataFrame:
    """f (with inferred_role) with role_confidence: high, medium or low, by how many signs agree."""
    path, t = F.lower(F.coalesce("path", F.lit(""))), X.tokens(F.coalesce(F.col("name"), F.lit("")))
    role, near = F.col("inferred_role"), lambda *terms: X.contains_any(path, *terms)
    client = F.col("client_members") if "client_members" in f.columns else F.lit(0)
    both = {
        "api-client": (X.has_any(t, "client", "api") | near("api", "client", "http")) & ((client >= 2) | (F.col("members") > 2)),
        "registration-function": near("command", "cli", "bootstrap", "main", "register"),
        "selection-helper": near("resolve", "select", "pick", "rank", "match"),
        "scoring-helper": X.has_any(t, "score", "weight", "rank", "rate", "evaluate") & near("importance", "ranking", "score", "weight"),
        "resolution-helper": X.has_any(t, "resolve", "resolver", "lookup", "match") & near("resolve", "resolver", "match", "lookup"),
        "data-model": X.has_any(t, "model", "entity", "record", "dto"),
        "entry-point": X.has_any(t, "main", "run", "start", "handler", "execute"),
    }
    level = F.when(role.isin("test", "configuration", "type-definition", "service", "service-method", "container"), "high").when(role.isin("adapter", "orchestrator", "shared-utility"), "medium")
    for label, sure in both.items():
        level = level.when(role == label, F.when(sure, "high").otherwise("medium"))
    level = level.when((role == "localized-helper") & F.lower("kind").isin("function", "method") & F.col("callers").between(1, 2) & (F.col("callees") > 0), "medium")
    return f.withColumn("role_confidence", level.otherwise("low"))


def flow_semantics(f: DataFrame) -> DataFrame:
    """f with flow_name, flow_part and flow_confidence: of the rules that apply the one with the highest score, the first of equal ones.

    A name or path counts 2, a container 3, and the rule's priority is added; a
    rule without any match of its patterns does not apply.
    """
    name, path, container = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "path", "container_name"))
    scored = []
    for k, (by_name, by_path, by_container, flow_name, part, priority) in enumerate(FLOW_RULES):
        hit = lambda pattern, c: F.rlike(c, F.lit(f"(?i){pattern}")) if pattern else F.lit(False)
        score = F.when(hit(by_name, name), 2).otherwise(0) + F.when(hit(by_path, path), 2).otherwise(0) + F.when(hit(by_container, container), 3).otherwise(0)
        scored.append(F.struct(F.when(score > 0, score + priority).otherwise(0).alias("score"), F.lit(-k).alias("order"), F.lit(flow_name).alias("flow_name"), F.lit(part).alias("flow_part")))
    best = F.array_max(F.array(*scored))
    f = f.withColumn("_best", best)
    some = F.col("_best.score") > 0
    level = F.when(F.col("_best.score") >= 5, "high").when(F.col("_best.score") >= 3, "medium").otherwise("low")
    return f.select(*[c for c in f.columns if c != "_best"], F.when(some, F.col("_best.flow_name")).alias("flow_name"), F.when(some, F.col("_best.flow_part")).alias("flow_part"), F.when(some, level).otherwise("low").alias("flow_confidence"))


def hierarchy_semantics(f: DataFrame) -> DataFrame:
    """f(subsystem, module, inferred_role) with layer, region_flow and boundary: what its region is known for."""
    place = F.coalesce("subsystem", "module")
    flow_name, layer = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, of, at in reversed(REGION_RULES):
        hit = F.rlike(place, F.lit(f"(?i){pattern}"))
        flow_name = F.when(hit, F.lit(of)).otherwise(flow_name)
        layer = F.when(hit, F.lit(at if at else of)).otherwise(layer)
    known = F.lit(False)
    for pattern, _, _ in REGION_RULES:
        known = known | F.rlike(place, F.lit(f"(?i){pattern}"))
    layer = F.when(known, layer).when(F.col("subsystem").isNotNull(), F.concat("subsystem", F.lit(" subsystem"))).when(F.col("module").isNotNull(), F.concat("module", F.lit(" layer")))
    f = f.withColumn("layer", layer).withColumn("region_flow", F.when(known, flow_name))
    client = F.contains(F.coalesce("layer", F.lit("")), F.lit("client")) | F.contains(F.lower(F.coalesce(place, F.lit(""))), F.lit("client"))
    return f.withColumn("boundary", (F.col("inferred_role") == "api-client") & client)


def system_role(f: DataFrame) -> DataFrame:
    """f (after hierarchy_semantics) with part: what the entity is within its region; null without a region."""
    step = F.create_map(*[F.lit(x) for kv in {"selection-helper": "selects within", "resolution-helper": "resolves within", "scoring-helper": "scores within", "orchestrator": "orchestrates", "service-method": "serves"}.items() for x in kv])
    part = F.when(F.col("boundary"), F.concat(F.lit("boundary of the "), "layer")).when(F.col("region_flow").isNotNull() & F.element_at(step, F.col("inferred_role")).isNotNull(), F.concat(F.element_at(step, F.col("inferred_role")), F.lit(" the "), "region_flow")).when(F.col("layer").isNotNull(), F.concat(F.lit("component of the "), "layer"))
    return f.withColumn("part", part)


def system_meaning(f: DataFrame) -> DataFrame:
    """f with archetype: foundation, boundary or flow; null for others."""
    path = F.lower(F.coalesce("path", F.lit("")))
    model = (F.col("kind") == "file") & (F.contains(path, F.lit("/model/")) | F.contains(path, F.lit("model.")) | F.contains(path, F.lit("/schema/"))) & (F.col("members") > 0)
    role = F.col("inferred_role")
    foundation = F.col("kind").isin("enum", "interface", "type", "trait", "data_class") | ((role == "type-definition") & ((F.col("importers") >= 3) | (F.col("dependents") >= 3))) | (role == "data-model") | model
    placed = F.coalesce("region_flow", "layer").isNotNull()
    return f.withColumn("archetype", F.when(foundation, "foundation").when(role.isin(*BOUNDARY_LABELS) & F.col("boundary"), "boundary").when(role.isin(*FLOW_LABELS) & placed, "flow"))


def explained(f: DataFrame) -> DataFrame:
    """f (facts) with role, importance, flow, region and archetype, and in words: `explanation`, `why` and `used_by`."""
    f = role_confidence(A.infer_role(f))
    level, category = A.importance(F.col("callers"), F.col("dependents"), F.col("importers"), F.col("members"), F.col("downstream"))
    f = system_meaning(system_role(hierarchy_semantics(flow_semantics(f.withColumn("importance", level).withColumn("importance_category", category)))))
    verb = F.when(F.col("role_confidence") == "high", "is").when(F.col("role_confidence") == "medium", "is probably").otherwise("seems to be")
    callable_ = F.lower("kind").isin(*CALLABLES) | F.col("inferred_role").isin(*CALLABLE_LABELS)
    in_flow = callable_ & (F.col("flow_confidence") == "high") & F.col("flow_name").isNotNull()
    what = F.when(F.col("archetype") == "foundation", F.concat(F.lit("a definition that others build on ("), "kind", F.lit(")"))).when(in_flow, F.concat(F.lit("the "), "flow_part", F.lit(" of the "), "flow_name")).otherwise(F.coalesce("part", "inferred_role"))
    where = F.when(F.col("container_name").isNotNull(), F.concat(F.lit(" in "), "container_name")).otherwise(F.lit(""))
    f = f.withColumn("explanation", F.concat("name", F.lit(" "), verb, F.lit(" "), what, where, F.lit(".")))
    reach = F.concat(F.col("downstream").cast("string"), F.lit(" entities up to depth "), F.col("downstream_depth").cast("string"))
    why = (
        F.when(F.col("importance_category") == "pipeline-choke-point", F.concat(F.lit("Few call it, but "), reach, F.lit(" depend on it.")))
        .when(F.col("importance") == "high", F.concat(F.lit("Widely used: "), F.col("dependents").cast("string"), F.lit(" dependents, "), F.col("importers").cast("string"), F.lit(" importers.")))
        .when(F.col("importance") == "low", F.lit("Little depends on it."))
        .otherwise(F.concat(F.lit("Changes reach "), reach, F.lit(".")))
    )
    names = F.coalesce("top_callers", F.array().cast("array<string>"))
    used = F.when(F.size(names) > 0, F.concat(F.lit("Used by "), F.array_join(names, ", "), F.when(F.col("callers") > F.size(names), F.concat(F.lit(" and "), (F.col("callers") - F.size(names)).cast("string"), F.lit(" more"))).otherwise(F.lit("")), F.lit(".")))
    return f.withColumn("why", why).withColumn("used_by", used)


def impact(targets: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, planning: DataFrame | None = None) -> DataFrame:
    """One row for each of targets(id): what a change of it reaches, with category and risk.

    Containers: members, importers and dependents within depth, callers of their
    members, and the regions of all of these.  Leaves: callers within depth,
    callees, and the regions of the callers.  planning(src, dst, predicate) are
    decisions, tasks and bugs that affect the target.
    """
    t = targets.select("id").distinct().join(nodes.select("id", "kind", "name", "path"), "id").withColumn("container", F.lower("kind").isin(*A.CONTAINERS))
    ids = t.select("id")
    one = lambda rows, name: rows.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    members = W.expand(edges, ids, "out", ["CONTAINS"]).select("id", F.col("there").alias("member")).distinct()
    importers = W.hops(edges, ids, "in", ["IMPORTS"], depth)
    dependents = W.hops(edges, ids, "in", ["CALLS", "REFERENCES"], depth)
    callees = W.expand(edges, ids, "out", ["CALLS", "REFERENCES"]).select("id", "there").distinct()
    calls = edges.where("predicate in ('CALLS', 'REFERENCES')").select(F.col("src").alias("caller"), F.col("dst").alias("member")).distinct()
    per_member = members.join(calls, "member").groupBy("id", "member").agg(F.count(F.lit(1)).alias("n"))
    member_callers = per_member.groupBy("id").agg(F.sum("n").alias("member_callers"), F.max_by("member", F.struct("n", "member")).alias("top_member"))
    touched = importers.join(t.where("container").select("id"), "id").unionByName(dependents).distinct()
    regions = nearest_region(touched.select("there").distinct().withColumnRenamed("there", "id"), nodes, edges)
    buckets = touched.join(regions.withColumnRenamed("id", "there"), "there", "left").groupBy("id", F.coalesce("region", F.lit("(unmapped)")).alias("region")).agg(F.count(F.lit(1)).alias("n"))
    spread = buckets.groupBy("id").agg(F.count_if(F.col("region") != "(unmapped)").alias("buckets"), F.sum("n").alias("propagated"), F.max(F.when(F.col("region") != "(unmapped)", F.struct("n", "region"))).alias("most"))
    rows = t
    for extra in (one(members, "members"), one(importers, "importers_all"), one(dependents, "dependents_all"), one(callees, "callees_all"), member_callers, spread):
        rows = rows.join(extra, "id", "left")
    if planning is not None:
        plans = planning.groupBy(F.col("dst").alias("id")).agg(*[F.count_if(F.col("predicate") == p).alias(n) for n, p in (("decisions", "DECISION_AFFECTS"), ("tasks", "TASK_AFFECTS"), ("bugs", "BUG_AFFECTS"))])
        rows = rows.join(plans, "id", "left")
    else:
        rows = rows.withColumns({n: F.lit(0) for n in ("decisions", "tasks", "bugs")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = F.col("container")
    rows = rows.select(
        "id", "kind", "name", "path", inside.alias("is_container"), F.when(inside, zero("members")).otherwise(0).alias("members"), F.when(inside, 0).otherwise(zero("dependents_all")).alias("callers"), F.when(inside, 0).otherwise(zero("callees_all")).alias("callees"), F.when(inside, zero("importers_all")).otherwise(0).alias("importers"),
        F.when(inside, zero("dependents_all")).otherwise(0).alias("dependents"), F.when(inside, zero("member_callers")).otherwise(0).alias("member_callers"), F.when(inside, F.col("top_member")).alias("top_member"), zero("buckets").alias("buckets"), zero("propagated").alias("propagated"), F.col("most.region").alias("most_affected"), zero("decisions").alias("decisions"), zero("tasks").alias("tasks"), zero("bugs").alias("bugs"),
    )
    return A.risk(rows)


def nearest_region(members: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("region", "module", "subsystem", "system")) -> DataFrame:
    """(id, region): the most specific region of each of members(id), by its container's if it is in none itself."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    above = W.ancestors(edges).join(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("ancestor"), "kind", "name"), "ancestor")
    best = above.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "distance", "name")).alias("b")).select(F.col("id").alias("holder"), F.col("b.name").alias("region"))
    held = W.effective_regions(nodes.join(members.select("id"), "id", "left_semi"), edges)
    return held.join(best, "holder").select("id", "region")


def risk_words(f: DataFrame) -> DataFrame:
    """f (as impact() gives it) with flow, part, noun and, in words, summary, at_risk, hint, next_step and what propagates along the flow."""
    tokens = words(F.col("name"), F.col("path"))
    f = f.withColumn("_tokens", tokens).withColumn("flow", _first(FLOWS, F.col("_tokens"))).withColumn("about", _first(FLOWS, F.col("_tokens"), 1)).withColumn("flow_role", flow_role(F.col("name"), F.col("_tokens"))).withColumn("noun", noun(F.col("name")))
    level = F.initcap(F.when(F.col("risk_level") == "critical", "high").otherwise(F.col("risk_level")))
    layers = F.coalesce(F.concat(F.lit("the "), X.humanize(F.col("most_affected"))), F.lit("what depends on it"))
    thing = F.when(F.col("noun") == "domain", "type").otherwise(F.col("noun"))
    c = F.col("category")
    summary = (
        F.when(c == "foundation", F.concat(level, F.lit(" risk: a shared "), thing, F.lit(" is read across "), layers))
        .when(c == "boundary", F.concat(level, F.lit(" risk: calls to services pass through "), "name"))
        .when(c == "flow", F.concat(level, F.lit(" risk to "), F.coalesce("flow_role", "about"), F.lit(" in the "), "flow", F.lit(" flow")))
        .when(c == "shared", F.concat(level, F.lit(" risk: widely shared across "), layers))
        .when(c == "localized", F.concat(level, F.lit(" risk: few callers")))
        .otherwise(F.concat(level, F.lit(" risk to dependent code")))
    )
    at_risk = (
        F.when(c == "foundation", F.array(F.concat(F.lit("meaning of "), thing), F.when(F.col("importers") >= 2, F.concat(F.col("importers").cast("string"), F.lit(" importing modules"))), F.when(F.col("members") > 0, "services that use its types").otherwise("code that uses it")))
        .when(c == "boundary", F.array(F.lit("commands that call services"), F.when(F.col("members") > 5, F.concat(F.col("members").cast("string"), F.lit(" client methods"))).otherwise("the client layer")))
        .when(c == "flow", F.array(F.concat(F.coalesce("flow_role", "about"), F.lit(" results")), F.concat(F.lit("later steps of the "), "flow", F.lit(" flow")), F.when(F.col("callers") > 0, "its callers")))
        .when(c == "shared", F.array(F.lit("callers in several regions"), F.when(F.col("callees") > 0, "what it coordinates")))
        .when(c == "localized", F.array(F.lit("its callers")))
        .otherwise(F.array(F.lit("dependent code")))
    )
    hint = F.when(c == "foundation", F.concat(F.lit("modules that read "), thing)).when(c == "boundary", "command handlers").when(c == "flow", F.concat(F.lit("callers in the "), "flow", F.lit(" flow"))).when(c == "shared", "callers in several regions")
    step = F.when(c.isin("foundation", "shared") & (F.col("importers") >= 3), "explain").when((c == "boundary") & (F.col("member_callers") >= 10), "depends").when((c == "flow") & (F.col("callers") >= 1), "depends")
    f = f.withColumns({"summary": summary, "at_risk": F.array_compact(at_risk), "hint": hint, "next_step": step, "flow_propagation": F.when((c == "flow") & (F.col("propagated") > 0), F.col("propagated"))})
    return f.drop("_tokens")
