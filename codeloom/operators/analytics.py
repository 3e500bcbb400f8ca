"""Ranking, facts, role and risk inference, smells, coupling and regions, over nodes and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.textindex import names_with
from codeloom.tables import bucketed, dropped, small, stored

if TYPE_CHECKING:
    import pyarrow as pa

#: Fixed values.
CONTAINERS = ("class", "object", "trait", "interface", "module", "file")
CALLABLES = ("function", "method")
TYPES = ("interface", "type", "type_alias", "enum", "sealed_trait", "trait", "abstract_class")
MODEL_WORDS = ("model", "models", "schema", "db", "database", "entity", "entities", "domain")
#: Words that place a name in a flow.
FLOW_WORDS = {
    "conflict-resolution": ("conflict", "merge", "conflicts"), "resolution": ("resolve", "resolution", "match", "select", "pick", "lookup", "resolver", "matcher", "selector"),
    "parsing": ("parse", "decode", "read", "tokenize", "lex", "parser", "decoder", "reader", "lexer"), "impact analysis": ("impact",), "explanation": ("explain", "render"),
    "ingestion": ("ingest", "store", "persist", "save", "ingestion"), "scoring": ("score", "rank", "weight", "evaluate"),
}


def rank_by(edges: DataFrame, nodes: DataFrame, predicates: list[str], kind: str, n: int = 10, of: str = "dst") -> DataFrame:
    """Top n nodes of a kind by distinct neighbours; ties by id."""
    other = "src" if of == "dst" else "dst"
    pairs = edges.where(F.col("predicate").isin(predicates)).select(F.col(of).alias("id"), F.col(other).alias("other"))
    pairs = pairs if len(predicates) == 1 else pairs.distinct()  # edges of one predicate are distinct already
    degree = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("score"))
    return degree.join(nodes.where(F.col("kind") == kind).select("id", "name"), "id").orderBy(F.desc("score"), "id").limit(n).select("id", "name", "score")


def path_filter(nodes: DataFrame, include: str | None = None, exclude: str | None = None, not_kinds: tuple[str, ...] = ()) -> DataFrame:
    if include:
        nodes = nodes.where(F.contains("path", F.lit(include)))
    if exclude:
        nodes = nodes.where(~F.contains("path", F.lit(exclude)))
    return nodes.where(~F.col("kind").isin(*not_kinds)) if not_kinds else nodes


def role_filter(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tests and fixtures are hidden unless a group has nothing else; hidden says how many a group hides."""
    group = by or []
    other = F.col("role").isin("test", "fixture")
    counts = rows.groupBy(*group).agg(F.count_if(~other).alias("shown"), F.count_if(other).alias("tests"))
    joined = rows.join(counts, group) if group else rows.crossJoin(F.broadcast(counts))  # one row
    return joined.where(~other | (F.col("shown") == 0)).withColumn("hidden", F.when(F.col("shown") > 0, F.col("tests")).otherwise(F.lit(0))).drop("shown", "tests")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, callers, importers, dependents, callees, members, container_id): distinct neighbours of every node by kind of edge.

    An edge counts once at either end: both ends of every (src, dst) go into one
    group-by of the pair and then one of the node, with conditional counts, so
    no edge is multiplied by the number of counts.  Pairs are dealt by src, so what
    leaves a node is one row before the second group-by is shuffled.
    """
    call, imp, con = F.col("predicate").isin("CALLS", "REFERENCES"), F.col("predicate") == "IMPORTS", F.col("predicate") == "CONTAINS"
    dealt = edges.where(call | imp | con).select("src", "dst", call.alias("call"), imp.alias("imp"), con.alias("con")).repartition("src")
    pair = dealt.groupBy("src", "dst").agg(F.max("call").alias("call"), F.max("imp").alias("imp"), F.max("con").alias("con"))
    ends = pair.select("call", "imp", "con", F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(True).alias("into")), F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(False).alias("into")))).alias("e"))
    into, out = F.col("e.into"), ~F.col("e.into")
    return ends.groupBy(F.col("e.id").alias("id")).agg(
        F.count_if(into & F.col("call")).alias("callers"), F.count_if(into & F.col("imp")).alias("importers"), F.count_if(into & (F.col("call") | F.col("imp"))).alias("dependents"), F.count_if(out & F.col("call")).alias("callees"), F.count_if(out & F.col("con")).alias("members"),
        F.min(F.when(into & F.col("con"), F.col("e.other"))).alias("container_id"),
    )


def facts(nodes: DataFrame, edges: DataFrame, names: bool = True) -> DataFrame:
    """One row per node: callers, callees, dependents, importers, members, and container, computed for all at once; names says whether with its container's name and kind."""
    out = nodes.join(degrees(edges), "id", "left")
    for c in ("callers", "importers", "dependents", "callees", "members"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    if not names:
        return out
    parent = nodes.select(F.col("id").alias("container_id"), F.col("name").alias("container_name"), F.col("kind").alias("container_kind"))
    return out.join(parent, "container_id", "left")


def importance(callers: Column, dependents: Column, importers: Column, members: Column, downstream: Column) -> tuple[Column, Column]:
    """(level, category): choke point, then broad, then low, then medium."""
    high = (callers >= 8) | (dependents >= 10) | (importers >= 5) | ((members >= 10) & (callers >= 3))
    choke = (callers <= 2) & (downstream >= 8)
    low = (dependents == 0) & (callers <= 1) & (importers == 0) & (members <= 1) & (downstream <= 1)
    local = (callers <= 2) & (downstream <= 3) & ~high
    level = F.when(choke | high, "high").when(low, "low").otherwise("medium")
    category = F.when(choke, "pipeline-choke-point").when(high, "broad-shared-dependency").when(local, "localized-helper").otherwise("normal")
    return level, category


def infer_role(f: DataFrame) -> DataFrame:
    """f (as facts() gives it) with inferred_role: the first rule that holds.  Member names are counted in client_members where that column exists."""
    name, path, kind = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("path", F.lit(""))), F.lower("kind")
    t = X.tokens(F.coalesce(F.col("name"), F.lit("")))
    callable_, named = kind.isin(*CALLABLES), lambda *terms: X.contains_any(name, *terms) | X.contains_any(path, *terms)
    client = F.col("client_members") if "client_members" in f.columns else F.lit(0)
    services = ("service", "manager", "provider", "handler", "controller", "coordinator")
    rules = [
        ("test", F.rlike(path, F.lit(r"[/\\](tests?|spec|__tests__)[/\\]|\.(test|spec)\.[a-z]+$")) | X.has_any(t, "test", "spec")),
        ("configuration", (kind == "config_entry") | named("config", ".env", ".yaml", ".yml", ".toml")),
        ("type-definition", kind.isin("interface", "type", "type_alias") | X.has_any(t, "type", "props", "schema")),
        ("api-client", (kind == "class") & (((X.has_any(t, "client", "api") | X.contains_any(path, "api", "client", "http")) & ((client >= 2) | (F.col("members") > 2))) | ((client >= 2) & (F.col("members") > 3) & (F.col("callees") > 0)))),
        ("registration-function", callable_ & (F.get(t, 0) == "register")),
        ("selection-helper", callable_ & X.has_any(t, "pick", "best", "select", "choose", "rank", "filter")),
        ("scoring-helper", callable_ & (X.has_any(t, "score", "weight", "rank", "rate", "evaluate") | X.contains_any(path, "importance", "ranking", "score", "weight"))),
        ("resolution-helper", callable_ & (F.col("callees") > 0) & (X.has_any(t, "resolve", "resolver", "lookup", "match") | X.contains_any(path, "resolve", "match", "lookup"))),
        ("data-model", (kind == "class") & (X.has_any(t, "model", "entity", "record", "dto") | ((F.col("callers") > 0) & (F.col("callees") == 0) & (F.col("members") <= 2)))),
        ("entry-point", callable_ & (F.col("callers") == 0) & (F.col("callees") > 0)),
        ("service", kind.isin("class", "object") & (F.col("members") > 2) & X.has_any(t, *services)),
        ("service-method", callable_ & (F.lower(F.coalesce("container_kind", F.lit(""))) == "class") & X.has_any(X.tokens(F.coalesce(F.col("container_name"), F.lit(""))), *services)),
        ("adapter", named("adapter", "connector", "gateway", "proxy")),
        ("orchestrator", (F.col("callees") >= 5) & (F.col("callers") <= 2)),
        ("container", kind.isin("file", "module") & (F.col("members") > 0)),
        ("shared-utility", (F.col("callers") >= 3) & (F.col("members") == 0) & (F.col("callees") <= 2)),
        ("localized-helper", callable_ & ((F.coalesce("container_name", F.lit("")) != "") | (path != "") | (F.col("callers").between(1, 2) & (F.col("callees") > 0)))),
        ("localized-helper", kind.isin("class", "object")),
    ]
    role = F.when(F.coalesce(rules[0][1], F.lit(False)), F.lit(rules[0][0]))
    for label, cond in rules[1:]:
        role = role.when(F.coalesce(cond, F.lit(False)), F.lit(label))
    return f.withColumn("inferred_role", role.otherwise("unknown"))


def risk(f: DataFrame) -> DataFrame:
    """category and risk_level of f(kind, name, path, callers, callees, importers, dependents, member_callers, buckets)."""
    kind, t = F.lower("kind"), X.word_tokens(F.concat_ws(" ", "name", F.regexp_replace(X.basename(F.col("path")), r"\.[^.]+$", "")))
    container, callable_ = kind.isin(*CONTAINERS), kind.isin(*CALLABLES)
    flow = X.has_any(t, *[w for words in FLOW_WORDS.values() for w in words])
    total = F.col("importers") + F.col("dependents") + F.col("member_callers")
    category = (
        F.when(kind.isin(*TYPES), "foundation")
        .when((kind == "file") & X.has_any(t, *MODEL_WORDS) & (F.col("members") > 0), "foundation")
        .when(container & X.has_any(X.word_tokens(F.col("name")), "client", "adapter"), "boundary")
        .when(container & X.has_any(t, "client", "api", "backend") & ((F.col("callers") > 5) | (F.col("member_callers") > 10)), "boundary")
        .when(flow & callable_, "flow")
        .when(flow & container & X.has_any(t, "service"), "flow")
        .when(container & ((F.col("importers") >= 5) | (F.col("dependents") >= 8) | (F.col("member_callers") >= 20)), "shared")
        .when(callable_ & (F.col("callers") >= 5), "shared")
        .when(F.col("callers") + F.col("importers") + F.col("dependents") <= 2, "localized")
        .otherwise("unknown")
    )
    f = f.withColumn("category", category)
    c = F.col("category")
    level = (
        F.when(c == "foundation", F.when((F.col("importers") >= 5) | (total >= 10), "critical").when((F.col("importers") >= 2) | (total >= 4), "high").otherwise("medium"))
        .when(c == "boundary", F.when((F.col("member_callers") >= 30) | (F.col("buckets") >= 3), "critical").when((F.col("member_callers") >= 10) | (total >= 10), "high").otherwise("medium"))
        .when(c == "flow", F.when((F.col("callers") >= 5) | (total >= 10), "high").when((F.col("callers") >= 2) | (F.col("callees") >= 3), "medium").otherwise("low"))
        .when(c == "shared", F.when((total >= 15) | (F.col("buckets") >= 3), "high").otherwise("medium"))
        .when(c == "localized", "low")
        .otherwise(F.when(total >= 10, "medium").otherwise("low"))
    )
    return f.withColumn("risk_level", level)


def smells(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("file", "class"), chunks: int = 20, fan: int = 15) -> DataFrame:
    """(id, smell, confidence): orphans, god modules and weak components.  Confidences are this engine's own."""
    both = edges.where("predicate <> 'IN_REGION'").select(F.col("src").alias("id"), F.col("dst").alias("other"), (F.col("predicate") == "CONTAINS").alias("member"))
    both = both.unionByName(edges.where("predicate not in ('IN_REGION', 'CONTAINS')").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("member")))
    once = both.groupBy("id", "other").agg(F.max(~F.col("member")).alias("linked"), F.max("member").alias("member"))
    degree = once.groupBy("id").agg(F.count_if("linked").alias("fan"), F.count_if("member").alias("chunks"))
    f = nodes.where(F.col("kind").isin(*kinds)).select("id", "kind").join(degree, "id", "left").select("id", F.coalesce("fan", F.lit(0)).alias("fan"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    god = (F.col("chunks") >= chunks) | (F.col("fan") >= fan)
    god_confidence = F.least(F.lit(1.0), F.lit(0.5) + 0.25 * (F.col("chunks") >= chunks).cast("int") + 0.25 * (F.col("fan") >= fan).cast("int"))
    each = lambda cond, label, conf: f.where(cond).select("id", F.lit(label).alias("smell"), conf.cast("double").alias("confidence"))
    return each((F.col("fan") == 0) & (F.col("chunks") == 0), "orphan", F.lit(0.8)).unionByName(each(god, "god_module", god_confidence)).unionByName(each((F.col("fan") == 1) & (F.col("chunks") <= 1), "weak_component", F.lit(0.6)))


#: Weights of predicates in the coupling of files (this engine's own).
WEIGHTS = {"IMPORTS": 3.0, "CALLS": 2.0, "REFERENCES": 1.0, "EXTENDS": 2.0}


def coupling(edges: DataFrame, file_of: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: weighted edges between files; file_of(id, file) says where a node lives."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("predicate")), F.lit(0.0))
    rows = edges.where(F.col("predicate").isin(*WEIGHTS)).withColumn("w", weight)
    rows = rows.join(file_of.select(F.col("id").alias("src"), F.col("file").alias("fa")), "src").join(file_of.select(F.col("id").alias("dst"), F.col("file").alias("fb")), "dst").where("fa <> fb")
    return rows.groupBy(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).agg(F.sum("w").alias("weight"))


#: Weights and resolutions are whole numbers of these parts; movers are drawn with so many chances of CHANCES, at most MOST.
PARTS_OF_ONE, CHANCES, MOST = 1000, 1024, 512
#: Nodes that gain move one by one, in one task, once they have no more links than this together; and equal gains are dealt into so many cells.
IN_TURN, CELLS = 500_000, 64


def _turns(total: int, weight: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Moves one by one, each judged after those before it: links (id, k, gain, own, own_mass, other, w, near, near_mass) of some nodes to (id, to) of those that end elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        t = {c: v.to_numpy() for c, v in zip(batches[0].schema.names, pa.Table.from_batches(batches).columns, strict=True)}
        order = np.lexsort((t["other"], t["id"]))
        t = {c: v[order] for c, v in t.items()}
        ids, first, count = np.unique(t["id"], return_index=True, return_counts=True)
        names, at = np.unique(np.concatenate([t["own"][first], t["near"]]), return_inverse=True)
        mass = np.zeros(len(names), np.int64)
        mass[at] = np.concatenate([t["own_mass"][first], t["near_mass"]])
        start, place = at[: len(ids)].copy(), at[: len(ids)].copy()
        # Neighbours that move too are looked up where they are now.
        known = np.minimum(np.searchsorted(ids, t["other"]), len(ids) - 1)
        moving, still, w, k = ids[known] == t["other"], at[len(ids) :], t["w"], t["k"][first]
        turn = np.lexsort((ids, -t["gain"][first]))
        for _ in range(50):
            moved = False
            for i in turn:
                s = slice(first[i], first[i] + count[i])
                near, where = np.unique(np.where(moving[s], place[known[s]], still[s]), return_inverse=True)
                here, ki = int(place[i]), int(k[i])
                links = np.bincount(where, w[s]).astype(np.int64)
                inside = int(links[near == here].sum())
                rise = float(total) * PARTS_OF_ONE * (links - inside) - float(weight) * ki * (mass[near] - mass[here] + ki).astype(float)
                rise[near == here] = -np.inf
                # Floats leave a few to be told apart in whole numbers.
                slack = 1e-12 * (float(total) * PARTS_OF_ONE * float(links.max()) + float(weight) * ki * float(total))
                some = np.flatnonzero(rise >= max(rise.max(), 0.0) - slack)
                exact = [(total * PARTS_OF_ONE * (int(links[c]) - inside) - weight * ki * (int(mass[near[c]]) - int(mass[here]) + ki), -int(near[c])) for c in some if near[c] != here]
                gain, to = max(exact, default=(0, 0))
                if gain > 0:
                    mass[here] -= ki
                    mass[-to] += ki
                    place[i], moved = -to, True
            if not moved:
                break
        out = place != start
        yield pa.RecordBatch.from_arrays([pa.array(ids[out], pa.int64()), pa.array(names[place[out]], pa.int64())], names=["id", "to"])

    return run


def communities(links: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community): a state of links(a, b, weight) in which no move of a single node to a neighbouring community raises modularity.

    With whole weights w, degrees k, their sums K by community and 2m over all, modularity is, times 4m^2,
        2m (sum of w within communities) - resolution (sum of K^2),
    and the gain of a move from A to B is
        2m (w(i, B) - w(i, A)) - resolution k(i) (K(B) - K(A) + k(i)),
    all in whole numbers, so every run gives the same communities, however the tables lie.

    In every round the nodes that would gain are drawn by hash with some chance, and those drawn move at once, as long as
    the degrees of those with a higher gain that come to the same community or leave the same one do not use the gain up.
    Moves that are made at once may still spoil each other's gain, by links among them, so the modularity that results is
    what decides: if it has not risen, the round is taken back and the chance halved, down to the single best move, which
    always raises it; else the chance grows again.  So modularity rises with every round that stands, until there is no
    gain left.  Once those that would gain have few links together (IN_TURN), they move one by one in one task, each judged
    after those before it, which always raises modularity; a round over all nodes finds who gains then.

    Links are stored in buckets by node, so that a round meets the weights of a node's communities without a shuffle.
    """
    from codeloom.operators.revisions import numbered

    kept = links if hasattr(links, "_codeloom_path") else stored(links)
    apart = kept.where("a <> b")
    names = stored(numbered(apart.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "name", "id").select("id", "name"))
    at = lambda c: small(names.select(F.col("id").alias(f"n{c}"), F.col("name").alias(c)), names)
    whole = F.round(F.col("weight") * PARTS_OF_ONE).cast("long").alias("w")
    ends = apart.join(at("a"), "a").join(at("b"), "b").select(F.explode(F.array(F.struct(F.col("na").alias("id"), F.col("nb").alias("other"), whole), F.struct(F.col("nb").alias("id"), F.col("na").alias("other"), whole))).alias("e"))
    both = bucketed(ends.select("e.*"), "id", lambda rows: rows.groupBy("id", "other").agg(F.sum("w").alias("w")))
    if kept is not links:
        dropped(kept)
    big = lambda c: c.cast("decimal(20, 0)")
    degree = stored(both.groupBy("id").agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("n")).withColumn("community", F.col("id")))
    total, weight = int(degree.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]), round(resolution * PARTS_OF_ONE)
    scaled, parts = F.lit(total).cast("decimal(20, 0)") * F.lit(PARTS_OF_ONE).cast("decimal(4, 0)"), F.lit(weight).cast("decimal(10, 0)")

    def placed(now: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(community, mass) of the stored now(id, community, k, n), and now with its own community's."""
        size = now.groupBy("community").agg(F.sum("k").alias("mass"))
        return size, now.join(small(size, now), "community").select("id", "k", "n", F.col("community").alias("own"), F.col("mass").alias("own_mass"))

    def moves(now: DataFrame) -> DataFrame:
        """(id, k, n, own, inside, to, gain): the best move of each node of the stored now(id, community, k, n); of equal ones to the least community, to none without a gain."""
        size, own = placed(now)
        near = both.join(small(now.select(F.col("id").alias("other"), "community"), now), "other").groupBy("id", "community").agg(F.sum("w").alias("w"))
        rows = near.join(small(own, now), "id").join(small(size, now), "community")
        other = F.col("community") != F.col("own")
        # What the gain has of the community: the rest is the same for all of a node's.
        loss = (big(F.col("k")) * big(F.col("mass")) * parts - big(F.col("w")) * scaled).cast("decimal(38, 0)")
        best = rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("k", "n", "own", "own_mass")], F.min(F.when(other, F.struct(loss.alias("loss"), "community"))).alias("b"), F.coalesce(F.sum(F.when(~other, F.col("w"))), F.lit(0)).alias("inside"))
        gain = (-F.col("b.loss") - big(F.col("inside")) * scaled - big(F.col("k")) * big(F.col("k") - F.col("own_mass")) * parts).cast("decimal(38, 0)")
        best = best.select("id", "k", "n", "own", "inside", F.col("b.community").alias("to"), gain.alias("gain"))
        return best.select("id", "k", "n", "own", "inside", *[F.when(F.col("gain") > 0, F.col(c)).alias(c) for c in ("to", "gain")])

    def state(best: DataFrame) -> tuple[int, int, int]:
        """Modularity times 4m^2 and parts of one, how many nodes would gain, and how many links they have."""
        by = best.groupBy("own").agg(F.sum("k").alias("mass"), F.sum("inside").alias("inside"), F.count("to").alias("n"), F.sum(F.when(F.col("to").isNotNull(), F.col("n"))).alias("links"))
        row = by.agg(F.sum((big(F.col("mass")) * big(F.col("mass"))).cast("decimal(38, 0)")).alias("square"), *[F.sum(c).alias(c) for c in ("inside", "n", "links")]).first()
        return total * int(row.inside or 0) * PARTS_OF_ONE - weight * int(row.square or 0), int(row.n or 0), int(row.links or 0)

    def room(drawn: DataFrame) -> DataFrame:
        """(id, to) of the drawn whose gain is left after all those that come to or leave a community before them, or along with them in a cell of like gains."""
        digits = F.col("gain").cast("string")
        rows = drawn.select("id", "k", "own", "to", "gain", (F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")).alias("step"), F.pmod(F.xxhash64("id"), F.lit(CELLS)).alias("cell"))
        for c in ("to", "own"):
            cells = rows.groupBy(c, "step", "cell").agg(F.sum("k").alias("sum"))
            before = cells.select(c, "step", "cell", F.sum("sum").over(Window.partitionBy(c).orderBy(F.desc("step"), "cell")).alias(f"{c}_sum"))
            rows = rows.join(before, [c, "step", "cell"])
        return rows.where(F.col("gain") > big(F.col("k")) * big(F.col("to_sum") + F.col("own_sum") - 2 * F.col("k")) * parts).select("id", "to")

    def in_turn(best: DataFrame, now: DataFrame) -> DataFrame:
        """(id, to): moves one by one of those that would gain."""
        size, own = placed(now)
        some = best.where("to is not null").select("id", F.col("gain").cast("double").alias("gain")).join(small(own, now), "id")
        rows = both.join(small(some, now), "id").join(small(now.select(F.col("id").alias("other"), F.col("community").alias("near")), now), "other").join(small(size.select(F.col("community").alias("near"), F.col("mass").alias("near_mass")), now), "near")
        return rows.select("id", "k", "gain", "own", "own_mass", "other", "w", "near", "near_mass").repartition(1).mapInArrow(_turns(total, weight), "id long, to long")

    now = degree
    best = stored(moves(now))
    (height, n, count), chance, turn = state(best), MOST, 0
    while n:
        few = count <= IN_TURN
        if few:
            chosen = in_turn(best, now)
        elif chance * n < CHANCES:
            chosen = best.where("to is not null").orderBy(F.desc("gain"), "id").limit(1).select("id", "to")
        else:
            chosen = room(best.where(F.col("to").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(CHANCES)) < chance)))
        then = stored(now.join(chosen, "id", "left").select("id", F.coalesce("to", "community").alias("community"), "k", "n"))
        after = stored(moves(then))
        reached, m, links_left = state(after)
        turn += 1
        if reached > height:
            dropped(best, now)
            now, best, height, n, count, chance = then, after, reached, m, links_left, min(MOST, chance * 3 // 2 + 1)
        else:
            dropped(after, then)
            chance //= 2
    dropped(both, best)
    name = lambda c, to: small(names.select(F.col("id").alias(c), F.col("name").alias(to)), names)
    return now.select("id", "community").withColumnRenamed("community", "own").join(name("own", "community"), "own").join(name("id", "name"), "id").select(F.col("name").alias("id"), "community")


def modularity(links: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of member(id, community) on links(a, b, weight)."""
    at = lambda c: member.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    rows = links.where("a <> b").join(at("a"), "a").join(at("b"), "b")
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    inside = rows.agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.lit(0.0))).first()[0]
    spread = rows.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))).first()[0]
    return inside / total - resolution * spread / (2 * total) ** 2


def gains(links: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, gain): the best rise of modularity (times 2m^2) that moving each node of member(id, community) to a neighbouring community would bring; 0 without one."""
    both = links.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(links.where("a <> b").select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    degree = both.groupBy("id").agg(F.sum("weight").alias("k"))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    of = member.join(degree, "id")
    size = of.groupBy("community").agg(F.sum("k").alias("mass"))
    near = both.join(member.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.sum("weight").alias("w"))
    own = of.join(size, "community").select("id", F.col("community").alias("own"), "k", F.col("mass").alias("own_mass"))
    inside = own.join(near, (own.id == near.id) & (own.own == near.community), "left").select(own.id, "own", "k", "own_mass", F.coalesce("w", F.lit(0.0)).alias("inside"))
    rows = near.join(inside, "id").where("community <> own").join(size, "community")
    best = rows.groupBy("id").agg(F.max(total * (F.col("w") - F.col("inside")) - resolution * F.col("k") * (F.col("mass") - F.col("own_mass") + F.col("k"))).alias("gain"))
    return member.select("id").join(best, "id", "left").select("id", F.greatest(F.coalesce("gain", F.lit(0.0)), F.lit(0.0)).alias("gain"))


def region_links(edges: DataFrame, file_of: DataFrame, member: DataFrame) -> DataFrame:
    """(ra, a, rb, b, weight): a row for each weighted edge between files of member(id, region); several between two files are not summed.

    Regions come with the files, so no links of files are shuffled to be summed or placed; edges meet what they point to
    first, and those to files in no region end there.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("predicate")), F.lit(0.0))
    held = file_of.join(member.select(F.col("id").alias("file"), "region"), "file")
    at = lambda end, c: held.select(F.col("id").alias(end), F.col("file").alias(c), F.col("region").alias(f"r{c}"))
    rows = edges.where(F.col("predicate").isin(*WEIGHTS)).select("src", "dst", weight.alias("weight"))
    return rows.join(at("dst", "b"), "dst").join(at("src", "a"), "src").where("a <> b").select("ra", "a", "rb", "b", "weight")


def region_scores(links: DataFrame, member: DataFrame) -> DataFrame:
    """Per region: files, internal and external weight, cohesion, boundary ratio and confidence, of region_links() of member(id, region)."""
    weight, inside, none = F.col("weight"), F.col("ra") == F.col("rb"), F.lit(None).cast("double")
    # An inner link counts once, an outer one for both ends.
    ends = [F.struct(F.col("ra").alias("region"), F.col("a").alias("id"), F.when(inside, weight).alias("internal"), F.when(~inside, weight).alias("external")), F.struct(F.col("rb").alias("region"), F.col("b").alias("id"), none.alias("internal"), F.when(~inside, weight).alias("external"))]
    files = links.select(F.explode(F.array(*ends)).alias("e")).select("e.*").where("internal is not null or external is not null").groupBy("region", "id").agg(F.sum("internal").alias("internal"), F.sum("external").alias("external"))
    sums = files.groupBy("region").agg(F.sum("internal").alias("internal"), F.sum("external").alias("external"), F.count("external").alias("boundary"))
    out = member.groupBy("region").agg(F.count(F.lit(1)).alias("files")).join(sums, "region", "left")
    for c in ("internal", "external", "boundary"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    cohesion = F.when(F.col("internal") + F.col("external") > 0, F.col("internal") / (F.col("internal") + F.col("external"))).otherwise(0.0)
    out = out.withColumn("cohesion", F.round(cohesion, 4)).withColumn("boundary_ratio", F.round(F.col("boundary") / F.col("files"), 4))
    out = out.withColumn("confidence", F.round(cohesion * (1 - F.col("boundary") / F.col("files")), 4))
    return out.withColumn("label", F.when(F.col("confidence") >= 0.75, "Well-defined").when(F.col("confidence") >= 0.5, "Moderate").otherwise("Fuzzy"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def resolve_scores(candidates: DataFrame, symbols: DataFrame, want_kind: str | None = None, want_path: str | None = None) -> DataFrame:
    """candidates(id, kind, name, path) for each of symbols(symbol) that their name contains, with a score: lower is better."""
    name, sym, kind = F.lower("name"), F.lower("symbol"), F.lower("kind")
    rows = names_with(candidates, name, symbols, sym)
    score = F.when(name == sym, 0).when(F.startswith(name, sym), 15).otherwise(30)
    if want_kind:
        score = score - F.when(kind == want_kind.lower(), 5).otherwise(0)
    score = score - F.when(kind.isin("class", "object", "trait", "interface", "module", "file"), 3).when(kind.isin("function", "method"), 1).when(kind == "chunk", -5).otherwise(0)
    score = score - F.when(F.rlike("symbol", F.lit("^[A-Z][A-Za-z0-9]*$")) & (name == sym) & kind.isin("class", "interface", "trait", "object"), 4).otherwise(0)
    if want_path:
        p = F.lit(want_path.lower().replace("\\", "/"))
        uri = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
        score = score - F.when(F.contains(uri, p), 4 + X.js_round(F.length(p) / F.greatest(F.length(uri), F.lit(1)) * 6)).otherwise(0)
    return rows.withColumn("score", score.cast("int"))


def resolve_verdicts(scored: DataFrame, preferred: tuple[str, ...] = ("class", "interface", "function", "method", "file")) -> DataFrame:
    """One row per symbol of scored(symbol, id, kind, score): the pick and how it was made, or ambiguous."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in preferred]), F.col("kind")), F.lit(0)), F.lit(len(preferred) + 1))
    w = Window.partitionBy("symbol").orderBy("score", "kind_rank", "id")
    every = Window.partitionBy("symbol")
    rows = scored.withColumn("kind_rank", rank).withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(every)).withColumn("best", F.min("score").over(every))
    rows = rows.withColumn("second_score", F.lead("score").over(w)).withColumn("second_kind", F.lead("kind").over(w)).withColumn("second_rank", F.when(F.lead("score").over(w) == F.col("score"), F.lead("kind_rank").over(w)))
    rows = rows.where("rn = 1")
    how = (
        F.when(F.col("n") == 1, "sole").when(F.col("score") + 3 <= F.col("second_score"), "gap").when(F.col("second_score") > F.col("score"), "tier")
        .when(F.col("second_rank") > F.col("kind_rank"), "preferred-kind").when(F.col("kind").isin(*CONTAINERS) & ~F.col("second_kind").isin(*CONTAINERS), "container").otherwise("ambiguous")
    )
    return rows.select("symbol", "n", how.alias("verdict"), F.when(how != "ambiguous", F.col("id")).alias("pick"), "score")


def search(nodes: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Weighted search, re-ranked in tiers: (id, name, kind, weight, tier, sub_score)."""
    t = F.lit(term.lower())
    weight = F.when(F.lower("name") == t, 100).when(F.contains(F.lower("name"), t), 60).when(F.contains(F.lower("path"), t), 40).otherwise(0)
    found = nodes.withColumn("weight", weight).where("weight > 0").orderBy(F.desc("weight"), "id").limit(min(limit * 3, 60))
    kind = F.lower("kind")
    resolver = F.when(F.lower("name") == t, 0).when(F.startswith(F.lower("name"), t), 15).otherwise(30) - F.when(kind.isin("class", "object", "trait", "interface", "module", "file"), 3).when(kind.isin("function", "method"), 1).otherwise(0)
    found = found.withColumn("resolver", resolver)
    tier = F.when(F.col("weight") >= 100, F.when(F.col("resolver") <= -3, 0).when(F.col("resolver") <= 0, 1).otherwise(2)).when(F.col("weight") >= 60, 3).otherwise(4)
    found = found.withColumn("tier", tier).withColumn("sub_score", -F.col("weight") + F.when(F.col("weight") >= 60, F.col("resolver")).otherwise(0))
    structural = F.when(kind.isin("class", "object", "trait", "interface", "module", "file", "function", "method"), 0).otherwise(1)
    return found.orderBy("tier", "sub_score", structural, F.lower("name"), "id").limit(limit).select("id", "name", "kind", "weight", "tier", "sub_score")


def semantic_topk(vectors: DataFrame, query_id: int, k: int = 10) -> DataFrame:
    """(vec_id, score): cosine to the vector of query_id; brute force, one pass, top-k."""
    q = vectors.where(F.col("vec_id") == query_id).limit(1).select(F.col("embedding").cast("array<double>").alias("q"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).crossJoin(F.broadcast(q))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = F.round(dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q"))), 6)
    return rows.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


#: Version of the rules behind a stored smell.
SMELL_VERSION = "smell_v1"


def smell_claims(found: DataFrame, names: DataFrame) -> DataFrame:
    """(id, entity, field, value, confidence, inference_version) of found smells(id, smell, confidence): claims that can be stored and listed."""
    from codeloom import ids

    rows = found.join(names.select("id", "name"), "id", "left")
    return rows.select(ids.uuid_form(F.concat(F.lit("smell:"), "id", F.lit(":"), "smell")).alias("id"), F.col("id").alias("entity"), F.lit("smell").alias("field"), F.col("smell").alias("value"), "confidence", F.lit(SMELL_VERSION).alias("inference_version"))


def list_smells(claims: DataFrame, smell: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored smells of this version, the surest first."""
    rows = claims.where((F.col("field") == "smell") & (F.col("inference_version") == SMELL_VERSION))
    rows = (rows if smell is None else rows.where(F.col("value") == smell)).orderBy(F.desc("confidence"), "entity", "value")
    return rows if limit is None else rows.limit(limit)


def levels(links: DataFrame, files: DataFrame, resolutions: tuple[float, ...] = (1.0, 0.5, 0.1)) -> DataFrame:
    """(level, id, region): a map of three levels, modules of files, subsystems of modules, systems of subsystems.

    Each level clusters the graph of the level below, whose nodes are its regions
    and whose links are the sums of theirs, at a lower resolution; files without
    links are a region of their own.
    """
    member = stored(files.select(F.col("id"), F.col("id").alias("region")))
    graph, out = links, []
    for level, resolution in enumerate(resolutions, 1):
        found = communities(graph, resolution)
        member = stored(member.join(found.select(F.col("id").alias("region"), "community"), "region", "left").select("id", F.coalesce("community", "region").alias("region")))
        out.append(member.select(F.lit(level).alias("level"), "id", "region"))
        to = lambda c, r: found.select(F.col("id").alias(c), F.col("community").alias(r))  # noqa: B023, E731
        graph = stored(graph.join(to("a", "ra"), "a").join(to("b", "rb"), "b").where("ra <> rb").groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.sum("weight").alias("weight")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def region_nodes(member: DataFrame) -> DataFrame:
    """(level, region, kind, files, parent): regions of levels(), each within the region of the next level that holds its files."""
    kind = F.element_at(F.array(F.lit("module"), F.lit("subsystem"), F.lit("system")), F.col("level"))
    size = member.groupBy("level", "region").agg(F.count(F.lit(1)).alias("files"), F.min("id").alias("one"))
    above = member.select((F.col("level") - 1).alias("level"), F.col("id").alias("one"), F.col("region").alias("parent"))
    return size.join(above, ["level", "one"], "left").select("level", "region", kind.alias("kind"), "files", "parent")


def region_edges(member: DataFrame) -> DataFrame:
    """IN_REGION edges of levels(), from the region to what it holds: files below modules, regions below those of the next level."""
    files = member.where("level = 1").select(F.concat(F.lit("1:"), "region").alias("src"), F.col("id").alias("dst"))
    regions = region_nodes(member).where("parent is not null")
    held = regions.select(F.concat((F.col("level") + 1).cast("string"), F.lit(":"), "parent").alias("src"), F.concat(F.col("level").cast("string"), F.lit(":"), "region").alias("dst"))
    return files.unionByName(held).withColumn("predicate", F.lit("IN_REGION"))


def _map_order(sort: str) -> list[Column]:
    by = {"alpha": [F.col("label"), F.desc("files"), F.desc("confidence")], "confidence": [F.desc("confidence"), F.desc("files"), F.col("label")]}
    return [*by.get(sort, [F.desc("files"), F.desc("confidence"), F.col("label")]), F.col("id")]


def map_view(regions: DataFrame, level: int | None = None, min_confidence: float = 0.0, sort: str = "importance", max_items: int = 10) -> DataFrame:
    """regions(id, label, level, files, confidence, ..) of one level and of enough confidence, in order, up to max_items."""
    rows = regions if level is None else regions.where(F.col("level") == level)
    rows = rows.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else rows
    return rows.orderBy(*_map_order(sort)).limit(max_items)


def region_tree(regions: DataFrame, sort: str = "importance", max_items: int = 10) -> DataFrame:
    """(id, parent, rn, hidden) of regions(id, parent, label, kind, files, confidence): the first children of every region, and how many its parent hides.

    A region without a parent among the regions, or of kind system, is a root.
    """
    known = regions.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = regions.join(known, "parent", "left").withColumn("parent", F.when((F.col("kind") == "system") | F.col("known").isNull(), F.lit(None)).otherwise(F.col("parent")))
    w = Window.partitionBy("parent")
    rows = rows.withColumn("rn", F.row_number().over(w.orderBy(*_map_order(sort)))).withColumn("hidden", F.greatest(F.count(F.lit(1)).over(w) - max_items, F.lit(0)))
    return rows.where(F.col("rn") <= max_items).select("id", "parent", "rn", "hidden")


#: Bounds of a map's effort: directories squared, and edges (this engine's own).
MAP_RISKS = (("high", 25_000_000, 20_000_000), ("medium", 1_000_000, 2_000_000))


def map_preflight(files: DataFrame, symbols_per_file: int = 20, edges_per_symbol: int = 4) -> DataFrame:
    """One row on what a map of files(path) will cost: files, directories, their square, estimates of symbols and edges, risk and mode."""
    counts = files.agg(F.count(F.lit(1)).alias("files"), F.count_distinct(X.dirname(F.col("path"))).alias("directories"))
    rows = counts.withColumn("directory_quadratic", F.col("directories") * F.col("directories")).withColumn("symbols", F.col("files") * symbols_per_file).withColumn("edges", F.col("files") * symbols_per_file * edges_per_symbol)
    risk = F.lit("low")
    for name, square, edges in reversed(MAP_RISKS):
        risk = F.when((F.col("directory_quadratic") >= square) | (F.col("edges") >= edges), name).otherwise(risk)
    return rows.withColumn("risk", risk).withColumn("mode", F.when(F.col("risk") == "high", "coarse").otherwise("full"))


def scoped_region(regions: DataFrame, target: str, pick: int | None = None, most: int = 5) -> DataFrame:
    """(id, label, parent, role, rn) of regions(id, label, parent, level, files, confidence): the target by its label, its parent and its first children.

    A label that several regions have needs a pick, counted from 1 by level and id.
    """
    hits = regions.where(F.lower("label") == target.lower()).withColumn("rn", F.row_number().over(Window.partitionBy(F.lower("label")).orderBy(F.desc("level"), "id")))
    chosen = hits.where(F.col("rn") == (pick or 1))
    parent = regions.join(chosen.select(F.col("parent").alias("id")), "id").select("id", "label", "parent", F.lit("parent").alias("role"), F.lit(1).alias("rn"))
    order = Window.partitionBy("parent").orderBy(F.desc("files"), F.desc("confidence"), "label", "id")
    children = regions.join(chosen.select(F.col("id").alias("parent")), "parent").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).select("id", "label", "parent", F.lit("child").alias("role"), "rn")
    return chosen.select("id", "label", "parent", F.lit("target").alias("role"), F.lit(1).alias("rn")).unionByName(parent).unionByName(children)


def explain_regions(regions: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, explanation, health, why) of regions(id, label, kind, parent_label, files, confidence) with their scores(id, health, band), in this engine's words."""
    rows = regions.join(scores, "id", "left")
    sure = F.when(F.col("confidence") >= 0.75, "well-defined").when(F.col("confidence") >= 0.5, "moderately defined").otherwise("fuzzy")
    where = F.when(F.col("parent_label").isNotNull(), F.concat(F.lit(" in "), "parent_label")).otherwise(F.lit(""))
    text = F.concat("label", F.lit(" is a "), sure, F.lit(" "), "kind", F.lit(" of "), F.col("files").cast("string"), F.when(F.col("files") == 1, " file").otherwise(" files"), where, F.lit("."))
    why = F.when(F.col("band").isNull(), "Not scored yet.").when(F.col("band") == "good", "Healthy.").when(F.col("band") == "fair", "Mostly healthy.").when(F.col("band") == "weak", "Shows signs of strain.").otherwise("In poor health.")
    return rows.select("id", text.alias("explanation"), "health", why.alias("why"))


def detailed_regions(regions: DataFrame, edges: DataFrame, offset: int = 0, limit: int = 20, most_edges: int = 50, only: list[str] | None = None) -> DataFrame:
    """A page of regions(id, files, ..) with their first edges(a, b, weight) to other regions, and how many there are in all."""
    rows = regions if only is None else regions.where(F.col("id").isin(only))
    rows = page(rows, [F.desc("files"), F.col("id")], offset, min(limit, 200))
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    placed = both.join(rows.select("id"), "id").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "other")))
    held = placed.groupBy("id").agg(F.count(F.lit(1)).alias("edges_total"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= most_edges, F.struct("rn", "other", "weight")))), lambda e: F.struct(e["other"].alias("other"), e["weight"].alias("weight"))).alias("edges"))
    return rows.join(held, "id", "left").withColumn("edges_total", F.coalesce("edges_total", F.lit(0)))


def health_checks(nodes: DataFrame, edges: DataFrame, conflicts: DataFrame, schema_version: int | None, expected: int) -> DataFrame:
    """(check, ok, warn, detail): nodes, edges, no conflicts, and the schema that this engine writes; a schema that is not reported passes."""
    count = lambda df, name, ok, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), ok(F.col("n")).alias("ok"), F.lit(False).alias("warn"), F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("detail"))
    spark = nodes.sparkSession
    same = schema_version is None or schema_version == expected
    schema = spark.range(1).select(F.lit("schema").alias("check"), F.lit(same).alias("ok"), F.lit(not same).alias("warn"), F.lit("not reported" if schema_version is None else f"version {schema_version}, expected {expected}").alias("detail"))
    return count(nodes, "nodes", lambda n: n > 0, "nodes").unionByName(count(edges, "edges", lambda n: n > 0, "edges")).unionByName(count(conflicts, "conflicts", lambda n: n == 0, "conflicts")).unionByName(schema)


def overall(checks: DataFrame) -> DataFrame:
    """(status): failing if a check fails, warning if one only warns, else ok."""
    return checks.agg(F.when(F.bool_or(~F.col("ok") & ~F.col("warn")), "failing").when(F.bool_or(F.col("warn")), "warning").otherwise("ok").alias("status"))


def decisions(log: DataFrame, topic: str | None = None, limit: int | None = None) -> DataFrame:
    """Decisions of log(id, kind, title, rationale, topic, rev), newest first, on a topic, up to a limit."""
    rows = log.where("kind = 'decision'")
    rows = (rows if topic is None else rows.where(F.contains(F.lower(F.concat_ws(" ", "topic", "title")), F.lit(topic.lower())))).orderBy(F.desc("rev"), "id")
    return rows if limit is None else rows.limit(limit)


def truths(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Intents of log(id, kind, title, parent, rev) that stand, each below its parent: (id, title, parent, depth), roots first."""
    rows = stored(log.where("kind = 'intent'").select("id", "title", "parent"))
    level = rows.where("parent is null").withColumn("depth", F.lit(0))
    out, k = level, 0
    while not level.isEmpty():
        k += 1
        level = stored(rows.join(level.select(F.col("id").alias("parent")), "parent").select("id", "title", "parent").withColumn("depth", F.lit(k)))
        out = out.unionByName(level)
    out = out.orderBy("depth", "title", "id")
    return out if limit is None else out.limit(limit)


def plan_ops(entries: DataFrame) -> DataFrame:
    """Operations that record entries(kind, title, rationale, affects array<string>): a node each, and an edge to everything it affects."""
    from codeloom import ids

    key = ids.uuid_form(F.concat("kind", F.lit(":"), "title"))
    none = F.lit(None).cast("string")
    nodes = entries.select(F.lit("UpsertNode").alias("op"), key.alias("id"), "kind", F.col("title").alias("name"), none.alias("src"), none.alias("dst"), none.alias("predicate"))
    each = entries.withColumn("to", F.explode("affects"))
    predicate = F.concat(F.upper("kind"), F.lit("_AFFECTS"))
    return nodes.unionByName(each.select(F.lit("UpsertEdge").alias("op"), ids.uuid_form(F.concat(key, F.lit(":"), predicate, F.lit(":"), "to")).alias("id"), none.alias("kind"), none.alias("name"), key.alias("src"), F.col("to").alias("dst"), predicate.alias("predicate")))
