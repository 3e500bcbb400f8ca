"""Context bundles, investigations, stitching of workspaces and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Budgets of a bundle, with their bounds.
BUDGETS = {"entities": (1, 50, 500), "relationships": (1, 100, 1000), "evidence": (1, 25, 200), "chars": (1000, 12_000, 1_000_000)}
#: Prices of a million tokens in and out, and water for a thousand.
PRICES = {"opus": (15.0, 75.0), "sonnet": (3.0, 15.0), "haiku": (0.8, 4.0), "gpt-4o": (2.5, 10.0)}
WATER_ML = 2.0


def clamp(name: str, value: int | None) -> int:
    low, default, high = BUDGETS[name]
    return default if value is None else max(low, min(high, value))


def evidence_budget(evidence: DataFrame, group: str, most: int = 25, chars: int = 12_000) -> DataFrame:
    """evidence(group, rank, id, text): the prefix that fits; the first one that does not ends it."""
    w = Window.partitionBy(group).orderBy("rank", "id")
    rows = evidence.withColumn("rn", F.row_number().over(w)).withColumn("running", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where((F.col("rn") <= most) & (F.col("running") <= chars))


#: Scores of evidence; structural items and relationships also count their place.
EVIDENCE = {"target": 0, "structural": 10, "claim": 20, "decision": 21, "conflict": 22, "intent": 23, "relationship": 30, "provenance": 40}


def rank_evidence(items: DataFrame) -> DataFrame:
    """items(kind, seq, id) with score, in the order of score and id; seq counts from 0 within a kind."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv]), F.col("kind"))
    place = F.when(F.col("kind") == "structural", F.col("seq")).when(F.col("kind") == "relationship", F.least("seq", F.lit(10))).otherwise(0)
    return items.withColumn("score", base + place).orderBy("score", "id")


def stitch(provides: DataFrame, consumes: DataFrame) -> DataFrame:
    """provides(ws, name), consumes(ws, name): edges between workspaces, consumer to provider."""
    p = provides.select(F.col("ws").alias("provider"), "name").distinct()
    return consumes.select(F.col("ws").alias("consumer"), "name").distinct().join(p, "name").where("consumer <> provider").select("consumer", "provider", "name")


def savings(usage: DataFrame, model: str = "opus") -> DataFrame:
    """usage(command, tokens): tokens saved by command, with money (70 % of them read, 30 % written) and water."""
    read, written = PRICES.get(model, PRICES["opus"])
    money = (F.sum("tokens") * 0.7 * read + F.sum("tokens") * 0.3 * written) / 1e6
    return usage.groupBy("command").agg(F.sum("tokens").alias("tokens"), F.round(money, 6).alias("money"), F.round(F.sum("tokens") / 1000 * WATER_ML, 6).alias("water_ml")).orderBy(F.desc("tokens"), "command")


def around(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, id, depth): entities within `hops` of each of seeds(id), in both directions, each at its least depth."""
    from codeloom.operators import traverse as W
    from codeloom.tables import stored

    walk = stored(W.steps(edges, "both").select("here", "there").distinct())
    now = stored(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())
    seen = now
    for k in range(1, hops + 1):
        ahead = now.select("seed", F.col("id").alias("here")).join(walk, "here").select("seed", F.col("there").alias("id")).distinct()
        now = stored(ahead.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(now)
    return seen


#: Weights of the parts of a claim's final score (this engine's own).
CLAIM_WEIGHTS = {"relevance": 0.6, "confidence": 0.4}


def scored_claims(claims: DataFrame, near: DataFrame) -> DataFrame:
    """(seed, id, entity, statement, relevance, final_score) of claims(id, entity, statement, status, confidence) of entities near(seed, id, depth).

    Relevance halves with every hop; only live claims count.
    """
    rows = claims.where("status = 'active'").join(near.select("seed", F.col("id").alias("entity"), "depth"), "entity")
    relevance = F.pow(F.lit(0.5), F.col("depth"))
    final = CLAIM_WEIGHTS["relevance"] * relevance + CLAIM_WEIGHTS["confidence"] * F.col("confidence")
    return rows.select("seed", "id", "entity", "statement", relevance.alias("relevance"), F.round(final, 6).alias("final_score"))


def _prefix(rows: DataFrame, group: str, order: list, most: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows within the budget of each group, how many the budget leaves out)."""
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    left = placed.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias(kind))
    return placed.where(F.col("rn") <= most), left


def bundle(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, claims: DataFrame, stale: DataFrame | None = None, hops: int = 1, **asked: int) -> dict[str, DataFrame]:
    """The bundle of each of seeds(id): entities, relationships, claims, evidence, and what budgets cut off, as tables by seed.

    Entities are the seed and then its neighbours by kind, name and id;
    relationships among them by their ends; evidence is ranked, and its prefix
    that fits the number and the characters of its JSON is kept.  Budgets are
    clamped.  Nothing depends on the order in which rows come.
    """
    most = {name: clamp(name, asked.get(name)) for name in BUDGETS}
    near = around(seeds, edges, hops)
    every = near.join(nodes.select("id", "kind", "name", "path"), "id")
    every = every.join(stale.select("path", (F.col("state") != "fresh").alias("stale")), "path", "left") if stale is not None else every.withColumn("stale", F.lit(False))
    every = every.select("seed", "id", "kind", "name", "path", "depth", F.coalesce("stale", F.lit(False)).alias("stale"))
    first = F.when(F.col("depth") == 0, 0).otherwise(1)
    entities, cut_entities = _prefix(every, "seed", [first, "kind", "name", "id"], most["entities"], "entities_truncated")
    ends = every.select("seed", "id")
    inside = edges.select("src", "dst", "predicate").distinct().join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["seed", "dst"])
    relationships, cut_relationships = _prefix(inside.select("seed", "src", "dst", "predicate"), "seed", ["src", "dst", "predicate"], most["relationships"], "relationships_truncated")
    said = scored_claims(claims, near)
    items = every.where("depth = 0").select("seed", F.lit("target").alias("kind"), F.lit(0).alias("seq"), "id")
    order = Window.partitionBy("seed").orderBy("id")
    items = items.unionByName(said.select("seed", F.lit("claim").alias("kind"), F.lit(0).alias("seq"), "id"))
    items = items.unionByName(relationships.select("seed", F.lit("relationship").alias("kind"), (F.col("rn") - 1).alias("seq"), F.concat_ws(">", "src", "predicate", "dst").alias("id")))
    ranked = rank_evidence(items).withColumn("text", F.to_json(F.struct("kind", "id", "score")))
    evidence = evidence_budget(ranked.withColumn("rank", F.col("score")), "seed", most["evidence"], most["chars"])
    total = ranked.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    kept = evidence.groupBy("seed").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("text")).alias("kept_chars"))
    cut = total.join(kept, "seed", "left").select("seed", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("evidence_truncated"), (F.col("chars") - F.coalesce("kept_chars", F.lit(0))).alias("characters_truncated"))
    truncation = cut_entities.join(cut_relationships, "seed", "full").join(cut, "seed", "full").fillna(0)
    return {"entities": entities, "relationships": relationships, "claims": said.withColumn("rn", F.row_number().over(order)), "evidence": evidence.select("seed", "kind", "id", "score", "rn"), "truncation": truncation}


#: Parts of a bundle that an investigation keeps, with what identifies a row of each.
SAVED = {"entities": ("id",), "relationships": ("src", "dst", "predicate"), "claims": ("id",), "evidence": ("id",)}


def save_investigation(parts: dict[str, DataFrame], folder: str, name: str, at: str) -> None:
    """Keeps a bundle under a name, as tables below folder; saving it again replaces it."""
    for part in SAVED:
        parts[part].withColumn("saved_at", F.lit(at)).write.mode("overwrite").parquet(f"{folder}/investigation={name}/part={part}")


def load_investigation(spark, folder: str, name: str) -> dict[str, DataFrame]:  # noqa: ANN001
    return {part: spark.read.parquet(f"{folder}/investigation={name}/part={part}") for part in SAVED}


def list_investigations(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """(investigation, saved_at, entities), newest first."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/investigation=*/part=entities")
    return rows.groupBy("investigation").agg(F.max("saved_at").alias("saved_at"), F.count(F.lit(1)).alias("entities")).orderBy(F.desc("saved_at"), "investigation")


def diff_investigations(saved: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> DataFrame:
    """(part, change, key): rows that only the fresh (added) or only the saved bundle (removed) has."""
    out = None
    for part, keys in SAVED.items():
        a, b = (d[part].select(F.concat_ws("|", "seed", *keys).alias("key")).distinct() for d in (saved, fresh))
        for change, rows in (("added", b.join(a, "key", "left_anti")), ("removed", a.join(b, "key", "left_anti"))):
            rows = rows.select(F.lit(part).alias("part"), F.lit(change).alias("change"), "key")
            out = rows if out is None else out.unionByName(rows)
    return out


def stitch_package(spec):  # noqa: ANN001, ANN201
    """The package that a specifier names: its first part, two of them with a scope; null for paths."""
    scoped = F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)
    return F.when(F.rlike(spec, F.lit(r"^[./]")) | (F.coalesce(spec, F.lit("")) == ""), F.lit(None)).when(F.startswith(spec, F.lit("@")), F.when(scoped != "", scoped)).otherwise(F.substring_index(spec, "/", 1))


def stitch_collection(entities: DataFrame, imports: DataFrame, bindings: DataFrame, calls: DataFrame, aliases: DataFrame, deps: DataFrame) -> dict[str, DataFrame]:
    """What a workspace tells others: exports(ws, name, node), consumes(ws, name, node), symbols(ws, package, name, caller).

    entities(ws, path, name, container, kind, node): top-level functions and
    classes, once a name, and aliases(ws, path, local, public) of theirs.
    imports(ws, path, spec, node) and bindings(ws, path, local, imported, spec)
    count for packages among deps(ws, name), which are those of production.
    calls(ws, path, name, caller) of bound or otherwise unknown names ask for
    symbols, but for the names of built-in methods.
    """
    from codeloom.operators.resolve import COMMODITY

    top = entities.where("container is null and kind in ('function', 'class')").groupBy("ws", "name").agg(F.min("node").alias("node"))
    own = entities.select("ws", "path", F.col("name").alias("local"), "node")
    public = aliases.join(own, ["ws", "path", "local"]).select("ws", F.col("public").alias("name"), "node")
    exports = top.unionByName(public).groupBy("ws", "name").agg(F.min("node").alias("node"))
    allowed = deps.select("ws", "name").distinct()
    consumes = imports.select("ws", stitch_package(F.col("spec")).alias("name"), "node").where("name is not null").join(allowed, ["ws", "name"], "left_semi").distinct()
    first = bindings.groupBy("ws", "path", F.col("local").alias("name")).agg(F.min(F.struct("spec", "imported")).alias("b"))
    asked = calls.where(~F.col("name").isin(*COMMODITY)).join(first, ["ws", "path", "name"], "left")
    bound = asked.where("b is not null").select("ws", stitch_package(F.col("b.spec")).alias("package"), F.when(F.col("b.imported") == "default", F.col("name")).otherwise(F.col("b.imported")).alias("name"), "caller")
    bound = bound.join(allowed.withColumnRenamed("name", "package"), ["ws", "package"], "left_semi")
    unknown = asked.where("b is null").join(own.select("ws", F.col("local").alias("name")).distinct(), ["ws", "name"], "left_anti").select("ws", F.lit(None).cast("string").alias("package"), "name", "caller")
    return {"exports": exports, "consumes": consumes, "symbols": bound.select("ws", "package", "name", "caller").unionByName(unknown.select("ws", "package", "name", "caller")).distinct()}


def stitch_all(provides: DataFrame, consumes: DataFrame, exports: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst, predicate), systems(ws, system_id)): workspaces joined by what they provide(ws, name, node) and consume.

    Imports lead to the provider's entry; symbols to its export of that name, of
    the package that is asked for or, if none is, of the only workspace that the
    asking one depends on and that exports it.  Joined workspaces are a system,
    called by the least of them.
    """
    from codeloom import ids
    from codeloom.tables import stored

    p = provides.select(F.col("ws").alias("provider"), "name", F.col("node").alias("entry"))
    links = stored(consumes.join(p, "name").where("ws <> provider"))
    imports = links.select(F.col("node").alias("src"), F.col("entry").alias("dst"), F.lit("IMPORTS").alias("predicate"))
    known = links.select("ws", "provider", F.col("name").alias("package")).distinct()
    ex = exports.select(F.col("ws").alias("provider"), "name", F.col("node").alias("dst"))
    named = symbols.where("package is not null").join(known, ["ws", "package"]).join(ex, ["provider", "name"])
    open_ = symbols.where("package is null").join(known.select("ws", "provider").distinct(), "ws").join(ex, ["provider", "name"])
    single = open_.groupBy("ws", "name", "caller").agg(F.min("dst").alias("dst"), F.max("dst").alias("other")).where("dst = other")
    calls = named.select(F.col("caller").alias("src"), "dst").unionByName(single.select(F.col("caller").alias("src"), "dst")).withColumn("predicate", F.lit("CALLS"))
    both = known.select(F.col("ws").alias("a"), F.col("provider").alias("b")).distinct()
    now = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b").distinct())
    label = stored(now.select(F.col("a").alias("ws")).distinct().withColumn("least", F.col("ws")))
    while True:
        near = now.join(label.select(F.col("ws").alias("b"), "least"), "b").groupBy(F.col("a").alias("ws")).agg(F.min("least").alias("near"))
        after = stored(label.join(near, "ws").select("ws", F.least("least", "near").alias("least")))
        same = after.join(label.withColumnRenamed("least", "was"), "ws").where("least <> was").isEmpty()
        label = after
        if same:
            break
    systems = label.select("ws", ids.stable_id(F.concat(F.lit("system:"), "least")).alias("system_id"))
    return imports.unionByName(calls).distinct(), systems
