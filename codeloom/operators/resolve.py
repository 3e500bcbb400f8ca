"""Cross-file resolution: tiers of equi-joins whose verdicts meet in one aggregate.

files(path, language, repo), entities(path, seq, name, container, start, end),
relationships(id, path, src, name, predicate, bound), imports(path, target),
bindings(path, seq, pkg, local, imported) with providers(path, local, target),
exports(path, local, public).

Every tier yields candidates (id, tier, target).  A tier emits an edge if one
target with one key is left, stops where nothing further may be tried, and
passes otherwise; of a relationship the first tier that does not pass decides.
Candidates of all tiers are computed side by side and meet in one group-by of
the relationship, so no tier is derived again by those after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import ids
from codeloom.functions import text as X
from codeloom.operators import indexes as I
from codeloom.operators.indexes import family, stem
from codeloom.tables import dropped, stored

#: Names of built-in methods, too common to resolve globally, and the number of defining files that makes a name common.
COMMODITY = (
    "map", "forEach", "reduce", "reduceRight", "flatMap", "flat", "push", "pop", "shift", "unshift", "splice", "slice", "concat", "get", "set", "has", "keys", "values", "entries",
    "then", "catch", "finally", "resolve", "race", "allSettled", "bind", "call", "apply", "stringify", "toString", "valueOf", "hasOwnProperty",
)
COMMON = 5
#: Words that say nothing about which file is meant; extensions of implementations in C and C++.
GENERIC = ("run", "job", "file", "files", "table", "tables", "output", "outputs", "input", "inputs", "background")
IMPLEMENTATIONS = (".c", ".cpp", ".cc", ".cxx")
#: Tiers in the order in which they decide, with the confidence of what they emit.
TIERS = ("1-same-file", "2-binding", "1b-qualifier", "2-import", "gate-commodity", "2.5-transitive", "3-global")
CONFIDENCE = {"2-binding": 0.9, "1b-qualifier": 0.9, "2-import": 0.9, "2.5-transitive": 0.8, "3-global": 0.5}
QUALIFIED_GLOBALLY = 0.7


def commodity(entities: DataFrame) -> DataFrame:
    """(name): listed names and names that COMMON files or more define."""
    many = entities.groupBy("name").agg(F.count_distinct("path").alias("n")).where(F.col("n") >= COMMON).select("name")
    return many.unionByName(entities.where(F.col("name").isin(*COMMODITY)).select("name")).distinct()


def by_repository(candidates: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """candidates(id, repo, to_repo, ..) of one repository or along a dependency allowed(src, dst), where there are any; else all."""
    if allowed is None:
        return candidates
    rows = candidates.join(allowed.select(F.col("src").alias("repo"), F.col("dst").alias("to_repo"), F.lit(True).alias("_along")).distinct(), ["repo", "to_repo"], "left")
    near = F.col("repo").isNull() | F.col("to_repo").isNull() | (F.col("repo") == F.col("to_repo")) | F.coalesce("_along", F.lit(False))
    rows = rows.withColumn("_near", near).withColumn("_any", F.max(near).over(Window.partitionBy("id", "tier")))
    return rows.where("_near or not _any").drop("_near", "_any", "_along")


def _common(a: Column, b: Column) -> Column:
    """Leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def overlap(src: Column, target: Column, keys: Column) -> Column:
    """Telling words that a caller's name shares with a candidate's file name and the candidate's keys."""
    words = F.array_distinct(F.concat(X.symbol_tokens(F.lower(stem(target))), F.flatten(F.transform(keys, X.symbol_tokens))))
    return F.size(F.array_except(F.array_intersect(words, X.symbol_tokens(src)), F.array(*[F.lit(w) for w in GENERIC])))


def narrowed(candidates: DataFrame) -> DataFrame:
    """candidates(id, tier, path, src, name, language, target, keys), of several targets those that the language's own rules leave.

    C#: the file named like the type.  Java and SAS: the nearest directory.  C and
    C++: the only implementation, then the nearest, then the one whose words the
    caller's name shares; each rule only if it leaves exactly one.
    """
    slash = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    c = candidates.withColumn("_stem", F.lower(stem(F.col("target"))) == F.lower("name")).withColumn("_common", _common(slash("path"), slash("target")))
    implementation = F.lit(False)
    for e in IMPLEMENTATIONS:
        implementation = implementation | F.endswith("target", F.lit(e))
    c = c.withColumn("_impl", implementation).withColumn("_overlap", overlap(F.col("src"), F.col("target"), F.col("keys")))
    group = Window.partitionBy("id", "tier")
    in_c = F.col("language").isin("c", "cpp")
    c = c.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_one_impl", F.count_if("_impl").over(group) == 1)
    # The only implementation of a C name leaves the others behind.
    c = c.withColumn("_in", ~(in_c & F.col("_one_impl")) | F.col("_impl"))
    c = c.withColumn("_near", F.max(F.when(F.col("_in"), F.col("_common"))).over(group)).withColumn("_best", F.max(F.when(F.col("_in"), F.col("_overlap"))).over(group)).withColumn("_all_best", F.max("_overlap").over(group))
    only = lambda cond: F.count_if(cond).over(group) == 1
    nearest, aligned = F.col("_in") & (F.col("_common") == F.col("_near")), F.col("_in") & (F.col("_overlap") == F.col("_best")) & (F.col("_best") > 0)
    built = F.col("_impl") & (F.col("_overlap") == F.col("_all_best")) & (F.col("_all_best") > 0)
    c = c.withColumn("_nearest", nearest).withColumn("_aligned", aligned).withColumn("_built", built)
    c = c.withColumn("_rule", F.when(F.col("_n") == 1, "all").when((F.col("language") == "csharp") & only(F.col("_stem")), "stem").when(F.col("language").isin("java", "sas") & only(F.col("_nearest")), "near").when(~in_c, "all")
        .when(F.count_if("_in").over(group) == 1, "in").when(only(F.col("_nearest")), "near").when(only(F.col("_aligned")), "aligned").when(only(F.col("_built")), "built").otherwise("in"))
    kept = F.when(F.col("_rule") == "stem", F.col("_stem")).when(F.col("_rule") == "near", F.col("_nearest")).when(F.col("_rule") == "aligned", F.col("_aligned")).when(F.col("_rule") == "built", F.col("_built")).when(F.col("_rule") == "in", F.col("_in")).otherwise(F.lit(True))
    return c.where(kept).select(*candidates.columns)


def aligned(candidates: DataFrame) -> DataFrame:
    """(id, target) of candidates(id, src, target, keys): the only one with the most words of the caller's name, if it shares any."""
    rows = candidates.withColumn("_overlap", overlap(F.col("src"), F.col("target"), F.col("keys"))).where("_overlap > 0")
    best = rows.groupBy("id").agg(F.max("_overlap").alias("_overlap"))
    return rows.join(best, ["id", "_overlap"]).groupBy("id").agg(F.min("target").alias("target"), F.max("target").alias("_other")).where("target = _other").select("id", "target")


def cascade(files: DataFrame, entities: DataFrame, relationships: DataFrame, imports: DataFrame, bindings: DataFrame | None = None, exports: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, tier, verdict, target, qkey, confidence): one row per relationship that a tier decides.

    bindings here are (path, local, imported, target): what an import binds, and
    the only file that provides it (null if there is none or several).
    """
    spark = files.sparkSession
    # Inputs are read by several tiers: each is written once, whatever they are derived from.
    entities, relationships, imports, place = stored(entities), stored(relationships), stored(imports.select("path", "target")), stored(files.select("path", "language", "repo"))
    bound = stored(bindings if bindings is not None else spark.createDataFrame([], "path string, local string, imported string, target string"))
    public = stored(exports.select(F.col("path").alias("target"), F.col("public").alias("imported"), F.col("local").alias("own")) if exports is not None else spark.createDataFrame([], "target string, imported string, own string"))
    # A relationship is known by the provider's name of what it calls; its own name is kept for the edge.
    renamed = bound.where("imported <> 'default' and local <> imported").groupBy("path", "local").agg(F.min("imported").alias("imported"))
    rel = relationships.join(renamed.withColumnRenamed("local", "name"), ["path", "name"], "left").withColumn("asked", F.when(F.col("predicate") == "CALLS", F.coalesce("imported", "name")).otherwise(F.col("name"))).drop("imported")
    rel = stored(rel.join(place, "path"))
    keys = stored(entities.select("path", "name", ids.qualified_key(F.col("container"), F.col("name")).alias("qkey")).distinct())
    defs = stored(keys.groupBy("path", "name").agg(F.array_sort(F.collect_set("qkey")).alias("keys")))
    of = defs.select(F.col("path").alias("target"), F.col("name").alias("asked"), "keys")
    common = stored(commodity(entities))
    imported = stored(imports.select("path", "target").where("path <> target").distinct())
    none = F.lit(None).cast("string")
    columns = ["id", "tier", "path", "src", "name", "language", "repo", "target", "keys"]

    def tier(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("tier", F.lit(TIERS.index(name)))

    # Same file: what it defines itself is not looked for elsewhere, unless an import binds the name and the definition is out of scope.
    has_binding = rel.join(bound.select("path", F.col("local").alias("name"), F.lit(True).alias("binding")).distinct(), ["path", "name"], "left")
    own = has_binding.join(defs.select("path", "name"), ["path", "name"], "left_semi")
    # Where it stands is asked only of names that an import binds as well: frequent names have many spans on either side.
    spans = entities.select("path", "name", "start", "end")
    hidden = own.where("binding and not coalesce(bound, false)").select("id", "path", "src", "name")
    scope = hidden.join(spans.select("path", F.col("name").alias("src"), F.col("start").alias("s0"), F.col("end").alias("s1")), ["path", "src"]).join(spans, ["path", "name"]).where("start >= s0 and end <= s1").select("id", F.lit(True).alias("inside")).distinct()
    own = own.join(scope, "id", "left")
    own = own.where(F.col("binding").isNull() | (~F.coalesce("bound", F.lit(False)) & F.coalesce("inside", F.lit(False))))
    stop = tier(own.unionByName(has_binding.where("bound = false").withColumn("inside", F.lit(None).cast("boolean"))), "1-same-file").select("id", "tier", none.alias("target"), none.alias("qkey"), F.lit("stop").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    # Bindings: the provider's public name, or its own; a default is never a member's name.
    asked = rel.where("coalesce(bound, true) and predicate <> 'IMPORTS'").join(bound.where("target is not null").withColumnRenamed("local", "name"), ["path", "name"])
    named = asked.join(public, ["target", "imported"], "left").withColumn("asked", F.coalesce("own", F.when(F.col("imported") != "default", F.col("imported"))))
    provided = tier(named.join(of, ["target", "asked"]), "2-binding").select(*columns)
    # Qualified names: import-scoped first, then the only definition of the member anywhere; they never fall to the bare tiers.
    dot = F.instr(F.reverse("asked"), ".")
    qualified = rel.where("asked like '%_._%'").withColumn("q", F.substring(F.col("asked"), F.lit(1), F.length("asked") - dot)).withColumn("m", F.substring(F.col("asked"), F.length("asked") - dot + 2, F.length("asked")))
    qualified = stored(qualified.withColumn("full", F.concat("q", F.lit("."), "m")))
    member = keys.select(F.col("path").alias("target"), F.col("name").alias("m"), F.col("qkey").alias("full")).distinct()
    holder = keys.select(F.col("path").alias("target"), F.col("name").alias("q")).distinct()
    scoped = qualified.join(imported, "path")
    near = scoped.join(member, ["target", "m", "full"]).select("id", "target").unionByName(scoped.join(holder, ["target", "q"]).select("id", "target")).distinct()
    near = near.groupBy("id").agg(F.min("target").alias("near"), F.count(F.lit(1)).alias("n_near"))
    lang = place.select(F.col("path").alias("target"), family(F.col("language")).alias("to"))
    far = qualified.where(~F.col("m").isin(*COMMODITY)).join(member, ["m", "full"]).where("target <> path").join(lang, "target").where(family(F.col("language")) == F.col("to")).select("id", "target").distinct()
    far = far.groupBy("id").agg(F.min("target").alias("far"), F.count(F.lit(1)).alias("n_far"))
    chosen = qualified.join(near, "id", "left").join(far, "id", "left").withColumn("target", F.when(F.col("n_near") == 1, F.col("near")).when(F.col("n_far") == 1, F.col("far")))
    held = keys.select(F.col("path").alias("target"), F.col("name").alias("m"), "qkey").groupBy("target", "m").agg(F.collect_set("qkey").alias("k"))
    chosen = chosen.join(held, ["target", "m"], "left").withColumn("qkey", F.when(F.array_contains("k", F.col("full")), F.col("full")).when(F.size("k") == 1, F.get("k", F.lit(0))))
    verdict = F.when(F.col("qkey").isNotNull(), "emit").otherwise("stop")
    by_name = tier(chosen, "1b-qualifier").select("id", "tier", F.when(F.col("qkey").isNotNull(), F.col("target")).alias("target"), "qkey", verdict.alias("verdict"), F.when(F.col("qkey").isNotNull(), F.when(F.col("n_near") == 1, CONFIDENCE["1b-qualifier"]).otherwise(QUALIFIED_GLOBALLY)).alias("confidence"))
    # Bare names.
    bare = rel.where("not asked like '%_._%'")
    direct = stored(tier(bare.join(imported, "path").join(of, ["target", "asked"]), "2-import").select(*columns))
    gate = tier(bare.join(common.withColumnRenamed("name", "asked"), "asked", "left_semi"), "gate-commodity").select("id", "tier", none.alias("target"), none.alias("qkey"), F.lit("stop").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    rare = bare.join(common.withColumnRenamed("name", "asked"), "asked", "left_anti")
    further = imported.join(imported.select(F.col("path").alias("target"), F.col("target").alias("second")), "target").select("path", F.col("second").alias("target")).where("path <> target").distinct().join(imported, ["path", "target"], "left_anti")
    second = stored(tier(rare.join(further, "path").join(of, ["target", "asked"]), "2.5-transitive").select(*columns))
    # Rare names only, so a name meets fewer than COMMON files here.
    every = rare.where("not (language in ('c', 'cpp') and predicate = 'REFERENCES')").join(of, "asked").where("target <> path").join(place.select(F.col("path").alias("target"), F.col("language").alias("to")), "target").where("language = to")
    hint = aligned(direct).select("id", F.lower(stem(F.col("target"))).alias("hint"), F.lit(0).alias("rank")).unionByName(aligned(second).select("id", F.lower(stem(F.col("target"))).alias("hint"), F.lit(1).alias("rank")))
    every = every.join(hint.groupBy("id").agg(F.min_by("hint", "rank").alias("hint")), "id", "left").withColumn("_hinted", F.coalesce(F.lower(stem(F.col("target"))) == F.col("hint"), F.lit(False)))
    every = every.withColumn("_any", F.max("_hinted").over(Window.partitionBy("id"))).where("_hinted or not _any")
    world = tier(every, "3-global").select(*columns)
    pool = stored(direct.unionByName(second).unionByName(world))
    candidates = narrowed(pool).unionByName(provided)
    candidates = by_repository(candidates.join(place.select(F.col("path").alias("target"), F.col("repo").alias("to_repo")), "target"), allowed)
    # One target with one key emits; one target with several keys stops; several targets pass.
    agreed = candidates.groupBy("id", "tier").agg(F.min("target").alias("target"), F.max("target").alias("other"), F.min("keys").alias("keys")).where("target = other")
    single = F.size("keys") == 1
    emitted = agreed.where(single | (F.col("tier") != TIERS.index("2-binding"))).select("id", "tier", F.when(single, F.col("target")).alias("target"), F.when(single, F.get("keys", F.lit(0))).alias("qkey"), F.when(single, "emit").otherwise("stop").alias("verdict"), F.when(single, F.element_at(F.create_map(*[F.lit(x) for t, c in CONFIDENCE.items() for x in (TIERS.index(t), c)]), F.col("tier"))).alias("confidence"))
    verdicts = stop.unionByName(by_name).unionByName(gate).unionByName(emitted)
    first = verdicts.groupBy("id").agg(F.min(F.struct("tier", "verdict", "target", "qkey", "confidence")).alias("v"))
    names = F.array(*[F.lit(t) for t in TIERS])
    out = stored(first.select("id", F.element_at(names, F.col("v.tier") + 1).alias("tier"), "v.verdict", "v.target", "v.qkey", "v.confidence"))
    dropped(rel, keys, defs, common, imported, qualified, entities, relationships, imports, place, bound, public, direct, second, pool)
    return out


def import_edges(imports: DataFrame, files: DataFrame, index: DataFrame, weights: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(id, target, qkey, confidence, how) of imports(id, path, language, module, raw): exactly one file, or a package of another repository.

    Scala and Java names of a package's entity point at the entity; one file is
    an edge to the file; several are none.  Where there is no file,
    packages(key, repo) give another repository's entry file.  Python names
    that begin with a capital are left to the tiers as symbols.
    """
    dotted = imports.where("language in ('scala', 'java') and module like '%_._%' and not module like '%._'")
    dot = F.instr(F.reverse("module"), ".")
    dotted = dotted.withColumn("key", F.substring(F.col("module"), F.lit(1), F.length("module") - dot)).withColumn("name", F.substring(F.col("module"), F.length("module") - dot + 2, F.length("module")))
    hit = dotted.join(I.lookup(index, "package"), "key").where("target <> path").join(I.lookup(index, "symbol", "name"), ["target", "name"]).select("id", "target", "name").distinct()
    hit = hit.groupBy("id", "name").agg(F.min("target").alias("target"), F.max("target").alias("other")).where("target = other").withColumn("preferred", F.lit(None).cast("string"))
    entity = I.best_key(hit.select("id", "target", "name", "preferred"), index).where("qkey is not null").select("id", "target", "qkey", F.lit(0.9).alias("confidence"), F.lit("entity").alias("how"))
    rest = imports.join(entity.select("id"), "id", "left_anti")
    found = I.import_targets(rest, files, index, weights).groupBy("id").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    file = found.where("target = other").select("id", "target", X.basename(F.col("target")).alias("qkey"), F.lit(0.9).alias("confidence"), F.lit("file").alias("how"))
    out = entity.unionByName(file)
    if packages is not None:
        from codeloom.sources.files import package_of

        none = rest.join(found.select("id"), "id", "left_anti").withColumn("spec", F.coalesce("raw", "module"))
        to = package_of(none.select("id", "spec"), packages).join(none.select("id", "path"), "id").join(files.select("path", F.col("repo").alias("from_repo")), "path").where("repo <> from_repo")
        entry = to.join(I.entry_files(files).select("repo", F.col("path").alias("target")), "repo").where("target <> path")
        out = out.unionByName(entry.select("id", "target", X.basename(F.col("target")).alias("qkey"), F.lit(0.7).alias("confidence"), F.lit("package").alias("how")))
    return out


def repo_dependencies(declared: DataFrame, imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(src, dst): what repositories declare(src, dst) or import(path, spec) of each other, transitively."""
    from codeloom.sources.files import package_of

    asked = imports.select(F.xxhash64("path", "spec").alias("id"), "path", "spec").distinct()
    used = package_of(asked.select("id", "spec").distinct(), packages).join(asked, "id").join(files.select("path", F.col("repo").alias("src")), "path").select("src", F.col("repo").alias("dst"))
    return repo_closure(declared.select("src", "dst").unionByName(used).where("src <> dst").distinct())


def statistics(verdicts: DataFrame, relationships: DataFrame) -> DataFrame:
    """(tier, verdict, n) of all relationships; those that no tier decides are open."""
    every = relationships.select("id").join(verdicts, "id", "left")
    return every.groupBy(F.coalesce("tier", F.lit("none")).alias("tier"), F.coalesce("verdict", F.lit("open")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def repo_closure(deps: DataFrame) -> DataFrame:
    """(src, dst): transitive closure of repository dependencies, by doubling until nothing is added."""
    now = stored(deps.select("src", "dst").distinct())
    n = now.count()
    while True:
        further = now.join(now.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        after = stored(now.unionByName(further).distinct())
        dropped(now)
        now = after
        if (m := now.count()) == n:
            return now
        n = m


def gate_cross_repo(edges: DataFrame, repo_of: DataFrame, allowed: DataFrame) -> DataFrame:
    """edges(src_path, dst_path) within a repository or along a dependency."""
    e = edges.join(repo_of.select(F.col("path").alias("src_path"), F.col("repo").alias("src")), "src_path").join(repo_of.select(F.col("path").alias("dst_path"), F.col("repo").alias("dst")), "dst_path")
    same = e.where("src = dst")
    return same.unionByName(e.where("src <> dst").join(allowed, ["src", "dst"], "left_semi").select(*e.columns))


#: Lines of a block: a span is listed under every block it touches, a line under its own.
BLOCK = 64


def enclosing(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, name): the innermost span(path, name, start, end) that holds each line; earlier ones win ties.

    Lines and spans meet by blocks of lines, so a large file is many keys.  Spans
    that fill a block are listed once for the block, as its smallest.
    """
    block = F.floor(F.col("line") / BLOCK)
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK))))
    whole = (F.col("start") <= F.col("block") * BLOCK) & (F.col("end") >= F.col("block") * BLOCK + BLOCK - 1)
    best = lambda rows, *keys: rows.groupBy(*keys).agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "start", "name")).alias("s"))
    filled = best(cut.where(whole), "path", "block")
    asked = lines.select("path", "line").distinct().withColumn("block", block)
    partly = best(asked.join(cut.where(~whole), ["path", "block"]).where("line between start and end"), "path", "line")
    found = asked.join(filled, ["path", "block"]).select("path", "line", "s").unionByName(partly.select("path", "line", "s"))
    return found.groupBy("path", "line").agg(F.min("s").alias("s")).select("path", "line", F.col("s.name").alias("name"))
