"""Resolution after a change of some files: only what the change can touch is decided again.

A Base keeps the tables of a code base as files clustered by the keys that rules
look them up by (each a partition column of buckets), with the verdict of every
relationship.  A change is the paths that changed and their new rows; a path
counts as changed if any of its rows differs in any table, so a file whose
imports now lead elsewhere is one.  Rows of other paths are the same as before.

From the rows of the changed paths before and after come the differences:
names of which a definition came, went or moved (all names of a file whose
language or repository changed), imports, exports.  They reach a relationship
by these rules, each one a join of a difference with the Base:

* it stands in a changed path;
* it uses a name with another definition: its own, the one its import binds,
  the provider's own name behind it, or either part of a qualified name (this
  also covers names that become too common or cease to be);
* its file imports a changed file whose imports differ, and it uses a name that
  a file at the other end of such an import defines;
* its binding leads to a public name that its provider now exports differently.

These relationships go through the tiers again, with the definitions of the
names they use, the imports of their files and of what these import.  Buckets
are told to the scans, so what is read grows with the change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.resolve import cascade
from codeloom.tables import dropped, small, stored

#: Buckets of a table; the keys by which each table is laid out.
BUCKETS = 32
LAYOUTS = {"files": ["path"], "entities": ["path", "name"], "relationships": ["path"], "imports": ["path", "target"], "bindings": ["path", "target"], "exports": ["path"], "uses": ["name", "path"]}


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _parts(name: Column) -> Column:
    """A name, and the parts of a qualified one: all but the last piece, and the last piece."""
    dot = F.instr(F.reverse(name), ".")
    both = F.array(F.substring(name, F.lit(1), F.length(name) - dot), F.substring(name, F.length(name) - dot + 2, F.length(name)))
    return F.concat(F.array(name), F.when(F.like(name, F.lit("%_._%")), both).otherwise(F.array().cast("array<string>")))


def uses(relationships: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, path, name): the names whose definitions a relationship's verdict can depend on."""
    by = bindings.select("path", F.col("local").alias("name"), "imported", "target").join(exports.select(F.col("path").alias("target"), F.col("public").alias("imported"), F.col("local").alias("own")), ["target", "imported"], "left")
    rows = relationships.select("id", "path", "name").join(by.select("path", "name", "imported", "own"), ["path", "name"], "left")
    names = F.array_compact(F.array("name", "imported", "own"))
    return rows.select("id", "path", F.explode(F.flatten(F.transform(names, _parts))).alias("name")).distinct()


@dataclass
class Base:
    """tables[name][key]: a table laid out by key; verdicts of its relationships."""

    tables: dict[str, dict[str, DataFrame]]
    verdicts: DataFrame
    allowed: DataFrame | None = None

    def by(self, table: str, key: str, values: DataFrame) -> DataFrame:
        """The rows of a table whose key is among values(key): other buckets are not read."""
        df = self.tables[table][key]
        asked = stored(values.select(F.col(values.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_bucket", _bucket(key)))
        numbers = [r[0] for r in asked.select("_bucket").distinct().collect()]  # at most BUCKETS
        return df.where(F.col("_bucket").isin(numbers)).join(small(asked.select(key), asked), key, "left_semi").select(*[c for c in df.columns if c != "_bucket"])

    def drop(self) -> None:
        for layouts in self.tables.values():
            dropped(*layouts.values())
        dropped(self.verdicts)


def base(files: DataFrame, entities: DataFrame, relationships: DataFrame, imports: DataFrame, bindings: DataFrame, exports: DataFrame, allowed: DataFrame | None = None, verdicts: DataFrame | None = None) -> Base:
    """A Base of the tables of cascade(); it decides all relationships unless their verdicts are given."""
    every = {"files": files, "entities": entities, "relationships": relationships, "imports": imports.where("path <> target").distinct(), "bindings": bindings, "exports": exports, "uses": uses(relationships, bindings, exports)}
    tables = {name: {key: stored(df.withColumn("_bucket", _bucket(key)).repartition("_bucket").sortWithinPartitions("_bucket", key), ["_bucket"]) for key in LAYOUTS[name]} for name, df in every.items()}
    whole = {name: tables[name]["path"].drop("_bucket") for name in every if name != "uses"}
    return Base(tables, verdicts if verdicts is not None else cascade(**whole, allowed=allowed), allowed)


@dataclass
class Delta:
    """decided: new verdicts; withdrawn(id): relationships whose old verdicts no longer stand; affected(id): what was decided again."""

    decided: DataFrame
    withdrawn: DataFrame
    affected: DataFrame

    def patched(self, verdicts: DataFrame) -> DataFrame:
        """The verdicts of all relationships after the change."""
        return verdicts.join(self.withdrawn, "id", "left_anti").unionByName(self.decided)


def _differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either side that the other one lacks."""
    return old.exceptAll(new).unionByName(new.exceptAll(old))


def apply(of: Base, changed: DataFrame, files: DataFrame, entities: DataFrame, relationships: DataFrame, imports: DataFrame, bindings: DataFrame, exports: DataFrame) -> Delta:
    """What changes when the rows of changed(path) become those given; a removed path has none."""
    changed = stored(changed.select("path").distinct())
    new = {"files": files, "entities": entities, "relationships": relationships, "imports": imports.where("path <> target").distinct(), "bindings": bindings, "exports": exports}
    new = {name: stored(df.select(*[c for c in of.tables[name]["path"].columns if c != "_bucket"]).join(small(changed), "path", "left_semi")) for name, df in new.items()}
    old = {name: stored(of.by(name, "path", changed)) for name in new}
    few = small(changed)

    def now(table: str, key: str, values: DataFrame) -> DataFrame:
        """Rows of the code base after the change, by key."""
        kept = of.by(table, key, values).join(few, "path", "left_anti")
        return kept.unionByName(new[table].join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_semi"))

    # Names with another definition.
    moved = stored(_differences(*(t["files"].select("path", "language", "repo") for t in (old, new))).select("path").distinct())
    defined = lambda t: t["entities"].select("path", "name", "container").distinct()
    both = defined(old).unionByName(defined(new))
    names = stored(_differences(defined(old), defined(new)).select("name").unionByName(both.join(moved, "path", "left_semi").select("name")).where("name is not null").distinct())
    # Imports of changed files that came or went, seen from the files that import these.
    links = stored(_differences(*(t["imports"].select("path", "target") for t in (old, new))).distinct())
    ends = stored(now("entities", "path", links.select("target")).select(F.col("path").alias("target"), "name").distinct().join(links, "target").select("path", "name").distinct())
    importers = now("imports", "target", links.select("path")).select(F.col("target").alias("via"), F.col("path").alias("importer"))
    reached = importers.join(ends.withColumnRenamed("path", "via"), "via").select(F.col("importer").alias("path"), "name").distinct()
    # Public names that a provider exports differently.
    shown = _differences(*(t["exports"].select("path", "public", "local") for t in (old, new))).select(F.col("path").alias("target"), F.col("public").alias("imported")).distinct()
    through = stored(now("bindings", "target", shown.select("target")).join(shown, ["target", "imported"]).select("path", F.col("local").alias("name")).distinct())
    reached = stored(reached.unionByName(through).distinct())
    # Relationships outside of the changed paths that these differences reach; those inside are all new.
    outside = of.by("uses", "name", names).select("id", "path").unionByName(of.by("uses", "path", reached.select("path")).join(reached, ["path", "name"]).select("id", "path"))
    outside = stored(outside.join(few, "path", "left_anti").distinct())
    again = of.by("relationships", "path", outside.select("path")).join(outside.select("id"), "id", "left_semi")
    again = stored(again.unionByName(new["relationships"]))
    withdrawn = stored(outside.select("id").unionByName(old["relationships"].select("id")).distinct())

    # What the tiers need to know of them.
    here = stored(again.select("path").distinct())
    bound = stored(now("bindings", "path", here))
    public = stored(now("exports", "path", bound.select("target")))
    wanted = uses(again, bound, public).select("name").unionByName(again.select(F.col("src").alias("name"))).distinct()
    defs = stored(now("entities", "name", wanted))
    first = stored(now("imports", "path", here))
    links = stored(first.unionByName(now("imports", "path", first.select("target"))).distinct())
    paths = here.unionByName(defs.select("path")).unionByName(links.select(F.col("target").alias("path"))).distinct()
    decided = cascade(now("files", "path", paths), defs, again, links, bound, public, of.allowed)
    affected = stored(again.select("id"))
    dropped(*new.values(), *old.values(), moved, names, ends, through, reached, outside, again, here, bound, public, defs, first, links)
    return Delta(decided, withdrawn, affected)
