"""Incremental resolution: after a change of files the patched verdicts are those of a full run."""

import random

import pytest

from codeloom.operators import incremental
from codeloom.operators import resolve as R

SCHEMAS = {
    "files": "path string, language string, repo string",
    "entities": "path string, seq long, name string, container string, start long, end long",
    "relationships": "id long, path string, src string, name string, predicate string, bound boolean",
    "imports": "path string, target string",
    "bindings": "path string, local string, imported string, target string",
    "exports": "path string, public string, local string",
}
NAMES = [f"n{k}" for k in range(14)] + ["get", "Klass"]


def file_rows(r, path, paths, at):
    """The rows of one file; ids of relationships from `at`."""
    defs = [(path, k, r.choice(NAMES), r.choice([None, None, "Klass", "Other"]), 10 * k, 10 * k + r.randrange(25)) for k in range(r.randrange(1, 5))]
    links = [(path, p) for p in r.sample(paths, 2) if p != path]
    bind = [(path, f"b{path[-4]}", r.choice([*NAMES, "pub", "default"]), p) for _, p in links[:1]]
    name = lambda: r.choice([r.choice(NAMES), r.choice(NAMES), f"Klass.{r.choice(NAMES)}", f"n1.{r.choice(NAMES)}", f"b{path[-4]}"])
    return {
        "files": [(path, r.choice(["python", "java", "c", "typescript"]), r.choice(["r1", "r2", None]))],
        "entities": defs,
        "relationships": [(at + k, path, r.choice(defs)[2], name(), r.choice(["CALLS", "CALLS", "REFERENCES", "EXTENDS"]), r.choice([None, None, True, False])) for k in range(r.randrange(1, 6))],
        "imports": links,
        "bindings": bind,
        "exports": [(path, "pub", r.choice(defs)[2])] if r.random() < 0.6 else [],
    }


def frames(spark, rows):
    return {name: spark.createDataFrame([x for f in rows.values() for x in f[name]], SCHEMAS[name]) for name in SCHEMAS}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patched_equals_full(spark, seed):
    r = random.Random(seed)
    paths = [f"src/d{k % 3}/f{k}.py" for k in range(16)]
    before = {p: file_rows(r, p, paths, 100 * k) for k, p in enumerate(paths)}
    changed = r.sample(paths, 3)
    after = {p: rows for p, rows in before.items() if p != changed[0]}  # the first is removed
    for k, p in enumerate(changed[1:]):
        after[p] = file_rows(r, p, paths, 100 * paths.index(p) + 50 * (k % 2))
    after["src/d9/new.py"] = file_rows(r, "src/d9/new.py", paths, 9000)
    allowed = spark.createDataFrame([("r1", "r2")], "src string, dst string")
    of = incremental.base(**frames(spark, before), allowed=allowed)
    touched = [*changed, "src/d9/new.py"]
    delta = incremental.apply(of, spark.createDataFrame([(p,) for p in touched], "path string"), **frames(spark, {p: after[p] for p in touched if p in after}))
    got = sorted(map(repr, (tuple(x) for x in delta.patched(of.verdicts).collect())))
    full = R.cascade(**frames(spark, after), allowed=allowed)
    assert got == sorted(map(repr, (tuple(x) for x in full.select(*of.verdicts.columns).collect())))
    n = sum(len(f["relationships"]) for f in after.values())
    assert 0 < delta.affected.count() < n


def test_nothing_changes(spark):
    """A change without a difference decides only what stands in its files again; buckets without asked keys are not read."""
    r = random.Random(9)
    paths = [f"src/f{k}.py" for k in range(12)]
    rows = {p: file_rows(r, p, paths, 100 * k) for k, p in enumerate(paths)}
    of = incremental.base(**frames(spark, rows))
    delta = incremental.apply(of, spark.createDataFrame([(paths[4],)], "path string"), **frames(spark, {paths[4]: rows[paths[4]]}))
    assert sorted(x.id for x in delta.affected.collect()) == [x[0] for x in rows[paths[4]]["relationships"]]
    assert sorted(map(repr, delta.patched(of.verdicts).collect())) == sorted(map(repr, of.verdicts.collect()))
    some = of.by("entities", "name", spark.createDataFrame([("n3",)], "name string"))
    some.collect()
    assert "PartitionFilters: [isnotnull(_bucket" in some._jdf.queryExecution().toString()
    assert sorted(map(repr, map(tuple, some.collect()))) == sorted(repr(e) for f in rows.values() for e in f["entities"] if e[2] == "n3")
