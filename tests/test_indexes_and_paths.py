"""Text index, revision log, paths of many pairs, as-of joins and vector index against plain versions."""

import random
import re
from bisect import bisect_right
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import analytics as A
from codeloom.operators import asof, paths, revlog, textindex, vectorindex
from codeloom.operators import revisions as V


def plan(df):
    return df._jdf.queryExecution().toString()


TEXTS = [
    (1, "alpha beta\nGamma License here\n\nlast"), (1, "another text of id 1: license"), (2, None), (3, ""), (4, "x"), (5, "ab"), (6, "abc\nabcabc\nab c"), (7, "mail a@b.c\n@\nno at"),
    (8, "é\U0001f600café \U0001f600\U0001f600x"), (9, "spam " * 300 + "\n" + "a" * 500), (None, "orphan license"), (10, "50% off\ta.b*c [x]\r\nend"), (11, "İstanbul ΟΔΟΣ ΟΔΟΣΑ"),
]


@pytest.fixture(scope="module")
def text_index(spark):
    return textindex.build(spark.createDataFrame(TEXTS, "id long, text string").repartition(3))


def lines():
    return [(i, k + 1, line) for i, t in TEXTS if t is not None for k, line in enumerate(t.split("\n"))]


def bag(rows):
    return sorted(map(repr, rows))


NEEDLES = ["license", "License", "abc", "ab", "a", "", "abcabcabc", "\U0001f600x", "é\U0001f600c", "café", "a.b*c", "%", "spam spam", "aaaa", "zzz", "zz", "z", "x\ny", "ΟΔΟΣ", "İs", "\r", "d\r"]


@pytest.mark.parametrize("fold", [False, True])
def test_literals(spark, text_index, fold):
    low = (lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)) if fold else (lambda s: s)
    got = textindex.containing(text_index, spark.createDataFrame([(n,) for n in [*NEEDLES, "abc", None]], "needle string"), fold)
    assert bag(tuple(r) for r in got.collect()) == bag((n, *r) for n in NEEDLES for r in lines() if low(n) in low(r[2]))


PATTERNS = ["(?i)license", "licen[sc]e", "abc|@", "@[a-z]+", "colou?r|spam", "a{2,}", "^x$", r"\bab\b", r"a\.b\*c", "(?:ab)+c", "[xyz]", "Gamma .*here", "e+nd"]


def test_expressions(text_index):
    got = textindex.search(text_index, PATTERNS).collect()
    assert bag(tuple(r) for r in got) == bag((p, *r) for p in PATTERNS for r in lines() if re.search(p, r[2]))
    first = textindex.search(text_index, ["abc"], per_id=1).collect()
    assert [(r.id, r.line_no) for r in first] == [(6, 1)]
    assert textindex.search(text_index, []).count() == 0


def test_needed():
    assert textindex.needed("(?i)license|notice") == ["license", "notice"]
    assert textindex.needed("colou?r") == ["colo"] and textindex.needed("ab*") == ["a"] and textindex.needed(r"x\.y+z") == ["x.y"]
    assert textindex.needed("a{2}bcd") == ["bcd"] and textindex.needed("[a-z]@[0-9]") == ["@"]
    assert textindex.needed("abc|[0-9]") is None and textindex.needed("(abc)") is None and textindex.needed(".*") is None and textindex.needed("") is None


def test_index_is_used(spark, text_index):
    """Postings and lines are pruned by partition, and nothing is a nested loop."""
    df = textindex.candidates(text_index, spark.createDataFrame([("license",)], "needle string"))
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    df = textindex.search(text_index, ["license"])
    df.collect()
    assert "NestedLoop" not in plan(df)
    assert 0 < _read(df) < len(lines()) * 3 / 4  # with the candidates' own table
    df = textindex.candidates(text_index, spark.createDataFrame([("license",)], "needle string"))
    df.collect()
    assert 0 < _read(df) < text_index.postings.count() / 2


def test_names(spark):
    names = ["Brand#11", "red plate", "a", "", "Order#1", "ORDER#12", "\U0001f600\U0001f600", None]
    symbols = ["order#1", "a", "", "late", "zz", "\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    asked = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    got = textindex.names_with(rows, F.lower("name"), asked, F.lower("symbol"))
    assert bag((r.symbol, r.id) for r in got.collect()) == bag((s, k) for s in symbols for k, n in enumerate(names) if n is not None and s in n.lower())
    scored = A.resolve_scores(rows.withColumn("kind", F.lit("class")).withColumn("path", F.lit("p")), asked)
    assert "NestedLoop" not in plan(scored) and scored.count() == got.count()


# ---- revision log ---------------------------------------------------------------------------------------------------


def operations(n, ids, seed=1):
    r = random.Random(seed)
    return [(f"i{r.randrange(ids)}", k + 1, r.choice(["UpsertNode", "UpsertNode", "DeleteNode"]), r.randrange(5) or None) for k in range(n)]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    ops = operations(900, 60)
    df = lambda rows: spark.createDataFrame(rows, "id string, rev long, op string, value long")
    out = revlog.RevisionLog(spark, f"file://{tmp_path_factory.mktemp('log')}", every=100, snapshot_spans=2)
    out.append(df(ops[:430]))
    assert out.compact() == [200, 400]
    out.append(df(ops[430:]))
    assert out.compact() == [600, 800] and out.compact() == [] and out.snapshots() == [200, 400, 600, 800]
    return out, ops, df(ops)


def state(ops, rev):
    now = {}
    for i, r, op, v in ops:
        if r <= rev:
            now[i] = (v, r) if op != "DeleteNode" else None
    return {i: v for i, v in now.items() if v}


@pytest.mark.parametrize("rev", [0, 1, 99, 100, 199, 200, 399, 400, 401, 555, 799, 800, 900, 5000])
def test_log_states(log, rev):
    out, ops, df = log
    got = {r.id: (r.value, r.rev) for r in out.at(rev).collect()}
    assert got == state(ops, rev)
    assert got == {r.id: (r.value, r.rev) for r in V.snapshot(df, rev).collect()}


@pytest.mark.parametrize(("a", "b"), [(0, 900), (150, 160), (200, 201), (399, 800), (500, 500), (650, 651)])
def test_log_differences(log, a, b):
    out, ops, _ = log
    x, y = state(ops, a), state(ops, b)
    want = {i: "added" if i not in x else "removed" if i not in y else "modified" for i in {*x, *y} if i not in x or i not in y or x[i][0] != y[i][0]}
    got = {r.id: r.change for r in out.diff(a, b).collect()}
    assert got == want
    one = min(want, default="i0")
    assert {r.id: r.change for r in out.diff(a, b, one).collect()} == {i: c for i, c in want.items() if i == one}


def test_log_reads_little(log, spark):
    out, ops, _ = log
    df = out.at(650)
    opened = {re.search(r"(span|upto)=(\d+)", f).group() for f in df.inputFiles()}
    assert "upto=600" in opened and not {"upto=200", "upto=400", "upto=800"} & opened
    df.collect()
    assert "PartitionFilters: [isnotnull(span" in plan(df).replace("\n", " ") and "span#" in plan(df)
    metric = _read(df)
    assert metric <= len(state(ops, 599)) + 100 < 650
    asked = spark.createDataFrame([("i3",), ("i5",)], "id string")
    assert bag(tuple(r) for r in out.history(asked, 100, 400).collect()) == bag((i, r, op, v) for i, r, op, v in ops if i in ("i3", "i5") and 100 <= r <= 400)


def _read(df):
    """Rows that the scans of a collected query put out."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


# ---- paths -------------------------------------------------------------------------------------------------------------


def least_path(edges, s, t, most):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    depth, queue = {t: 0}, deque([t])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    if s not in depth or depth[s] >= most:
        return None
    out = [s]
    while out[-1] != t:
        out.append(min(y for y in near[out[-1]] if depth.get(y) == depth[out[-1]] - 1))
    return out


@pytest.mark.parametrize(("n", "m", "most"), [(30, 34, 10), (40, 44, 6), (12, 40, 10)])
def test_paths(spark, n, m, most):
    r = random.Random(n)
    edges = [(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}", r.choice("AB")) for _ in range(m)]
    pairs = [(f"n{a:02}", f"n{b:02}") for a in range(0, n, 3) for b in range(0, n, 2)] + [("n00", "zz"), ("zz", "zz"), ("n00", None), ("n00", "n02")]
    got = paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string, predicate string"), spark.createDataFrame(pairs, "source string, target string"), None, most)
    found = {(x.source, x.target): x.path for x in got.collect()}
    want = {p: q for p in set(pairs) if None not in p and (q := least_path(edges, *p, most))}
    assert found == want and (most < 10 or max(map(len, want.values())) > 3)


def test_paths_long(spark):
    """A line of nodes: both ends share searches with other pairs."""
    edges = [(f"n{k:02}", f"n{k + 1:02}", "A") for k in range(20)]
    pairs = [(f"n{a:02}", f"n{b:02}") for a in range(0, 21, 4) for b in range(21)]
    got = paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string, predicate string"), spark.createDataFrame(pairs, "source string, target string"), ["A"], 10)
    assert {(x.source, x.target): len(x.path) for x in got.collect()} == {(a, b): abs(int(a[1:]) - int(b[1:])) + 1 for a, b in pairs if abs(int(a[1:]) - int(b[1:])) < 10}
    assert paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string, predicate string"), spark.createDataFrame([], "source string, target string")).count() == 0


# ---- as-of joins -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("by", [[], ["k"]])
def test_asof(spark, by):
    r = random.Random(7)
    right = [(r.choice("ab"), r.randrange(60), k) for k in range(80)] + [("c", 10, 1), (None, 5, 2), ("a", None, 3)]
    left = [(r.choice("abd"), r.randrange(70)) for _ in range(200)] + [("a", 30)] * 50 + [(None, 40), ("a", None), ("c", 9), ("c", 10)]
    series = defaultdict(dict)
    for k, at, v in right:
        if at is not None and (k is not None or not by):
            key = k if by else 0
            # Columns that are no key are values, compared in order.
            value = (v,) if by else ((k is not None, k or ""), v)
            series[key][at] = max(series[key].get(at, value), value)
    want = []
    for k, at in left:
        times = sorted(series[k if by else 0]) if (k is not None or not by) else []
        j = bisect_right(times, at) if at is not None else 0
        want.append((k, at, times[j - 1] if j else None, series[k if by else 0][times[j - 1]][-1] if j else None))
    df = spark.createDataFrame(right, "k string, at long, v long")
    got = asof.asof_join(spark.createDataFrame(left, "k string, at long").repartition(3), df if by else df.withColumnRenamed("k", "k2"), "at", by)
    assert bag((x.k, x.at, x.at_right, x.v) for x in got.collect()) == bag(want)


def test_rev_timestamp(spark):
    revs = spark.createDataFrame([(k, f"t{k:03}") for k in range(3, 400, 3)], "rev long, ts string")
    asked = spark.createDataFrame([(k,) for k in (1, 3, 4, 4, 200, 9999)], "rev int")
    assert bag(tuple(r) for r in V.rev_timestamp(revs, asked).collect()) == bag([(3, "t003"), (4, "t003"), (200, "t198"), (9999, "t399")])


# ---- vectors -----------------------------------------------------------------------------------------------------------


def test_vector_index(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 64)
    monkeypatch.setattr(vectorindex, "QUERIES", 7)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.15, (60, 8)) for c in r.normal(0, 1, (10, 8))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(700, x[5].tolist()), (701, [0.0] * 8), (702, None), (703, [1.0] * 7), (704, [float("nan")] * 8), (705, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vectorindex.build(df, lists=8, sample=200, dims=8)
    queries = df.where("vec_id % 13 = 0 or vec_id > 699")
    truth = vectorindex.exact(index, queries, 5, dims=8)
    got = defaultdict(list)
    for t in truth.orderBy("query", "rank").collect():
        got[t.query].append(t.id)
    unit = np.concatenate([x, x[5:6]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ids = [*range(600), 700]
    for k in [q for q in range(0, 600, 13)] + [700]:
        s = np.round(unit @ unit[ids.index(k)], 9)
        assert got[k] == sorted(ids, key=lambda i: (-s[ids.index(i)], i))[:5]
    assert set(got) == {*range(0, 600, 13), 700}
    assert vectorindex.recall(vectorindex.nearest(index, queries, 5, 3, dims=8), truth) >= 0.9
    assert index.table.count() == 601


def test_vector_index_recall(spark):
    """The ids divisible by 100 against all rows."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vectorindex.build(df)
    queries = df.where("vec_id % 100 = 0")
    probes = vectorindex.probes_for(index, queries, 10)
    assert probes < len(index.centroids)
    assert vectorindex.recall(vectorindex.nearest(index, queries, 10, probes), vectorindex.exact(index, queries, 10)) >= 0.9
