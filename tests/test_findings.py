"""Small tables of what went wrong on larger ones."""

from pyspark.sql import functions as F

from codeloom import catalogue, tables
from codeloom.operators import explain, lookup, paths, resolve, revlog, textindex
from codeloom.sources import extract

SF = "/root/testdata/sf0.001"


def test_expand_in_has_seeds_with_edges(spark):
    got = catalogue.QUERIES["expand_in"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_html_extract_of_pages_with_one_url(spark, tmp_path):
    html = '<a href="/x">1</a><a href="/x">2</a><img src="/y">'
    spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "v", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["html_extract"](spark, str(tmp_path)).collect())
    assert got == [(u, t, "IMPORTS") for u in "uv" for t in ("/x", "/y")]


def test_log_of_many_spans(spark, tmp_path):
    """Spans and snapshots grow with the logarithm of the log, states stay right."""
    n = 8000
    out = revlog.RevisionLog(spark, f"file://{tmp_path}/log", every=5, snapshot_spans=2)
    rows = spark.range(1, n + 1).selectExpr("concat('i', id % 500) as id", "id as rev", "if(id % 7 = 0, 'DeleteNode', 'UpsertNode') as op", "id as value")
    for batch in (rows.where("rev <= 4000"), rows.where("rev > 4000")):
        out.append(batch)
        out.compact()
    assert len(out._names("deltas", "span")) <= 128 + 4 * 64 and 10 <= len(out.snapshots()) <= 40
    for rev in (1, 640, 4001, 6399, n):
        last = {r % 500: r for r in range(1, rev + 1)}
        assert sorted((r.id, r.value) for r in out.at(rev).collect()) == sorted((f"i{k}", r) for k, r in last.items() if r % 7)
    asked = spark.createDataFrame([("i3",)], "id string")
    assert sorted(r.rev for r in out.history(asked, 1000, 6003).collect()) == [r for r in range(1000, 6004) if r % 500 == 3]
    assert sorted(r.rev for r in out.history(asked).collect()) == list(range(3, n + 1, 500))


def test_downstream_is_not_broadcast(spark):
    """Its files are far smaller than its rows."""
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS")], "src string, dst string, predicate string")
    out = nodes.join(explain.downstream(edges, nodes), "id", "left")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 0), ("b", 1, 1), ("c", 2, 2)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_frequent_names_of_one_file(spark):
    """No pairs of the spans of a caller's name and of a called name, where no import binds it."""
    n = 3000
    rows = spark.range(n)
    files = spark.createDataFrame([("a.py", "python", "r")], "path string, language string, repo string")
    entities = rows.selectExpr("'a.py' as path", "id as seq", "'same' as name", "string(null) as container", "id as start", "id + 2 as end")
    relations = rows.selectExpr("id", "'a.py' as path", "'same' as src", "'same' as name", "'CALLS' as predicate", "boolean(null) as bound")
    imports = spark.createDataFrame([], "path string, target string")
    got = resolve.cascade(files, entities, relations, imports)
    assert got.where("tier = '1-same-file' and verdict = 'stop'").count() == n


def test_facts_join_no_names_that_are_not_asked_for(spark):
    out = catalogue.QUERIES["facts"](spark, SF)
    assert "Join LeftOuter, (container_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_is_spread_over_tasks_and_runs_once(spark):
    """Files of one small partition go to all tasks; chunks join what was extracted once."""
    rows = [(f"src/m{k}.ts", "typescript", "class K {\n  go() {\n  }\n}\n" if k % 2 else "") for k in range(20)]
    files = spark.createDataFrame(rows, "path string, language string, content string").coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for out in (extract.extract(files), extract.bindings(files)):
        assert out.rdd.getNumPartitions() == n
    got = extract.chunks(extract.extract(files), files)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan")].count("MapInPandas") == 1
    kinds = sorted((r.path, r.kind) for r in got.collect())
    assert kinds == sorted([(p, k) for p, _, c in rows for k in (("class", "method") if c else ("file_body",))])


def test_levels_of_paths_have_one_row_a_node(spark, monkeypatch):
    """However many parents a node has, and in however many nodes a pair meets."""
    n, sizes = 20, []

    def counted(df, parts=None):
        out = tables.stored(df, parts)
        if {"root", "node"} <= set(out.columns) or {"source", "target", "a", "b"} <= set(out.columns):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(paths, "stored", counted)
    edges = [("s", f"a{i:02}", "E") for i in range(n)] + [(f"a{i:02}", f"b{j:02}", "E") for i in range(n) for j in range(n)] + [(f"b{j:02}", "t", "E") for j in range(n)]
    got = paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string, predicate string"), spark.createDataFrame([("s", "t")], "source string, target string"), None, 6)
    assert [tuple(r) for r in got.collect()] == [("s", "t", ["s", "a00", "b00", "t"])]
    assert max(sizes) <= 2 * n + 2


def test_few_needles_do_not_take_names_apart(spark):
    names = ["red plate", "RED", "a\nb", "ab", "Straße", ""]
    needles = ["red", "d p", "a\nb", "b", "", "zz", "aße"]
    rows, asked = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    found = textindex.names_with(rows, F.lower("name"), asked, F.col("needle"))
    assert "regexp_extract_all(concat(translate(lower(name" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r.name, r.needle) for r in found.collect()) == sorted((n, x) for n in names for x in needles if x in n.lower())


def test_tasks_of_larger_tables_are_not_larger(spark, monkeypatch):
    """Partitions grow in number with the bytes of the tables, not in rows, whatever number the session has."""
    keys = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        small = catalogue.QUERIES["callers"](spark, SF).count()
        assert spark.conf.get(keys[0], None) == before[keys[0]]
        monkeypatch.setattr(tables, "PART_BYTES", 1 << 10)
        monkeypatch.setattr(tables, "TASK_BYTES", 1 << 11)
        got = catalogue.QUERIES["callers"](spark, SF)
        n = int(spark.conf.get(keys[0]))
        assert n > 100 and spark.conf.get(keys[1]) == str(1 << 11)
        assert got.count() == small and f", {n}), ENSURE_REQUIREMENTS" in got._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_located_climbs_as_far_as_containers_reach(spark, monkeypatch):
    """Entities without a container are joined no further, and those in deep ones have all crumbs."""
    rounds = []
    monkeypatch.setattr(lookup, "stored", lambda df: rounds.append(df) or tables.stored(df))
    nodes = spark.createDataFrame([(c, c.upper(), f"p{c}", 1, 2) for c in "abcdx"], "id string, name string, path string, start int, end int")
    edges = spark.createDataFrame([("a", "b", "CONTAINS"), ("b", "c", "CONTAINS"), ("gone", "a", "CONTAINS"), ("c", "d", "CALLS"), ("x", "c", "CONTAINS")], "src string, dst string, predicate string")
    state = spark.createDataFrame([("pc", "modified")], "path string, state string")
    want = {"a": ("A", None, False), "b": ("A > B", "A", False), "c": ("A > B > C", "B", True), "d": ("D", None, False), "x": ("X", None, False)}
    got = lookup.locate(nodes.select("id"), nodes, edges, state)
    assert {r.id: (r.breadcrumb, r.container, r.stale) for r in got.collect()} == want and got.count() == 5
    assert len(rounds) == 5  # containers, and a round for each level up to one that nothing is above
    short = {r.id: r.breadcrumb for r in lookup.locate(nodes.select("id"), nodes, edges, state, most=1).collect()}
    assert short == {"a": "A", "b": "A > B", "c": "B > C", "d": "D", "x": "X"}
