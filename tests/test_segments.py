"""Postings are sorted where they are made; walks begin with the neighbours."""

from codeloom.operators import explain, textindex


def test_postings_are_not_shuffled(spark, monkeypatch):
    plans, stored = [], textindex.stored
    monkeypatch.setattr(textindex, "stored", lambda df, *a: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or stored(df, *a))
    monkeypatch.setattr(textindex, "SEGMENT_BYTES", 1 << 10)
    index = textindex.build(spark.range(300).selectExpr("id", "concat('line ', id, '\nlicense ', sha2(string(id), 256)) as text"))
    plan = next(p for c, p in plans if "gram" in c and "at" in c)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the one below takes lines
    assert "rangepartitioning" not in plan
    assert textindex.search(index, ["license", "line 7"]).count() == 300 + len([k for k in range(300) if str(k).startswith("7")])


def test_index_of_no_lines(spark):
    index = textindex.build(spark.createDataFrame([(1, None)], "id long, text string"))
    assert textindex.search(index, ["license"]).count() == 0


def test_first_hop_is_not_looked_up_again(spark, monkeypatch):
    """Neighbours are distinct already; no pairs of the first hop are held against what was seen, and all depths count."""
    from codeloom import tables

    sizes, stored = [], tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, *a: sizes.append(sorted(df.columns)) or stored(df, *a))
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "d", "CALLS"), ("d", "e", "CALLS"), ("e", "f", "CALLS"), ("a", "a", "CALLS"), ("a", "b", "IMPORTS"), ("b", "a", "CALLS")], "src string, dst string, predicate string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefz"], "id string")
    want = {"a": (1, 1), "b": (1, 1), "c": (2, 2), "d": (3, 3), "e": (4, 4), "f": (4, 4), "z": (0, 0)}
    got = {r.id: (r.downstream, r.downstream_depth) for r in explain.downstream(edges, nodes).collect()}
    assert got == want
    assert sizes.count(["depth", "id", "there"]) == 4 + 3  # a table a hop, and what was seen from the second on
