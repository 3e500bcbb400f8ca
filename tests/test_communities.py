"""Communities: repeatable, at a state that no single move improves, and of the modularity that is stated."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.operators import analytics as A


def graph(kind, seed=1):
    r = random.Random(seed)
    if kind == "cliques":
        links = [(f"{c}{i}", f"{c}{j}", 3.0) for c in "abcd" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("c2", "d2", 1.0)]
    elif kind == "star":
        links = [("hub", f"leaf{k:03}", float(1 + k % 3)) for k in range(120)] + [(f"leaf{k:03}", f"leaf{k + 1:03}", 1.0) for k in range(0, 40, 2)]
    else:
        links = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}", r.choice([0.5, 1.0, 2.0])) for _ in range(160)]
    return links


def best_gain(links, of, resolution):
    """The largest rise of modularity, times 2m^2, by moving one node; and modularity itself."""
    w, k = defaultdict(float), defaultdict(float)
    for a, b, x in links:
        if a != b:
            w[a, b] += x
            w[b, a] += x
            k[a] += x
            k[b] += x
    total, size = sum(k.values()), defaultdict(float)
    for i, c in of.items():
        size[c] += k[i]
    to = defaultdict(lambda: defaultdict(float))
    for (a, b), x in w.items():
        to[a][of[b]] += x
    best = max((total * (x - to[i][of[i]]) - resolution * k[i] * (size[c] - size[of[i]] + k[i]) for i in of for c, x in list(to[i].items()) if c != of[i]), default=0)
    return best, sum(x for (a, b), x in w.items() if of[a] == of[b]) / total - resolution * sum(x * x for x in size.values()) / total**2


@pytest.mark.parametrize(("kind", "resolution"), [("cliques", 1.0), ("star", 1.0), ("random", 1.0), ("random", 0.3)])
def test_communities(spark, kind, resolution):
    links = graph(kind)
    df = spark.createDataFrame(links, "a string, b string, weight double")
    got = [{r.id: r.community for r in A.communities(x, resolution).collect()} for x in ((df.repartition(3), df.orderBy(F.desc("b")).coalesce(1)) if kind == "cliques" else (df,))]
    assert got[0] == got[-1]  # bit by bit
    assert set(got[0]) == {x for a, b, _ in links if a != b for x in (a, b)}
    best, q = best_gain(links, got[0], resolution)
    assert best <= 1e-6
    member = spark.createDataFrame(list(got[0].items()), "id string, community string")
    assert A.modularity(df, member, resolution) == pytest.approx(q)
    assert all(r.gain <= 1e-6 for r in A.gains(df, member, resolution).collect())
    if kind == "cliques":
        assert len(set(got[0].values())) == 4 and q > 0.6
    alone = member.withColumn("community", F.col("id"))
    assert max(r.gain for r in A.gains(df, alone, resolution).collect()) == pytest.approx(best_gain(links, {i: i for i in got[0]}, resolution)[0])


def test_no_links(spark):
    none = spark.createDataFrame([("a", "a", 1.0)], "a string, b string, weight double")
    assert A.communities(none).count() == 0 and A.modularity(none, A.communities(none)) == 0.0


def test_rounds_of_a_dense_graph(spark, monkeypatch):
    """Every round writes tables; where all is linked with all, they are few."""
    r = random.Random(5)
    links = [(f"c{i:03}", f"s{j:02}", float(r.randrange(1, 4))) for i in range(150) for j in r.sample(range(30), 12)]
    tables, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda *a: tables.append(1) or stored(*a))
    df = spark.createDataFrame(links, "a string, b string, weight double")
    got = {x.id: x.community for x in A.communities(df).collect()}
    assert best_gain(links, got, 1.0)[0] <= 1e-6
    assert len(tables) <= 60


@pytest.mark.parametrize("in_turn", [0, 200])
def test_rounds_of_many_copies_are_few(spark, monkeypatch, in_turn):
    """Moves at once that use up each other's gain are held back, and the last ones are made one by one; without an end in turn the state is one that no move improves, too."""
    r = random.Random(7)
    links = [(f"c{i:03}", f"s{i // 40}{j:02}", float(r.randrange(1, 4))) for i in range(160) for j in r.sample(range(25), 10)]
    rounds, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df: rounds.append("gain" in df.columns) or stored(df))
    monkeypatch.setattr(A, "IN_TURN", in_turn)
    got = {x.id: x.community for x in A.communities(spark.createDataFrame(links, "a string, b string, weight double")).collect()}
    assert best_gain(links, got, 1.0)[0] <= 1e-6 and len(set(got.values())) >= 4
    assert sum(rounds) <= (25 if in_turn else 40)
    plan = A.bucketed(spark.range(100).selectExpr("id % 7 as id", "id as other"), "id", lambda rows: rows).groupBy("id", "other").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_small_graphs_take_few_rounds(spark, monkeypatch):
    links = graph("random", 3)
    rounds, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df: rounds.append("gain" in df.columns) or stored(df))
    got = {x.id: x.community for x in A.communities(spark.createDataFrame(links, "a string, b string, weight double")).collect()}
    assert best_gain(links, got, 1.0)[0] <= 1e-6 and sum(rounds) <= 4
