"""Traversal: expansion by one or more hops, closure, shortest paths, ancestors, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.tables import dropped, stored

#: Predicates that a walk of a kind follows.
WALKS = {"calls": ["CALLS", "REFERENCES"], "imports": ["IMPORTS"], "depends": ["IMPORTS"], "contains": ["CONTAINS"], "all": ["CALLS", "IMPORTS", "CONTAINS", "REFERENCES", "EXTENDS", "IMPLEMENTS"]}


def steps(edges: DataFrame, direction: str, predicates: list[str] | None = None) -> DataFrame:
    """(here, there, predicate): edges as steps of a walk in a direction (in, out or both)."""
    if predicates:
        edges = edges.where(F.col("predicate").isin(predicates))
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "predicate")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "predicate")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def expand(edges: DataFrame, seeds: DataFrame, direction: str = "both", predicates: list[str] | None = None) -> DataFrame:
    """(id, there, predicate): one hop from each of seeds(id)."""
    return steps(edges, direction, predicates).join(seeds.withColumnRenamed("id", "here"), "here").select(F.col("here").alias("id"), "there", "predicate").distinct()


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "in", predicates: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, depth): what is reachable from seeds(id), with the least number of hops; seeds have depth 0.

    Level by level, to the end or to max_depth: each level joins the frontier
    with the edges and drops what earlier levels hold.  Every level is a table
    of its own, written once, so the plan stays short, nothing is rewritten and
    a lost executor costs one level.
    """
    walk = stored(steps(edges, direction, predicates).select("here", "there").distinct())
    levels = [stored(seeds.select("id").distinct().withColumn("depth", F.lit(0)))]
    while max_depth is None or len(levels) <= max_depth:
        reached = walk.join(levels[-1].select(F.col("id").alias("here")), "here").select(F.col("there").alias("id")).distinct()
        frontier = stored(reached.join(_all(levels).select("id"), "id", "left_anti").withColumn("depth", F.lit(len(levels))))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    dropped(walk)
    return _all(levels)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def shortest_path(edges: DataFrame, source: str, target: str, predicates: list[str] | None = None, max_nodes: int = 10) -> DataFrame:
    """(path): the shortest undirected path, the least by its ids among equals; no row if there is none of max_nodes nodes.

    Breadth first; of the paths to one node a level keeps the least, and a node
    that an earlier level holds is not entered again.
    """
    walk = stored(steps(edges, "both", predicates).select("here", "there").distinct())
    spark = edges.sparkSession
    levels = [stored(spark.range(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path")))]
    for _ in range(max_nodes):
        if found := levels[-1].where(F.col("id") == target).head(1):
            return spark.createDataFrame([(found[0].path,)], "path array<string>")
        ahead = walk.join(levels[-1].withColumnRenamed("id", "here"), "here").select(F.col("there").alias("id"), F.array_append("path", F.col("there")).alias("path"))
        ahead = ahead.where(F.size("path") <= max_nodes).join(_all(levels).select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        levels.append(stored(ahead))
        if levels[-1].isEmpty():
            break
    return spark.createDataFrame([], "path array<string>")


def tree(edges: DataFrame, source: str, predicates: list[str], direction: str = "out", max_depth: int = 3, max_nodes: int = 200) -> dict:
    """Depth-first dependency tree of a bounded neighbourhood.

    The reachable subgraph comes from closure(); only its edges reach the
    driver, and at most max_nodes of its nodes.  A node met again is a leaf
    marked as a cycle; attempting depth max_depth + 1 marks the tree as cut.
    """
    spark = edges.sparkSession
    near = closure(edges, spark.createDataFrame([(source,)], "id string"), direction, predicates, max_depth).orderBy("depth", "id").limit(max_nodes)
    walk = steps(edges, direction, predicates).join(near.select(F.col("id").alias("here")), "here").join(near.select(F.col("id").alias("there")), "there")
    order = {p: k for k, p in enumerate(predicates)}
    below: dict[str, list[tuple[int, str, str]]] = {}
    for r in walk.distinct().collect():
        below.setdefault(r.here, []).append((order[r.predicate], r.there, r.predicate))
    seen, state = {source}, {"truncated": False, "visited": 0}

    def grow(node: str, depth: int) -> list[dict]:
        if depth > max_depth:
            state["truncated"] = True
            return []
        out, level = [], set()
        for _, there, predicate in sorted(below.get(node, [])):
            if there in level:
                continue
            level.add(there)
            state["visited"] += 1
            if there in seen:
                out.append({"id": there, "predicate": predicate, "cycle": True, "children": []})
            else:
                seen.add(there)
                out.append({"id": there, "predicate": predicate, "cycle": False, "children": grow(there, depth + 1)})
        return out

    return {"id": source, "children": grow(source, 1)} | state


def ancestors(edges: DataFrame, most: int = 5) -> DataFrame:
    """(id, ancestor, distance): regions above each node, over IN_REGION edges from parent to child."""
    up = edges.where("predicate = 'IN_REGION'").select(F.col("dst").alias("id"), F.col("src").alias("ancestor"))
    level = up.withColumn("distance", F.lit(1))
    out = level
    for k in range(2, most + 1):
        level = level.drop("distance").join(up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("id", F.col("above").alias("ancestor"), F.lit(k).alias("distance"))
        out = out.unionByName(level)
    return out


def bucket_by_region(members: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("region", "module", "subsystem", "system")) -> DataFrame:
    """(region, n): members(id) by their most specific region; (unmapped) without one."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    found = ancestors(edges).join(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("ancestor"), "kind", F.col("name").alias("region")), "ancestor")
    best = found.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(rank, "distance", "region"))).where("rn = 1").select("id", "region")
    return members.join(best, "id", "left").groupBy(F.coalesce("region", F.lit("(unmapped)")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


def expand_by_name(edges: DataFrame, nodes: DataFrame, names: DataFrame, direction: str = "both", predicates: list[str] | None = None) -> DataFrame:
    """(name, id, there, predicate): one hop from all nodes of each of names(name)."""
    seeds = nodes.select("id", "name").join(names.select("name").distinct(), "name")
    return expand(edges, seeds.select("id").distinct(), direction, predicates).join(seeds, "id").select("name", "id", "there", "predicate")


def hops(edges: DataFrame, seeds: DataFrame, direction: str, predicates: list[str], depth: int) -> DataFrame:
    """(id, there): distinct nodes within depth hops of each of seeds(id), apart from it.

    One pass per hop over pairs, for all seeds at once; a pair that an earlier hop
    found is not walked on again.
    """
    walk = stored(steps(edges, direction, predicates).select("here", "there").distinct())
    levels = [stored(seeds.select("id").distinct().select("id", F.col("id").alias("there")))]
    for _ in range(depth):
        ahead = levels[-1].withColumnRenamed("there", "here").join(walk, "here").select("id", "there").distinct()
        levels.append(stored(ahead.join(_all(levels), ["id", "there"], "left_anti")))
        if levels[-1].isEmpty():
            break
    dropped(walk)
    return _all(levels[1:] or levels).where("id <> there")


def callers(edges: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, there, source): callers of each of nodes(id, name) over the graph; of those without any, the paths of lines(path, line, text) that call the name."""
    graph = expand(edges, nodes.select("id"), "in", ["CALLS", "REFERENCES"]).select("id", "there").distinct().withColumn("source", F.lit("graph"))
    none = nodes.select("id", "name").join(graph.select("id").distinct(), "id", "left_anti")
    called = lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias("name")).distinct()
    return graph.unionByName(none.join(called, "name").select("id", F.col("path").alias("there"), F.lit("text").alias("source")))


#: Levels that a trace may go beyond what was asked for, so that names of leaves are known.
SLACK = 7


def bounded_path(edges: DataFrame, source: str, target: str, predicates: list[str] | None, max_depth: int) -> DataFrame:
    """shortest_path with the bound of a trace: max_depth hops and SLACK more."""
    return shortest_path(edges, source, target, predicates, max_depth + SLACK)


def trace_target(candidates: DataFrame, edges: DataFrame, direction: str, predicates: list[str], current: str, pick: int | None = None) -> DataFrame:
    """(id, degree, chosen) of candidates(id, seq), entries of one name: which one a trace starts from.

    The one with most neighbours in the direction; of equal ones the current,
    then the first; none with neighbours leaves the current.  pick counts from 1.
    """
    degree = steps(edges, direction, predicates).groupBy(F.col("here").alias("id")).agg(F.count_distinct("there").alias("degree"))
    rows = candidates.join(degree, "id", "left").select("id", "seq", F.coalesce("degree", F.lit(0)).alias("degree"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("degree"), F.when(F.col("id") == current, 0).otherwise(1), "seq")
    rows = rows.withColumn("rn", F.row_number().over(order))
    if pick is not None:
        return rows.select("id", "degree", (F.col("rn") == pick).alias("chosen"))
    best = F.max("degree").over(Window.partitionBy(F.lit(1)))
    return rows.select("id", "degree", F.when(best > 0, F.col("rn") == 1).otherwise(F.col("id") == current).alias("chosen"))


def effective_regions(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(id, holder): where each node takes its region from: itself, or the nearest container that is in one, files first.

    Containers are climbed level by level over CONTAINS, up to `most` of them.
    """
    mapped = stored(edges.where("predicate = 'IN_REGION'").select(F.col("dst").alias("at")).distinct())
    kinds = nodes.select(F.col("id").alias("at"), (F.col("kind") != "file").cast("int").alias("rank"))
    up = stored(edges.where("predicate = 'CONTAINS'").select(F.col("dst").alias("here"), F.col("src").alias("at")))
    now = nodes.select("id", F.col("id").alias("at"))
    found = []
    for _ in range(most + 1):
        level = stored(now.join(kinds, "at", "left"))
        hit = stored(level.join(mapped, "at", "left_semi").groupBy("id").agg(F.min(F.struct("rank", "at")).alias("b")).select("id", F.col("b.at").alias("holder")))
        found.append(hit)
        now = level.join(hit.select("id"), "id", "left_anti").select("id", F.col("at").alias("here")).join(up, "here").select("id", "at").distinct()
        if now.isEmpty():
            break
    return _all(found)


def overview_leaf(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(id, parent, sibling, rn): the best parent of each leaf and its first siblings, of the leaf's own kind first.

    A structural parent (class, module, ..) ahead of a file, ahead of any.
    """
    structural = F.col("kind").isin("class", "interface", "trait", "object", "module")
    held = edges.where("predicate = 'CONTAINS'").select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    rank = nodes.select(F.col("id").alias("parent"), F.when(structural, 0).when(F.col("kind") == "file", 1).otherwise(2).alias("rank"))
    best = held.join(rank, "parent").groupBy("id").agg(F.min(F.struct("rank", "parent")).alias("b")).select("id", F.col("b.parent").alias("parent"))
    kind = nodes.select("id", "kind", "name")
    # The first of every kind below a parent are enough for all its children.
    children = held.join(kind, "id").withColumn("k", F.row_number().over(Window.partitionBy("parent", "kind").orderBy("name", "id"))).where(F.col("k") <= most + 1)
    children = children.select("parent", F.col("id").alias("sibling"), F.col("kind").alias("sibling_kind"), F.col("name").alias("sibling_name"))
    rows = best.join(kind.select("id", "kind"), "id").join(children, "parent").where("id <> sibling")
    order = Window.partitionBy("id").orderBy((F.col("kind") != F.col("sibling_kind")).cast("int"), "sibling_kind", "sibling_name", "sibling")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).select("id", "parent", "sibling", "rn")
