"""From what a user types to an entity: scope, file-first and scoped resolution, prefixes, picks, spans and details.

nodes(id, kind, name, path, role, ws, start, end); requests(target, ..) hold
one row for each thing asked, and all of them are answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import analytics as A
from codeloom.tables import stored

#: Extensions that make a target look like a file.
FILE_ENDS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".scala", ".sc", ".java", ".py", ".rb", ".go", ".rs", ".md", ".mdx", ".rst", ".txt", ".json", ".yaml", ".yml", ".toml", ".ini", ".conf",
    ".sql", ".graphql", ".gql", ".sh", ".bash", ".html", ".css", ".scss", ".less",
)
#: Kinds that a class's name may have, that a member may have, and those of any symbol, in the order of preference.
HOLDERS = ("class", "interface", "struct", "trait", "object", "function")
MEMBERS = ("method", "function")
SYMBOLS = ("file", "class", "object", "trait", "interface", "module", "method", "function")
#: Scores up to which a match counts as exact and as preferred, and how far ambiguous ones may lie behind the best, and how many are shown.
EXACT, PREFERRED, BEHIND, SHOWN = 0, 5, 5, 8


def read_scope(here: DataFrame, members: DataFrame, stitched: DataFrame) -> DataFrame:
    """here(ws) -> (ws, scope, scope_id): the system that ws is a member(ws, system_id) of, or was stitched(ws, system_id) into, else the workspace itself."""
    rows = here.join(members.select("ws", F.col("system_id").alias("own")), "ws", "left").join(stitched.select("ws", F.col("system_id").alias("joined")), "ws", "left")
    system = F.coalesce("own", "joined")
    return rows.select("ws", F.when(system.isNotNull(), "system").otherwise("workspace").alias("scope"), F.coalesce(system, "ws").alias("scope_id"))


def in_scope(nodes: DataFrame, scope: DataFrame, members: DataFrame) -> DataFrame:
    """nodes(ws, ..) that a scope(scope, scope_id) reads: those of one workspace, or of all members(ws, system_id) of a system."""
    of = scope.where("scope = 'workspace'").select(F.col("scope_id").alias("ws")).unionByName(scope.where("scope = 'system'").join(members, F.col("scope_id") == F.col("system_id")).select("ws"))
    return nodes.join(of.distinct(), "ws", "left_semi")


def looks_like_file(target: Column) -> Column:
    """A path, or a name with an extension of sources or documents."""
    return F.contains(target, F.lit("/")) | F.contains(target, F.lit("\\")) | X.extname(target).isin(*FILE_ENDS)


def scoped_symbol(target: Column) -> Column:
    """struct(holder, member) of Holder::member, cut at the last ::; null if either part is empty."""
    at = F.length(target) - F.instr(F.reverse(target), "::")
    holder, member = F.substring(target, F.lit(1), at - 1), F.substring(target, at + 2, F.length(target))
    return F.when(F.contains(target, F.lit("::")) & (holder != "") & (member != ""), F.struct(holder.alias("holder"), member.alias("member")))


def resolve_prefix(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests(target) of id prefixes -> (target, status, id): found, ambiguous or missing.

    Prefixes meet ids by their first eight characters, so nothing is compared
    with everything.
    """
    few = requests.select("target").distinct().withColumn("head", F.substring(F.lower("target"), 1, 8))
    hits = nodes.select("id").withColumn("head", F.substring(F.lower("id"), 1, 8)).join(few, "head").where(F.startswith(F.lower("id"), F.lower("target")))
    found = hits.groupBy("target").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"))
    return few.select("target").join(found, "target", "left").select("target", F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("id"))


def resolution_mode(score: Column, with_kind: bool = False) -> Column:
    return F.lit("exact") if with_kind else F.when(score <= EXACT, "exact").when(score <= PREFERRED, "preferred-kind").otherwise("scored")


def resolve_entities(requests: DataFrame, nodes: DataFrame, preferred: tuple[str, ...] = SYMBOLS, kind: str | None = None, path: str | None = None, pick: int | None = None, tests: str = "hide") -> DataFrame:
    """requests(target) -> (target, verdict, id, mode, n, hidden): how each name resolves.

    Roles first (tests: hide, only or all), then a hard path filter; names equal
    in case ahead of equal ones ahead of all that contain the target; the best is
    picked as resolve_verdicts does, and an ambiguous target by its number.
    """
    rows = nodes if kind is None else nodes.where(F.col("kind") == kind)
    scored = stored(A.resolve_scores(rows, requests.select(F.col("target").alias("symbol")).distinct(), kind, path))
    other = F.col("role").isin("test", "fixture")
    if tests == "only":
        scored = scored.where(other).withColumn("hidden", F.lit(0))
    elif tests == "hide":
        scored = A.role_filter(scored, ["symbol"])
    else:
        scored = scored.withColumn("hidden", F.lit(0))
    if path is not None:
        scored = scored.where(F.contains(F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/"))), F.lit(path.lower().replace("\\", "/"))))
    level = F.when(F.col("name") == F.col("symbol"), 0).when(F.lower("name") == F.lower("symbol"), 1).otherwise(2)
    scored = scored.withColumn("level", level)
    best = scored.groupBy("symbol").agg(F.min("level").alias("level"), F.max("hidden").alias("hidden"))
    scored = scored.drop("hidden").join(best, ["symbol", "level"])
    verdicts = stored(A.resolve_verdicts(scored, preferred))
    if pick is not None:
        shown = ambiguous(scored, preferred).where(F.col("rn") == pick).select("symbol", F.col("id").alias("picked"))
        verdicts = verdicts.join(shown, "symbol", "left").withColumn("pick", F.coalesce("pick", "picked")).withColumn("verdict", F.when(F.col("verdict") != "ambiguous", F.col("verdict")).when(F.col("picked").isNotNull(), "picked").otherwise("out-of-range")).drop("picked")
    out = requests.select("target").distinct().join(verdicts.join(best.select("symbol", "hidden"), "symbol"), F.col("target") == F.col("symbol"), "left")
    mode = F.when(F.col("verdict") == "picked", "scored").when(F.col("pick").isNotNull(), resolution_mode(F.col("score"), kind is not None)).when(F.col("verdict") == "ambiguous", "ambiguous")
    return out.select("target", F.coalesce("verdict", F.lit("missing")).alias("verdict"), F.col("pick").alias("id"), mode.alias("mode"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hidden", F.lit(0)).alias("hidden"))


def ambiguous(scored: DataFrame, preferred: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """scored(symbol, id, kind, score) -> the candidates to pick from, numbered from 1: the best SHOWN within BEHIND of the best."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in preferred]), F.col("kind")), F.lit(0)), F.lit(len(preferred) + 1))
    rows = scored.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("score", rank, "id"))).withColumn("best", F.min("score").over(Window.partitionBy("symbol")))
    return rows.where((F.col("rn") <= SHOWN) & (F.col("score") <= F.col("best") + BEHIND))


def file_matches(requests: DataFrame, nodes: DataFrame, path: str | None = None) -> DataFrame:
    """requests(target) that look like files -> (target, id, quality): path match 0, file name 1, name without extension 2; then the shortest path.

    Names are compared by equality on the name without its extension, so the
    files meet the requests in an equi-join.
    """
    norm = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    bare = lambda c: F.regexp_replace(F.lower(X.basename(c)), r"\.[^.]+$", "")
    asked = requests.select("target").distinct().withColumn("bare", bare(F.col("target")))
    files = nodes.where("kind = 'file'").withColumn("bare", bare(F.col("name")))
    rows = files.join(asked, "bare").withColumn("uri", norm(F.col("path"))).withColumn("low", norm(F.col("target")))
    has_path = F.contains("target", F.lit("/")) | F.contains("target", F.lit("\\"))
    by_path = has_path & (F.endswith("uri", F.col("low")) | (F.contains("uri", F.lit("/")) & F.endswith("low", F.col("uri"))))
    same = F.lower("name") == F.lower(X.basename(F.col("target")))
    hinted = F.contains("uri", F.lit(path.lower().replace("\\", "/"))) if path else F.lit(False)
    quality = F.when(by_path | (hinted & same), 0).when(same, 1).otherwise(2)
    rows = rows.withColumn("quality", quality)
    best = F.min(F.struct("quality", F.length("uri").alias("length"), "uri", "id"))
    return rows.groupBy("target").agg(best.alias("b")).select("target", "b.id", "b.quality")


def resolve_file_or_entity(requests: DataFrame, nodes: DataFrame, path: str | None = None, pick: int | None = None) -> DataFrame:
    """requests(target) -> (target, how, id): an id, an id's prefix, a file, a member of a holder, a symbol, in this order of attempts.

    A scoped name is looked for near the file of its holder, or of the holder's
    name in snake case; one that is not found is not looked for as a whole.
    """
    # Each attempt is written once: the next ones ask for what it leaves.
    nodes, asked = stored(nodes), stored(requests.select("target").distinct())
    ids = asked.join(nodes.select(F.col("id").alias("target"), F.col("id")).distinct(), "target").where(X.raw_id(F.col("target")) | F.contains("target", F.lit(":"))).select("target", F.lit("id").alias("how"), "id")
    ids = stored(ids)
    left = asked.where(~X.raw_id(F.col("target"))).join(ids.select("target"), "target", "left_anti")
    short = resolve_prefix(left.where(F.rlike("target", F.lit("(?i)^[0-9a-f]{8,31}$"))), nodes).where("status = 'found'").select("target", F.lit("prefix").alias("how"), "id")
    short = stored(short)
    left = left.join(short.select("target"), "target", "left_anti")
    files = file_matches(left.where(looks_like_file(F.col("target"))), nodes, path).select("target", F.lit("file").alias("how"), "id")
    files = stored(files)
    left = stored(left.join(files.select("target"), "target", "left_anti").withColumn("s", scoped_symbol(F.col("target"))))
    scoped = left.where("s is not null").select("target", F.substring_index("s.holder", "::", -1).alias("holder"), "s.member")
    holders = resolve_entities(scoped.select(F.col("holder").alias("target")), nodes.where(F.col("kind").isin(*HOLDERS)), HOLDERS)
    at = holders.where("id is not null").join(nodes.select("id", "path"), "id").select(F.col("target").alias("holder"), F.lower(F.regexp_replace(X.basename(F.col("path")), r"\.[^.]+$", "")).alias("hint"))
    scoped = scoped.join(at, "holder", "left").withColumn("hint", F.coalesce("hint", X.camel_to_snake(F.col("holder"))))
    near = nodes.where(F.col("kind").isin(*MEMBERS)).join(scoped, F.lower("name") == F.lower("member")).where(F.contains(F.lower("path"), F.col("hint")))
    preferred = F.when(F.col("kind") == "method", 0).otherwise(1)
    members = near.groupBy("target").agg(F.min(F.struct((F.col("name") != F.col("member")).alias("case"), preferred.alias("rank"), F.length("path").alias("length"), "id")).alias("b")).select("target", F.lit("scoped").alias("how"), "b.id")
    symbols = resolve_entities(left.where("s is null").select("target"), nodes, SYMBOLS, None, path, pick).where("id is not null").select("target", F.lit("symbol").alias("how"), "id")
    return ids.unionByName(short).unionByName(files).unionByName(members).unionByName(symbols)


def details(requested: DataFrame, nodes: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """requested(id) -> (id, kind, name, n_claims, n_in, n_out, edges): a node with its claims(entity, ..) and its incident edges, in order."""
    few = requested.select("id").distinct()
    out = edges.join(few.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.struct(F.lit("out").alias("direction"), "predicate", F.col("dst").alias("other")).alias("e"))
    into = edges.join(few.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.struct(F.lit("in").alias("direction"), "predicate", F.col("src").alias("other")).alias("e"))
    held = out.unionByName(into).groupBy("id").agg(F.count_if(F.col("e.direction") == "in").alias("n_in"), F.count_if(F.col("e.direction") == "out").alias("n_out"), F.array_sort(F.collect_list("e")).alias("edges"))
    said = claims.groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("n_claims"))
    rows = nodes.join(few, "id").select("id", "kind", "name").join(said, "id", "left").join(held, "id", "left")
    return rows.select("id", "kind", "name", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), "edges")


def staleness(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, state) of files(path, modified) against the baseline(path, modified) of the last ingest: fresh, modified, new or deleted."""
    both = files.select("path", F.col("modified").alias("now")).join(baseline.select("path", F.col("modified").alias("then")), "path", "full")
    return both.select("path", F.when(F.col("now").isNull(), "deleted").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "modified").otherwise("fresh").alias("state"))


def locate(requested: DataFrame, nodes: DataFrame, edges: DataFrame, state: DataFrame, most: int = 8) -> DataFrame:
    """requested(id) -> (id, path, start, end, container, breadcrumb, stale): where an entity stands.

    The breadcrumb leads over CONTAINS edges, from the outermost container to the
    entity; of several containers the least id counts.
    """
    up = edges.where("predicate = 'CONTAINS'").groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("parent"))
    above = stored(up.join(nodes.select(F.col("id").alias("parent"), F.col("name").alias("parent_name")), "parent", "left").select("at", "parent", "parent_name"))
    level = requested.select("id").distinct().join(nodes.select("id", "name"), "id").select("id", F.col("id").alias("at"), F.array("name").alias("crumbs"))
    ended = []
    for _ in range(most):
        crumbs = F.when(F.col("parent_name").isNotNull(), F.concat(F.array("parent_name"), F.col("crumbs"))).otherwise(F.col("crumbs"))
        climbed = stored(level.join(above, "at", "left").select("id", F.col("parent").alias("at"), crumbs.alias("crumbs")))
        # What has come to the top is joined no further: it has no key, and would meet in one task.
        ended.append(climbed.where("at is null"))
        level = climbed.where("at is not null")
        if level.isEmpty():
            break
    for part in ended:
        level = level.unionByName(part)
    rows = requested.select("id").distinct().join(nodes.select("id", "path", "start", "end"), "id").join(above.withColumnRenamed("at", "id"), "id", "left")
    rows = rows.join(level.select("id", F.array_join("crumbs", " > ").alias("breadcrumb")), "id").join(state, "path", "left")
    return rows.select("id", "path", "start", "end", F.col("parent_name").alias("container"), "breadcrumb", (F.coalesce("state", F.lit("fresh")) != "fresh").alias("stale"))


def read(requested: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """requested(target) -> (target, status, path, first, last, text): path, path:from-to, a file name that only one file has, or a symbol's lines.

    files(path, content).  A name that several files or symbols have is
    ambiguous, and status says so.
    """
    cut = requested.select("target").distinct().withColumn("at", F.regexp_extract("target", r"^(.*?)(?::(\d+)(?:-(\d+))?)?$", 1)).withColumn("from", F.regexp_extract("target", r":(\d+)(?:-(\d+))?$", 1).try_cast("int")).withColumn("to", F.regexp_extract("target", r":(\d+)-(\d+)$", 2).try_cast("int"))
    by_path = cut.join(files.select(F.col("path").alias("at"), F.col("path").alias("file")), "at").select("target", "from", "to", "file", F.lit(0).alias("rank"))
    by_name = cut.join(files.select(X.basename(F.col("path")).alias("at"), F.col("path").alias("file")), "at").select("target", "from", "to", "file", F.lit(1).alias("rank"))
    symbols = cut.join(nodes.where("kind <> 'file' and start is not null").select(F.col("name").alias("at"), F.col("path").alias("file"), "start", "end"), "at").select("target", F.col("start").alias("from"), F.col("end").alias("to"), "file", F.lit(2).alias("rank"))
    rows = by_path.unionByName(by_name).unionByName(symbols)
    best = rows.groupBy("target").agg(F.min("rank").alias("rank"))
    rows = rows.join(best, ["target", "rank"]).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "from", "to")).alias("r"))
    rows = cut.select("target").join(rows, "target", "left").select("target", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"), F.when(F.col("n") == 1, F.col("r")).alias("r"))
    rows = rows.select("target", "status", F.col("r.file").alias("path"), "r.from", "r.to").join(files, "path", "left").withColumn("lines", F.split("content", "\n", -1))
    first = F.coalesce("from", F.lit(1))
    last = F.least(F.coalesce("to", F.when(F.col("from").isNotNull(), F.col("from")).otherwise(F.size("lines"))), F.size("lines"))
    return rows.select("target", "status", "path", F.when(F.col("status") == "found", first).alias("first"), F.when(F.col("status") == "found", last).alias("last"), F.when(F.col("status") == "found", F.array_join(F.slice("lines", F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")).alias("text"))
