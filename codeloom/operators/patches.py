"""Patches: what a parsed file asserts, as rows of operations, and how patches enter the log.

files(ws, path, source_hash), entities(path, seq, name, kind, container),
relationships(path, seq, src, dst, predicate, variant), chunks(path, seq, name,
kind, container, line_start).  An operation is a row (path, op_seq, op_type, id,
kind, name, src, dst, predicate, field, value); op_seq orders a file's patch.
A path of several repositories may begin with the member's directory: ids are
made without it (`member` true), provenance keeps it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import ids
from codeloom.functions import text as X
from codeloom.operators.revisions import first_by

OPS = ("op_type", "id", "kind", "name", "src", "dst", "predicate", "field", "value")
#: Extensions of configuration and of documents.
CONFIG_ENDS = (".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".env")
DOC_ENDS = (".md", ".mdx", ".rst", ".txt")
#: Predicates of edges that only chunks have.
CHUNK_EDGES = ("CONTAINS_CHUNK", "NEXT")


def source_type(path: Column) -> Column:
    """config, doc or code, by the name of a file."""
    name, ext = F.lower(X.basename(path)), X.extname(path)
    return F.when((name == "dockerfile") | F.endswith(name, F.lit(".dockerfile")) | ext.isin(*CONFIG_ENDS), "config").when(ext.isin(*DOC_ENDS), "doc").otherwise("code")


def id_path(path: Column, member: bool = False) -> Column:
    """The path that ids are made from: without the member repository's directory, if the path begins with one."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.contains(norm, F.lit("/")), F.regexp_replace(norm, "^[^/]*/", "")).otherwise(norm) if member else path


def resolve_key(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """asked(path, name, container, ..) with key: the only qualified key of the name, else the container's own, else the plain name."""
    keys = entities.select("path", "name", ids.qualified_key(F.col("container"), F.col("name")).alias("qkey")).groupBy("path", "name").agg(F.collect_set("qkey").alias("_keys"))
    qualified = F.concat("container", F.lit("."), "name")
    key = F.when(F.size("_keys") == 1, F.get("_keys", F.lit(0))).when(F.array_contains("_keys", qualified), qualified).otherwise(F.col("name"))
    return asked.join(keys, ["path", "name"], "left").withColumn("key", key).drop("_keys")


def _row(op: str, **values: Column) -> list[Column]:
    none = F.lit(None).cast("string")
    return [F.lit(op).alias("op_type"), *(values.get(c, none).cast("string").alias(c) for c in OPS[1:])]


def build_patch(files: DataFrame, entities: DataFrame, relationships: DataFrame, chunks: DataFrame, resolved: DataFrame | None = None, member: bool = False) -> DataFrame:
    """(path, op_seq, ..OPS) of each file: nodes, chunks with their edges, relationships, claims, in this order.

    resolved(path, src, predicate, dst, variant, to_ws, to_path, to_key) points
    relationships at definitions in other files.  The first entity of a node's id
    and the first relationship of an edge's ends count, once a file; a call of
    pkg::name that the file does not define makes an external node.
    """
    place = files.select("ws", "path")
    ws, at = F.col("ws"), id_path(F.col("path"), member)
    key = ids.qualified_key(F.col("container"), F.col("name"))
    named = entities.join(place, "path").withColumn("id", ids.node_id(ws, at, key))
    nodes = first_by(named.select("path", "id", "seq", "name", "kind"), ["path", "id"], "seq").select("path", F.lit(1).alias("rank"), "seq", F.lit(0).alias("sub"), *_row("UpsertNode", id=F.col("id"), kind=F.col("kind"), name=F.col("name")))
    file = named.where("kind = 'file'").groupBy("path").agg(F.min_by("id", "seq").alias("file_id"))
    piece = chunks.join(place, "path").join(file, "path", "left").withColumn("id", ids.chunk_id(ws, at, F.col("kind"), F.col("name"), F.col("line_start")))
    piece = piece.withColumn("file_id", F.coalesce("file_id", ids.node_id(ws, at, at)))
    said = F.coalesce("name", F.concat(F.lit("file_body:"), F.col("line_start").cast("string")))
    chunk = piece.select("path", F.lit(2).alias("rank"), "seq", F.lit(0).alias("sub"), *_row("UpsertNode", id=F.col("id"), kind=F.when(F.col("kind") == "section", "section").otherwise("chunk"), name=said))
    held = piece.select("path", F.lit(2).alias("rank"), "seq", F.lit(1).alias("sub"), *_row("UpsertEdge", id=ids.edge_id(ws, at, F.col("file_id"), F.col("id"), F.lit("CONTAINS_CHUNK")), src=F.col("file_id"), dst=F.col("id"), predicate=F.lit("CONTAINS_CHUNK")))
    symbol = ids.node_id(ws, at, key)
    defines = piece.where("name is not null").select("path", F.lit(2).alias("rank"), "seq", F.lit(2).alias("sub"), *_row("UpsertEdge", id=ids.edge_id(ws, at, F.col("id"), symbol, F.lit("DEFINES")), src=F.col("id"), dst=symbol, predicate=F.lit("DEFINES")))
    w = Window.partitionBy("path").orderBy("seq")
    after = piece.withColumn("next", F.lead("id").over(w)).withColumn("next_container", F.lead("container").over(w)).where("next is not null and container is null and next_container is null")
    following = after.select("path", F.lit(3).alias("rank"), "seq", F.lit(0).alias("sub"), *_row("UpsertEdge", id=ids.edge_id(ws, at, F.col("id"), F.col("next"), F.lit("NEXT")), src=F.col("id"), dst=F.col("next"), predicate=F.lit("NEXT")))
    rel = relationships if "variant" in relationships.columns else relationships.withColumn("variant", F.lit(None).cast("string"))
    rel = resolve_key(rel.withColumn("name", F.col("src")).withColumn("container", F.lit(None).cast("string")), entities).withColumnRenamed("key", "src_key")
    rel = resolve_key(rel.withColumn("name", F.col("dst")).withColumn("container", F.when(F.col("predicate") == "CONTAINS", F.col("src"))), entities).withColumnRenamed("key", "dst_key").drop("name", "container")
    own = entities.select("path", ids.qualified_key(F.col("container"), F.col("name")).alias("dst_key"), F.lit(True).alias("own")).distinct()
    rel = rel.join(place, "path").join(own, ["path", "dst_key"], "left")
    shapes = relationships.groupBy("path", "src", "predicate", "dst").agg(F.count(F.lit(1)).alias("shapes"))
    rel = rel.join(shapes, ["path", "src", "predicate", "dst"])
    outside = (F.col("predicate") == "CALLS") & F.contains("dst_key", F.lit("::")) & F.col("own").isNull()
    package = F.substring_index("dst_key", "::", 1)
    external = ids.node_id(ws, F.concat(F.lit("external://"), package), F.col("dst_key"))
    target = F.when(outside, external).otherwise(ids.node_id(ws, at, F.col("dst_key")))
    if resolved is not None:
        to = resolved if "variant" in resolved.columns else resolved.withColumn("variant", F.lit(None).cast("string"))
        ends = ["path", "src", "predicate", "dst"]
        exact = to.where("variant is not null").select(*ends, "variant", F.struct("to_ws", "to_path", "to_key").alias("exact"))
        plain = to.where("variant is null").select(*ends, F.struct("to_ws", "to_path", "to_key").alias("plain"))
        rel = rel.join(exact.dropDuplicates([*ends, "variant"]), [*ends, "variant"], "left").join(plain.dropDuplicates(ends), ends, "left").withColumn("to", F.coalesce("exact", "plain")).drop("exact", "plain")
        target = F.when(F.col("to").isNotNull(), ids.node_id(F.coalesce("to.to_ws", ws), id_path(F.col("to.to_path"), member), F.col("to.to_key"))).otherwise(target)
        outside = outside & F.col("to").isNull()
    rel = rel.withColumn("src_id", ids.node_id(ws, at, F.col("src_key"))).withColumn("dst_id", target).withColumn("outside", outside)
    alien = first_by(rel.where("outside").select("path", F.col("dst_id").alias("id"), "seq", F.substring_index("dst_key", "::", -1).alias("name")), ["path", "id"], "seq")
    alien = alien.select("path", F.lit(4).alias("rank"), "seq", F.lit(0).alias("sub"), *_row("UpsertNode", id=F.col("id"), kind=F.lit("function"), name=F.col("name"), field=F.lit("external"), value=F.lit("true")))
    edge_key = F.when(F.col("variant").isNotNull() & (F.col("shapes") > 1), F.concat("dst_key", F.lit(":"), "variant")).otherwise(F.col("dst_key"))
    edge = rel.select("path", "seq", "src_id", "dst_id", "predicate", ids.edge_id(ws, at, F.col("src_key"), edge_key, F.col("predicate")).alias("id"))
    edge = first_by(edge, ["path", "src_id", "dst_id", "predicate"], "seq")
    edge = edge.select("path", F.lit(4).alias("rank"), "seq", F.lit(1).alias("sub"), *_row("UpsertEdge", id=F.col("id"), src=F.col("src_id"), dst=F.col("dst_id"), predicate=F.col("predicate")))
    claim = rel.select("path", "seq", F.col("src_id").alias("id"), F.concat(F.lower("predicate"), F.lit(":"), "dst").alias("field"), F.col("dst").alias("value"))
    claim = first_by(claim, ["path", "id", "field"], "seq")
    claim = claim.select("path", F.lit(5).alias("rank"), "seq", F.lit(0).alias("sub"), *_row("AssertClaim", id=F.col("id"), field=F.col("field"), value=F.col("value")))
    out = nodes
    for more in (chunk, held, defines, following, alien, edge, claim):
        out = out.unionByName(more)
    return out.withColumn("op_seq", F.row_number().over(Window.partitionBy("path").orderBy("rank", "seq", "sub", "id")).cast("long")).select("path", "op_seq", *OPS)


def dedupe_edges(ops: DataFrame) -> DataFrame:
    """ops(path, op_seq, .., id, src, dst, predicate, attrs) of edges, once an id: the first's place, the last's attributes.

    Different ends under one id are a fault of identity and stop the query.
    """
    same = (F.min("src") == F.max("src")) & (F.min("dst") == F.max("dst")) & (F.min("predicate") == F.max("predicate"))
    once = ops.groupBy("path", "id").agg(F.min("op_seq").alias("op_seq"), F.max_by("attrs", "op_seq").alias("attrs"), F.min("src").alias("src"), F.min("dst").alias("dst"), F.min("predicate").alias("predicate"), same.alias("_same"))
    fault = F.raise_error(F.concat(F.lit("one edge id with different ends: "), "id")).cast("string")
    return once.withColumn("id", F.when(F.col("_same"), F.col("id")).otherwise(fault)).drop("_same")


def headers(files: DataFrame, extractor: str, before: list[str], actor: str = "ingestion") -> DataFrame:
    """(path, patch_id, actor, source_type, replaces, intent) of files(ws, path, source_hash, previous_hash).

    A patch replaces that of the previous content, or without one the id of old
    kind, and those of the same content by extractors before this one.
    """
    ws, path, now = F.col("ws"), F.col("path"), F.col("source_hash")
    of = lambda h, e: ids.patch_id(ws, path, h, F.lit(e))
    previous = F.when(F.col("previous_hash").isNotNull(), of(F.col("previous_hash"), extractor)).otherwise(ids.legacy_patch_id(ws, path, now))
    return files.select("path", of(now, extractor).alias("patch_id"), F.lit(actor).alias("actor"), source_type(path).alias("source_type"), F.array(previous, *[of(now, e) for e in before]).alias("replaces"), F.concat(F.lit("Parsed "), X.basename(path)).alias("intent"))


def patch_candidates(ws: Column, path: Column, hash_: Column, extractor: str, before: list[str]) -> Column:
    """Ids of patches that may own what stands for a stored content: by each extractor, newest first, then the id of old kind."""
    return F.array(*[ids.patch_id(ws, path, hash_, F.lit(e)) for e in (extractor, *before)], ids.legacy_patch_id(ws, path, hash_))


def deletion_patches(deleted: DataFrame, extractor: str, before: list[str]) -> DataFrame:
    """(path, patch_id, source_hash, source_type, replaces, intent) that retire what deleted(ws, path, previous_hash, token) files had."""
    ws, path = F.col("ws"), F.col("path")
    hash_ = F.sha2(F.concat(F.lit("deleted:"), "previous_hash", F.lit(":"), "token"), 256)
    rows = deleted.withColumn("source_hash", hash_)
    return rows.select("path", ids.patch_id(ws, path, F.col("source_hash"), F.lit(extractor)).alias("patch_id"), "source_hash", source_type(path).alias("source_type"), patch_candidates(ws, path, F.col("previous_hash"), extractor, before).alias("replaces"), F.concat(F.lit("Deleted "), X.basename(path)).alias("intent"))


def reconciled(current: DataFrame, previous: DataFrame, edges: DataFrame, map_mode: bool = False) -> tuple[DataFrame, DataFrame]:
    """(operations, dependents): current(path, op_seq, ..OPS) with the retirement of what previous(path, id, kind) had, in the order of application.

    Nodes that are gone take their incident edges(edge_id, src, dst, predicate,
    path) along, unless the patch writes them anew; files whose edges these were
    are dependents(path, dependent).  In map mode chunks are not written, so they
    and their edges are left alone.
    """
    now = current.where("op_type = 'UpsertNode'").select("path", "id").distinct()
    gone = previous.join(now, ["path", "id"], "left_anti")
    if map_mode:
        gone = gone.where("kind <> 'chunk'")
    gone = gone.select("path", "id").distinct()
    ends = edges.select("edge_id", "predicate", F.col("path").alias("dependent"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).join(gone, "id")
    kept = current.where("op_type = 'UpsertEdge'").select("path", F.col("id").alias("edge_id")).distinct()
    cut = ends.join(kept, ["path", "edge_id"], "left_anti")
    if map_mode:
        cut = cut.where(~F.col("predicate").isin(*CHUNK_EDGES))
    none = lambda op, rows: rows.select("path", F.lit(0).cast("long").alias("op_seq"), *_row(op, id=F.col("id")))
    every = current.select("path", "op_seq", *OPS).unionByName(none("DeleteNode", gone)).unionByName(none("DeleteEdge", cut.select("path", F.col("edge_id").alias("id")).distinct()))
    return ordered(every), ends.where("dependent <> path").select("path", "dependent").distinct()


def ordered(ops: DataFrame) -> DataFrame:
    """ops with op_seq in the order of application: deleted nodes, nodes, deleted edges, edges, others."""
    rank = F.when(F.col("op_type") == "DeleteNode", 0).when(F.col("op_type") == "UpsertNode", 1).when(F.col("op_type") == "DeleteEdge", 2).when(F.col("op_type") == "UpsertEdge", 3).otherwise(4)
    return ops.withColumn("op_seq", F.row_number().over(Window.partitionBy("path").orderBy(rank, "op_seq", "id", "field")).cast("long"))


def without_chunks(ops: DataFrame) -> DataFrame:
    """ops less chunk nodes and the edges that only chunks have."""
    node = (F.col("op_type") == "UpsertNode") & (F.coalesce("kind", F.lit("")) == "chunk")
    edge = (F.col("op_type") == "UpsertEdge") & F.coalesce("predicate", F.lit("")).isin(*CHUNK_EDGES)
    return ops.where(~node & ~edge)


def for_map(ops: DataFrame) -> DataFrame:
    """ops that a map needs: no chunks and no claims."""
    return without_chunks(ops).where("op_type not in ('AssertClaim', 'RetractClaim')")


def needs_own_commit(ops: DataFrame) -> DataFrame:
    """(path): files whose patch deletes something and is committed on its own."""
    return ops.where("op_type in ('DeleteNode', 'DeleteEdge')").select("path").distinct()


def bulk(ops: DataFrame, size: int = 1000) -> DataFrame:
    """(path, batch): files without deletions in batches of `size` for one commit each, the others in batches of one; numbered by path."""
    alone = needs_own_commit(ops).withColumn("alone", F.lit(1))
    paths = ops.select("path").distinct().join(alone, "path", "left")
    from codeloom.operators.revisions import numbered

    together = numbered(paths.where("alone is null").select("path"), "path", "n").select("path", F.floor((F.col("n") - 1) / size).alias("batch"), F.lit("bulk").alias("how"))
    return together.unionByName(numbered(paths.where("alone = 1").select("path"), "path", "n").select("path", (F.col("n") - 1).alias("batch"), F.lit("single").alias("how")))


def with_retry(call: Callable[[], object], retries: int = 6, wait: Callable[[int], None] | None = None, transient: tuple[type[Exception], ...] = (Exception,)) -> object:
    """The result of call, tried again up to `retries` times after a transient failure, with growing waits."""
    import time

    for attempt in range(retries + 1):
        try:
            return call()
        except transient:
            if attempt == retries:
                raise
            (wait or (lambda k: time.sleep(min(30.0, 0.5 * 2**k))))(attempt)
    return None


def commit_batches(log: DataFrame, batches: list[DataFrame], commit: Callable[[DataFrame, DataFrame], tuple[str, DataFrame]], singly: Callable[[DataFrame], list[DataFrame]]) -> tuple[list[str], DataFrame]:
    """Commits batches one after the other; a batch that fails is committed patch by patch, so one bad patch costs itself only."""
    said = []
    for batch in batches:
        try:
            status, log = commit(log, batch)
            said.append(status)
        except Exception:  # noqa: BLE001  what is wrong shows when the patches are tried on their own
            for one in singly(batch):
                try:
                    status, log = commit(log, one)
                except Exception as e:  # noqa: BLE001
                    status = f"Failed: {type(e).__name__}"
                said.append(status)
    return said, log


def is_rev(rev: Column) -> Column:
    """Whether a number is a revision: whole and not negative."""
    return F.coalesce((rev >= 0) & (rev == F.floor(rev)), F.lit(False))


def advance(revs: DataFrame) -> DataFrame:
    """(rev): the greatest valid revision of revs(rev), 0 if there is none; it never goes back."""
    return revs.agg(F.coalesce(F.max(F.when(is_rev(F.col("rev")), F.col("rev"))), F.lit(0)).cast("long").alias("rev"))


def patches(log: DataFrame, limit: int | None = None, patch_id: str | None = None) -> DataFrame:
    """log(patch_id, rev, ..), newest first; up to a limit, or one patch."""
    rows = log if patch_id is None else log.where(F.col("patch_id") == patch_id)
    rows = rows.orderBy(F.desc("rev"), "patch_id")
    return rows if limit is None else rows.limit(limit)


def provenance(ops: DataFrame, log: DataFrame, entity: str | None = None) -> DataFrame:
    """(id, patch_id, rev) of patches that touched an entity, as a node, an end of an edge or a claim's subject: ops(patch_id, id, src, dst)."""
    touched = ops.select("patch_id", F.explode(F.array_distinct(F.filter(F.array("id", "src", "dst"), lambda x: x.isNotNull()))).alias("id")).distinct()
    rows = touched if entity is None else touched.where(F.col("id") == entity)
    return rows.join(log.select("patch_id", "rev"), "patch_id")


#: Kinds and predicates that people write; a reset of code keeps them.
PLANNING = ("intent", "decision", "task", "bug", "goal", "plan")


def reset(nodes: DataFrame, edges: DataFrame, what: str = "code", workspace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a reset of nodes(id, kind, ws) and edges(src, dst): all, code (what people wrote stays), or of one workspace."""
    if what not in ("all", "code"):
        raise ValueError("a reset is of all or of code")
    goes = F.lit(True) if what == "all" else ~F.col("kind").isin(*PLANNING)
    if workspace is not None:
        goes = goes & (F.col("ws") == workspace)
    left = nodes.where(~F.coalesce(goes, F.lit(False)))
    keep = left.select("id")
    return left, edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
