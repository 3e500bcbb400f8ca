"""Deterministic ids: UUID-shaped SHA-256, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_form(text: Column) -> Column:
    """h[0:8]-h[8:12]-h[12:16]-h[16:20]-h[20:32] of the SHA-256 hex of text."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def norm_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def namespace(ws: Column) -> Column:
    return F.when(F.coalesce(ws, F.lit("")) != "", F.concat(ws, F.lit(":"))).otherwise(F.lit(""))


def qualified_key(container: Column, name: Column) -> Column:
    return F.when(F.coalesce(container, F.lit("")) != "", F.concat(container, F.lit("."), name)).otherwise(name)


def node_id(ws: Column, path: Column, key: Column) -> Column:
    return uuid_form(F.concat(namespace(ws), norm_path(path), F.lit(":"), key))


def edge_id(ws: Column, path: Column, src: Column, dst: Column, predicate: Column) -> Column:
    return uuid_form(F.concat(namespace(ws), norm_path(path), F.lit(":"), src, F.lit(":"), dst, F.lit(":"), predicate))


def chunk_id(ws: Column, path: Column, kind: Column, name: Column, start_line: Column) -> Column:
    return uuid_form(F.concat(namespace(ws), norm_path(path), F.lit(":chunk:"), kind, F.lit(":"), F.coalesce(name, F.lit("file_body")), F.lit(":"), start_line.cast("string")))


def patch_id(ws: Column, path: Column, source_hash: Column, extractor: Column) -> Column:
    return uuid_form(F.concat(namespace(ws), norm_path(path), F.lit(":"), source_hash, F.lit(":"), extractor))


def legacy_patch_id(ws: Column, path: Column, source_hash: Column) -> Column:
    return uuid_form(F.concat(namespace(ws), path, F.lit(":"), source_hash))


def stable_id(text: Column) -> Column:
    """Workspace and system ids: the first eight hex digits."""
    return F.substring(F.sha2(text, 256), 1, 8)
