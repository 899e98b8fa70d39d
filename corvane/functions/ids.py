"""Identifiers that follow from content alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sha(*parts: Column, sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256)


def block_id(doc: Column, index: Column) -> Column:
    return sha(doc, F.lit("block"), index)


def structured_block_id(doc: Column, index: Column) -> Column:
    return sha(doc, F.lit("structured_block"), index)


def chunk_id(doc: Column, index: Column, body: Column) -> Column:
    return sha(doc, index, F.substring(F.sha2(body, 256), 1, 16))


def incremental_doc_id(key: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha(F.lit("incremental"), key), 1, 24))


def version_id(doc: Column, digest: Column) -> Column:
    return F.concat(F.lit("ver_"), F.substring(sha(doc, digest), 1, 24))


def fallback_record_id(title: Column, file: Column) -> Column:
    return F.concat(F.lit("fallback_"), F.substring(sha(title, file), 1, 16))
