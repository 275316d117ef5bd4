"""Identities of documents, elements, chunks and assets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import normalize

#: Namespace of URL-based name UUIDs (RFC 4122), as hexadecimal digits.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def doc_id(content: Column) -> Column:
    """Of a file's bytes."""
    return F.md5(content)


def element_id(doc: Column, page_idx: Column, seq: Column, kind: Column) -> Column:
    return F.format_string("%s_p%d_%02d_%s", doc, page_idx, seq, kind)


def chunk_id(element: Column, index: Column, hash_: Column) -> Column:
    return F.md5(F.concat_ws("_", element, index.cast("string"), hash_))


def asset_id(element: Column) -> Column:
    return F.concat(F.lit("asset_"), F.substring(F.md5(element), 1, 12))


def point_id(name: Column) -> Column:
    """Name-based UUID (version 5) of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
