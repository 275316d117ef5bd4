"""Paragraph packing, recursive splitting and chunk records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle import config as C
from brindle.functions import ids, text as T


def pack_paragraphs(text: Column, min_words: int = 30, max_chars: int = 1500) -> Column:
    """Array of chunks: paragraphs gathered until they have min_words words or max_chars characters; a longer paragraph stands alone."""
    paras = F.filter(F.transform(F.split(text, f"(?dU)\\n{T.SPACE}*\\n+"), T.strip), lambda p: p != "")
    # each paragraph is counted once, before the fold
    counted = F.transform(paras, lambda p: F.struct(p.alias("p"), T.word_count(p).alias("w"), F.length(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("buf"), F.lit(0).alias("w"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["buf"] == "", acc["chunks"]).otherwise(F.concat(acc["chunks"], F.array(acc["buf"])))

    def step(acc: Column, para: Column) -> Column:
        def grown(buf: Column) -> Column:
            n = acc["w"] + para["w"]
            full = (n >= min_words) | (F.length(buf) >= max_chars)
            alone = para["n"] > max_chars
            return F.struct(
                F.when(alone, F.concat(flushed(acc), F.array(para["p"]))).when(full, F.concat(acc["chunks"], F.array(buf))).otherwise(acc["chunks"]).alias("chunks"),
                F.when(alone | full, F.lit("")).otherwise(buf).alias("buf"),
                F.when(alone | full, F.lit(0)).otherwise(n).alias("w"),
            )

        return T.let(F.when(acc["buf"] == "", para["p"]).otherwise(F.concat(acc["buf"], F.lit("\n\n"), para["p"])), grown)

    return F.aggregate(counted, start, step, flushed)


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Recursive character splitting: cut at the first separator that occurs, keep it at the head of what follows, merge pieces up to size with an overlap, and split longer pieces by the later separators. A piece that no separator cuts stays whole."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, later = separators[at], separators[at + 1 :]
    first, *rest = text.split(sep)
    pieces = [p for p in [first, *(sep + r for r in rest)] if p]
    out: list[str] = []
    short: list[str] = []

    def merge() -> None:
        held: list[str] = []
        total = 0
        for p in short:
            if held and total + len(p) > size:
                whole = "".join(held).strip()
                if whole:
                    out.append(whole)
                while held and (total > overlap or (total + len(p) > size and total > 0)):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        whole = "".join(held).strip()
        if whole:
            out.append(whole)
        short.clear()

    for p in pieces:
        if len(p) < size:
            short.append(p)
            continue
        merge()
        if later:
            out += split_text(p, size, overlap, later)
        else:
            out.append(p)
    merge()
    return out


def recursive_split(text: Column, conf: C.Chunking = C.Chunking()) -> Column:
    """Array of pieces; Arrow batches, since the merge with overlap depends on every earlier piece."""
    size, overlap, separators = conf.size, conf.overlap, conf.separators

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t, size, overlap, separators) if t else [])

    return run(text)


def recursive_splits(texts: Column, conf: C.Chunking = C.Chunking()) -> Column:
    """recursive_split of each text of an array; null stays null."""
    size, overlap, separators = conf.size, conf.overlap, conf.separators

    @F.pandas_udf("array<array<string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda some: None if some is None else [None if t is None else split_text(t, size, overlap, separators) for t in some])

    return run(texts)


def chunk_texts(elements: DataFrame, conf: C.Chunking = C.Chunking()) -> DataFrame:
    """elements (element_id, type, content, ...): one row per chunk text with its index; captions stay whole, elements without content go."""
    split = F.col("type").isin(*C.SPLIT_TYPES)

    def packed(content: Column) -> Column:
        parts = F.when(split, pack_paragraphs(content, conf.min_paragraph_words, conf.max_paragraph_chars)).otherwise(F.array(content))
        return F.when(content != "", parts)

    # contents are read once, parts are dealt once: a row per part of which none is made twice
    parts = elements.select(*elements.columns, T.let(F.col("content"), packed).alias("packed"))
    # only what is over the size goes through the splitter
    over = lambda p: (F.length(p) > conf.size) & split
    parts = parts.withColumn("cut", recursive_splits(F.transform("packed", lambda p: F.when(over(p), p)), conf))
    at = F.zip_with("packed", "cut", lambda p, c: F.coalesce(c, F.array(p)))
    numbered = parts.select(*elements.columns, F.posexplode(at).alias("part", "pieces"))
    all_ = numbered.select(*elements.columns, "part", F.posexplode("pieces").alias("piece", "chunk_text"))
    order = F.row_number().over(Window.partitionBy("element_id").orderBy("part", "piece")) - 1
    return all_.withColumn("chunk_index", order.cast("int")).drop("part", "piece")


def chunk_records(elements: DataFrame, conf: C.Chunking = C.Chunking(), q: C.Quality = C.Quality(), version: str = "1") -> DataFrame:
    """Scored, gated and identified chunks. Indexes are given before the gate, so refused chunks leave gaps."""
    texts = chunk_texts(elements, conf)
    # scored and gated in one: a filter on the score would score each text again
    gated = F.filter(F.array(T.quality(F.col("chunk_text"), F.col("type"), q=q)), lambda x: x["score"] >= q.min_score)
    scored = texts.select("*", F.explode(gated).alias("q"))
    hashed = scored.withColumn("content_hash", ids.content_hash(F.col("chunk_text")))
    kept = [c for c in elements.columns if c not in ("content", "type", "page_idx", "page_number", "page_label", "section", "linked_asset_id", "element_id")]

    def own(name: str, kind: str) -> Column:
        return (F.col(name) if name in elements.columns else F.lit(None)).cast(kind).alias(name)

    return hashed.select(
        ids.chunk_id(F.col("element_id"), F.col("chunk_index"), F.col("content_hash")).alias("chunk_id"),
        "chunk_index",
        "element_id",
        *kept,
        "type",
        F.col("chunk_text").alias("content"),
        "content_hash",
        F.struct(own("page_idx", "int"), own("page_number", "int"), own("page_label", "string"), own("section", "string"), own("linked_asset_id", "string"), F.col("q.score").alias("quality_score"), F.col("q.reasons").alias("quality_reasons")).alias("metadata"),
        F.struct(F.lit(version).alias("pipeline_v")).alias("provenance"),
    )
