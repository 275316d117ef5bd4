"""Index tables: points, upserts, pruning, validation. A table is rewritten as a new version and swapped by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def points(chunks: DataFrame) -> DataFrame:
    """chunks with metadata struct: flat payload columns beside the nested ones, vectors cast."""
    out = chunks.withColumns({c: F.col(f"metadata.{c}") for c in ("page_label", "page_number", "section", "linked_asset_id")}).withColumn("id", F.col("chunk_id").cast("string"))
    if "dense" in chunks.columns:
        out = out.withColumn("dense", F.transform("dense", lambda x: x.cast("float")))
    return out


def choose_sparse(own, fallback):
    """The stored sparse vector, unless both of its arrays are empty or missing."""
    missing = (F.coalesce(F.size(own["indices"]), F.lit(0)) <= 0) & (F.coalesce(F.size(own["values"]), F.lit(0)) <= 0)
    return F.when(missing, fallback).otherwise(own)


def last_by_key(new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by order; without an order, and among equals, the one whose content hashes highest, so that any plan picks the same."""
    content = F.xxhash64(F.to_json(F.struct(*[c for c in new.columns if c not in keys]))) if set(new.columns) - set(keys) else F.lit(0)
    w = Window.partitionBy(*keys).orderBy(*([F.desc(order)] if order else []), F.desc(content))
    return new.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace those with equal keys; of new rows that share keys one counts (see last_by_key)."""
    fresh = last_by_key(new, keys, order)
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_counts(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: upserted (distinct new keys), inserted, replaced."""
    known = new.select(*keys).distinct().join(current.select(*keys).distinct().withColumn("was", F.lit(1)), keys, "left")
    return known.agg(F.count("*").alias("upserted"), F.count_if(F.col("was").isNull()).alias("inserted"), F.count("was").alias("replaced"))


def prune_counts(existing: DataFrame, chunks: DataFrame, full_sync: bool = False) -> DataFrame:
    """One row: removed, the rows that prune takes away."""
    return stale(existing, chunks, full_sync).agg(F.count("*").alias("removed"))


def delete(current: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(ids.select(*keys), keys, "left_anti")


def desired(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("chunk_id", F.lit("")) != "")).select("doc_id", "chunk_id").distinct()


def stale(existing: DataFrame, chunks: DataFrame, full_sync: bool = False) -> DataFrame:
    """doc_id, chunk_id of indexed rows that the chunks no longer hold; of documents without any chunk only with full_sync."""
    want = desired(chunks)
    scope = existing.select("doc_id", "chunk_id")
    if not full_sync:
        scope = scope.join(want.select("doc_id").distinct(), "doc_id", "left_semi")
    return scope.join(want, ["doc_id", "chunk_id"], "left_anti")


def prune(existing: DataFrame, chunks: DataFrame, full_sync: bool = False) -> DataFrame:
    return existing.join(stale(existing, chunks, full_sync), ["doc_id", "chunk_id"], "left_anti")


def validate(existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """indexed, wanted, missing: distinct ids on both sides and those not indexed yet."""
    a, b = existing.select("chunk_id").distinct(), desired(chunks).select("chunk_id").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "chunk_id", "full")
    return both.agg(F.count("a").alias("indexed"), F.count("b").alias("wanted"), F.count_if(F.col("a").isNull()).alias("missing"))


def not_ingested(docs: DataFrame, registry: DataFrame, reingest: bool = False) -> DataFrame:
    """Documents whose id isn't registered; of several files with one id the first by path."""
    w = Window.partitionBy("doc_id").orderBy("path")
    once = docs.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return once if reingest else once.join(registry.select("doc_id").distinct(), "doc_id", "left_anti")


def registry_from_chunks(chunks: DataFrame) -> DataFrame:
    """The first-seen record of each document, in order of pos: for a registry that was lost."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return chunks.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("doc_id", "doc_slug", "title", "source_uri")


def merge_maps(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both; the new value wins."""
    o, n = old.select(key, F.col(value).alias("o")), new.select(key, F.col(value).alias("n"), F.lit(True).alias("is_new"))
    return o.join(n, key, "full").select(key, F.when(F.col("is_new"), F.col("n")).otherwise(F.col("o")).alias(value))


def element_chunks(chunks: DataFrame) -> DataFrame:
    """element_id, chunk_ids in order of chunk_index."""
    pairs = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id")))
    return chunks.groupBy("element_id").agg(F.transform(pairs, lambda s: s["chunk_id"]).alias("chunk_ids"))


def page_assets(assets: DataFrame) -> DataFrame:
    """page_key, asset_ids in order of pos."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "asset_id")))
    return assets.groupBy(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("page_label")).alias("page_key")).agg(F.transform(pairs, lambda s: s["asset_id"]).alias("asset_ids"))


def chunk_elements(element_map: DataFrame) -> DataFrame:
    """element_map (pos, element_id, chunk_ids): chunk_id to element_id, the first by pos and place."""
    rows = element_map.where(F.coalesce("element_id", F.lit("")) != "").select("pos", "element_id", F.posexplode("chunk_ids").alias("at", "chunk_id")).where(F.coalesce("chunk_id", F.lit("")) != "")
    w = Window.partitionBy("chunk_id").orderBy("pos", "at")
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("chunk_id", "element_id")


def dimension(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """dim: the length of the first vector that isn't empty, by id."""
    return vectors.where(F.coalesce(F.size(col), F.lit(0)) > 0).agg(F.min(F.struct("id", F.size(col).alias("d"))).alias("f")).select(F.col("f.d").alias("dim"))


def meta(docs: DataFrame, key: str):
    """A payload value: the flat column where the table has it, even if it is null there, else the field of metadata, else null."""
    if key in docs.columns:
        return docs[key]
    nested = docs.schema["metadata"].dataType if "metadata" in docs.columns else None
    return docs["metadata"][key] if nested is not None and key in nested.fieldNames() else F.lit(None).cast("string")
