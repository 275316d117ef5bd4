"""Whole runs: ingest a folder, index its chunks, index its assets, evaluate a gold set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import config as C, providers
from brindle.functions import ids, text as T
from brindle.operators import assets, chunking, dense_index, evaluate, index, layout, report, retrieve, sparse_index
from brindle.sources import readers, runs, sinks
from brindle.sources.store import Store


def elements_of(items: DataFrame, gap: float = 32.0) -> DataFrame:
    """Elements ready for chunking: searchable type, normalised content (tables on one line), page fields, and the asset of tables and images."""
    e = layout.paragraphs(items, gap)
    kind = F.when(F.col("type") == "table", "table_md").when(F.col("type") == "image", "image_caption").otherwise("text")
    content = F.when(F.col("type") == "table", T.normalize(F.col("content"))).when(F.col("type") == "image", F.col("content")).otherwise(T.normalize_paragraphs(F.col("content")))
    linked = F.when(F.col("type").isin("table", "image"), ids.asset_id(F.col("element_id")))
    return e.select("doc_id", "element_id", kind.alias("type"), content.alias("content"), (F.col("page_no") - 1).alias("page_idx"), F.col("page_no").alias("page_number"), F.col("page_no").cast("string").alias("page_label"), F.col("subtype").alias("section"), linked.alias("linked_asset_id"), "bbox", F.col("type").alias("kind"), "seq")


def manifest_of(elements: DataFrame, root: str = "assets") -> DataFrame:
    """The manifest rows of tables and images."""
    some = elements.where(F.col("linked_asset_id").isNotNull())
    suffix = F.when(F.col("kind") == "table", ".html").otherwise(".png")
    return some.select(F.col("linked_asset_id").alias("asset_id"), "element_id", "doc_id", F.concat("kind", F.lit("_asset")).alias("type"), "page_label", F.concat(F.lit(f"{root}/"), F.col("linked_asset_id"), suffix).alias("file_path"), "bbox", F.struct("page_number", "seq").alias("pos"))


def ingest(spark: SparkSession, raw: str, out: str, parser: Callable, settings: C.Settings = C.Settings(), pattern: str = "*.pdf", reset: bool = False, reingest: bool = False, tags: list[str] | None = None) -> DataFrame:
    """Files to chunks, manifest, maps and registry, tables of the store at out; returns the one-row run report.

    Known documents are skipped before they are parsed. Only documents that were parsed are registered; a
    file that fails is a row of the table failures (path, doc_id, error, tries, run_id) and is offered again
    by the next run. All tables change in one commit. The report at out/report also holds the run's id, and
    how many documents, elements and chunks were written and files failed, as counted while they were written.
    """
    store, run = Store(spark, out), runs.run_id()
    files, place = readers.located_files(spark, raw, pattern)
    held = (lambda name: None) if reset else store.read
    known, failed = held("documents"), held("failures")
    fresh = index.not_ingested(files, known if known is not None else files.limit(0), reingest)
    with store.commit() as c:
        if reset:
            c.state["tables"].clear()
        # parsing is the dear part: its rows are written once and everything else reads them
        c.replace("parsed", readers.parse_files(fresh, parser, place))
        tried = c.written("parsed")
        n = {"elements": c.replace("elements", elements_of(readers.items_of(tried), settings.paragraph_gap))}
        elements = c.written("elements")
        errors = readers.failures_of(tried)
        times = files.select("path", "doc_slug", "title", "created_at")
        named = tried.select("path", "doc_id").distinct().join(errors.select("path"), "path", "left_anti").join(times, "path")
        facts = [F.array([F.lit(t) for t in tags or []]).cast("array<string>").alias("tags"), F.lit(run).alias("run_id"), F.lit(runs.now_iso()).alias("ingested_at")]
        n["documents"] = c.upsert("documents", named.select("doc_id", "doc_slug", "title", F.col("path").alias("source_uri"), "created_at", *facts), ["doc_id"], by="doc_id")
        docs = c.written("documents").drop("run_id", "ingested_at")
        before = errors.withColumn("tries", F.lit(0)) if failed is None else errors.join(failed.select("path", "tries"), "path", "left")
        n["failed"] = c.upsert("failures", before.select("path", "doc_id", "error", (F.coalesce("tries", F.lit(0)) + 1).alias("tries"), F.lit(run).alias("run_id")), ["path"])
        if failed is not None:
            c.delete("failures", named)
        rows = chunking.chunk_records(elements.drop("bbox", "kind", "seq").join(docs, "doc_id"), settings.chunking, settings.quality)
        n["chunks"] = c.upsert("chunks", rows, ["chunk_id"], by="doc_id")
        manifest = manifest_of(elements)
        n["assets"] = c.upsert("assets", manifest.withColumn("pos", F.col("pos.page_number").cast("long") * 2**32 + F.col("pos.seq")), ["asset_id"], by="doc_id")
        c.upsert("element_to_chunks", index.element_chunks(c.written("chunks")), ["element_id"])
        c.upsert("page_to_assets", index.page_assets(c.written("assets")), ["page_key"])
    tables = elements.where("kind = 'table'").select(F.col("linked_asset_id").alias("asset_id"), F.concat(F.lit("assets/"), "linked_asset_id", F.lit(".html")).alias("file_path"), T.wrap_table(F.col("content")).cast("binary").alias("blob"))
    sinks.save_blobs(tables, out if "://" in out else f"file://{out}")
    chunks = store.read("chunks")
    stats = report.summary(chunks.select("doc_id", F.col("metadata.quality_score").alias("score"), F.col("metadata.page_number").alias("page_number")), store.read("assets"), settings.quality.min_score)
    counted = stats.withColumn("written", F.struct(*[F.lit(v).alias(k) for k, v in n.items()]))
    sinks.report(counted, f"{out}/report", run_id=run)
    return stats


def build_index(spark: SparkSession, chunks: DataFrame, root: str, encode: Callable = providers.hashed_embedding, prune: bool = True, sparse: Callable = providers.sparse_encode, dense_lists: int = dense_index.LISTS) -> DataFrame:
    """Points with dense and sparse vectors, upserted by chunk_id and pruned, and the two indexes over them, changed in one commit; returns the validation row.

    What a run writes follows the chunks that it is given. The report at root/report holds the run's id,
    the validation, and how many points were upserted and removed, as counted while they were written.
    """
    store, run = Store(spark, root), runs.run_id()
    with store.commit() as c:
        wanted = chunks.select("doc_id").distinct()
        n = {"upserted": c.upsert("points", index.points(chunks.withColumn("dense", encode(F.col("content"))).withColumn("sparse", sparse(F.col("content")))), ["chunk_id"], by="doc_id"), "removed": 0}
        points = c.written("points")
        now = store.read("points", wanted)
        stale = index.stale(now, chunks) if prune and now is not None else None
        if stale is not None:
            n["removed"] = c.delete("points", stale)
        ids = F.col("chunk_id").alias("id")
        sparse_index.add(store, c, points.select(ids, F.col("sparse.indices").alias("terms"), F.col("sparse.values").alias("values")))
        dense_index.add(store, c, points.select(ids, F.col("dense").alias("vec"), "doc_id", "type"), dense_lists)
        if n["removed"]:
            sparse_index.remove(store, c, stale.select(ids))
            dense_index.remove(store, c, stale.select(ids))
    checked = index.validate(store.read("points"), chunks)
    sinks.report(spark.createDataFrame([tuple(n.values())], ", ".join(f"{k} long" for k in n)), f"{root}/report", checked, run)
    return checked


def _sparse_weights(queries: DataFrame, encode: Callable) -> DataFrame:
    """queries (qid, text): qid, term, w."""
    return retrieve.sparse_postings(queries.select("qid", encode(F.col("text")).alias("sparse")), "qid").select(F.col("id").alias("qid"), "term", F.col("value").alias("w"))


def search(spark: SparkSession, root: str, queries: DataFrame, encode: Callable = providers.hashed_embedding, conf: C.Retrieval = C.Retrieval(), sparse: Callable = providers.sparse_encode, probes: int = dense_index.PROBES, docs: DataFrame | None = None) -> DataFrame:
    """queries (qid, query): the reranked chunks of each, with payload columns. Both branches read their stored index; the texts that are read are those of the fused rows.

    docs (doc_id) restricts the search to some documents: their vectors alone are looked at, and of the
    points only their buckets are opened.
    """
    store = Store(spark, root)
    q = queries.select("qid", F.col("query").alias("text"))
    points = store.read("points", docs)
    if docs is None:
        near = dense_index.search(store, q.select("qid", encode(F.col("text")).alias("vec")), conf.top_k, probes)
        shared = sparse_index.top_k(store, _sparse_weights(q, sparse), conf.top_k, scope=True)
    else:
        some = points.select(F.col("chunk_id").alias("id"), F.col("dense").alias("vec"), "sparse")
        near = retrieve.dense_top_k(some, q.select("qid", encode(F.col("text")).alias("vec")), conf.top_k)
        shared = retrieve.sparse_vector_top_k(some, q.select("qid", sparse(F.col("text")).alias("sparse")), conf.top_k)
    fused = retrieve.fuse(near, shared, conf.rrf_k, conf.top_k)
    found = fused.join(points.drop("id"), fused["id"] == points["chunk_id"]).join(queries.select("qid", "query"), "qid")
    return retrieve.rerank(found, conf.rerank_n, providers.rerank_score(F.col("query"), F.col("content")))


def smoke(spark: SparkSession, root: str, text: str = "figure", limit: int = 5, encode: Callable = providers.hashed_embedding) -> DataFrame:
    """After indexing: one row per branch (dense, sparse) with the rows that a search of the stored indexes for a text finds, limit at most; ok is false for an index that answers nothing. A table of points without indexes is searched as it is."""
    store = Store(spark, root)
    q = spark.createDataFrame([(0, text)], "qid int, text string")
    vector = q.select("qid", encode(F.col("text")).alias("vec"))
    if "postings" in store.tables():
        dense = dense_index.search(store, vector, limit)
        sparse = sparse_index.top_k(store, _sparse_weights(q, providers.sparse_encode), limit, scope=True)
    else:
        points = sinks.current(spark, root)
        dense = retrieve.dense_top_k(points.select(F.col("chunk_id").alias("id"), F.col("dense").alias("vec")), vector, limit)
        corpus = points.select(F.col("chunk_id").alias("id"), providers.sparse_encode(F.col("content")).alias("sparse"))
        sparse = retrieve.sparse_vector_top_k(corpus, q.select("qid", providers.sparse_encode(F.col("text")).alias("sparse")), limit)
    counts = [df.agg(F.lit(name).alias("branch"), F.count("*").alias("n")) for name, df in (("dense", dense), ("sparse", sparse))]
    return counts[0].unionByName(counts[1]).withColumn("ok", F.col("n") > 0)


def index_assets(spark: SparkSession, manifest: DataFrame, docs: DataFrame, chunks: DataFrame, root: str, recreate: bool = False) -> int:
    """Asset points, upserted by point_id; returns how many the index holds."""
    points, store = assets.asset_points(manifest, docs, chunks), Store(spark, root)
    with store.commit() as c:
        if recreate:
            c.state["tables"].clear()
        c.upsert("points", points, ["point_id"])
    return store.read("points").count()


def maintain(spark: SparkSession, root: str, share: float = 0.2, keep: int = 2, hours: float = 24.0) -> dict:
    """Fold the changes of a store's tables where they are more than a share of the rows, rebuild a sparse index of which more than that share is dead, and delete old versions."""
    store = Store(spark, root)
    return {"rebuilt": sparse_index.rebuild(store, share), "compacted": store.compact(share=share), "deleted": store.expire(keep, hours)}


def evaluate_run(gold: DataFrame, retrieved: DataFrame, k_values: list[int], elements: DataFrame | None = None) -> DataFrame:
    """gold as read, retrieved (qid, rank, chunk_id): strict metrics per k, and relaxed ones where elements (chunk_id, element_id) are given."""
    got = retrieved.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("retrieved"))
    r = gold.select(F.col("id").alias("qid"), F.col("expected_retrieval.text_chunk_ids").alias("expected")).join(got, "qid", "left")
    out = evaluate.averages(evaluate.per_query(r, k_values)).withColumn("kind", F.lit("strict"))
    if elements is not None:
        out = out.unionByName(evaluate.averages(evaluate.per_query(evaluate.relax(r, elements), k_values)).withColumn("kind", F.lit("relaxed")))
    return out
