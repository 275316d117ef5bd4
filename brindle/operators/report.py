"""Run statistics: histograms with every bucket, totals, artifact checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle import config as C
from brindle.functions.text import score_bucket


def _filled(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    every = df.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    return every.join(counted, key, "full").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def score_histogram(chunks: DataFrame, score: str = "score") -> DataFrame:
    """bucket, n; empty buckets too."""
    return _filled(chunks.select(score_bucket(F.col(score)).alias("bucket")), "bucket", [*[n for _, n in C.SCORE_BUCKETS], C.LAST_BUCKET])


def type_histogram(chunks: DataFrame) -> DataFrame:
    """type, n; the known types too where there is none."""
    return _filled(chunks.select("type"), "type", list(C.CHUNK_TYPES))


def summary(chunks: DataFrame, assets: DataFrame, low: float = 0.3) -> DataFrame:
    """One row: documents, chunks, mean score, chunks under low, pages (the largest page with a kept chunk of each document, summed), assets."""
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.count_if(F.col("score") < low).alias("l"), F.max("page_number").alias("p"))
    totals = per_doc.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_score"), F.coalesce(F.sum("l"), F.lit(0)).alias("low"), F.coalesce(F.sum("p"), F.lit(0)).alias("max_kept_pages"))
    return totals.join(assets.agg(F.count("*").alias("assets")))


def page_counts(elements: DataFrame, assets: DataFrame) -> DataFrame:
    """Elements by kind and assets, per document and page."""
    e = elements.groupBy("doc_id", "page_no").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("text", "table", "image")], F.count("*").alias("n_elements"))
    a = assets.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_assets"))
    return e.join(a, ["doc_id", "page_no"], "left").withColumn("n_assets", F.coalesce("n_assets", F.lit(0)))


def page_turns(elements: DataFrame) -> DataFrame:
    """Per document, how often the page changes along its elements, the first one counted."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "seq")
    turned = elements.withColumn("turn", F.coalesce(F.col("page_no") != F.lag("page_no").over(w), F.lit(True)))
    return turned.groupBy("doc_id").agg(F.count_if("turn").alias("pages"))


def check_files(artifacts: DataFrame, assets: DataFrame, files: DataFrame, sample: int = 20) -> DataFrame:
    """One row: status FAIL where an artifact is missing, ERROR where the manifest can't be used (an asset among the first without a path), WARN where one of the first assets' files is missing, else PASS.

    artifacts (name, present), assets (pos, file_path), files (file_path).
    """
    first = assets.orderBy("pos").limit(sample)
    lost = first.join(files.select("file_path").distinct(), "file_path", "left_anti").agg(F.count("*").alias("missing_files"))
    broken = first.agg(F.count_if(F.col("file_path").isNull()).alias("broken_assets"))
    gone = artifacts.agg(F.count_if(~F.col("present")).alias("missing_artifacts"))
    both = gone.join(lost).join(broken)
    return both.withColumn("status", F.when(F.col("missing_artifacts") > 0, "FAIL").when(F.col("broken_assets") > 0, "ERROR").when(F.col("missing_files") > 0, "WARN").otherwise("PASS")).drop("broken_assets")
