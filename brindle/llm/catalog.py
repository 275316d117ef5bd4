"""The subpackage's queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import ann, asof, attribution, licenses, lines, minhash, mixing, oracles, packing, quality, resample, secrets, tokenfiles, vectordup
from brindle.llm.common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents")).drop("ids")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(read_table(spark, sf_dir, "documents")).drop("repeats")


def op5_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.links(read_table(spark, sf_dir, "documents"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.links(read_table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(read_table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "n_lines", "gone_exact", "gone_near", F.md5(F.col("doc.text").cast("binary")).alias("text_md5"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(read_table(spark, sf_dir, "documents"))


def op11_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.last_orders(read_table(spark, sf_dir, "clicks"), read_table(spark, sf_dir, "sales"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(read_table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_nearest": op2_nearest,
    "op3_pack": op3_pack,
    "op4_mix": op4_mix,
    "op5_near_documents": op5_near_documents,
    "op6_near_vectors": op6_near_vectors,
    "op7_secrets": op7_secrets,
    "op8_licenses": op8_licenses,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_last_order": op11_last_order,
    "op12_token_files": op12_token_files,
    "op13_resample": op13_resample,
}

#: The others choose by a seeded hash, need a tokenizer, learn, or approximate; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_near_documents": oracles.NEAR_DOCUMENTS,
    "op6_near_vectors": oracles.NEAR_VECTORS,
    "op7_secrets": oracles.SECRETS,
    "op8_licenses": oracles.LICENSES,
    "op9_line_dedup": oracles.LINES,
    "op11_last_order": oracles.LAST_ORDERS,
    "op13_resample": oracles.RESAMPLE,
}
