"""The corpus pipeline: quality, line dedup, near-document dedup, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import lines, minhash, mixing, packing, quality
from brindle.llm.common import discard, read_table, stored, written
from brindle.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat, whole or but for some edits (more in longer lines), the first stays; documents left without text go."""
    ship(spark)
    return lines.cleaned(docs, lines.BY_LENGTH)


def drop_near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    ship(spark)
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token stream, with their ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_documents),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_tokens),
]

#: No SQL: the stages' results are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written and read again as the next one's docs. Once it is written, what the stage read and wrote on its way goes."""
    docs, older = read_table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with written() as newer:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{i}")
        discard(spark, [*older, *newer[:-1]])
        older = newer[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
