"""Incremental ingestion and indexing with Structured Streaming. The checkpoint takes the place of a savepoint file: offsets and writes move together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import index
from brindle.sources import sinks
from brindle.sources.store import Store


def new_documents(stream: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of a stream, each id once over the stream's life."""
    return stream.dropDuplicates([key])


def index_stream(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, by: str | None = None, buckets: int = 256):
    """Upsert each micro-batch into the table at root; runs what is there and ends. A batch that is run again changes nothing.

    With by, a column among the keys, the table lies in buckets of its hash, and a batch rewrites only those it has rows in.
    """

    def merge(now: DataFrame | None, rows: DataFrame) -> DataFrame:
        return index.last_by_key(rows, keys, order) if now is None else index.upsert(now, rows, keys, order)

    def write(batch: DataFrame, _: int) -> None:
        rows = prepare(batch) if prepare else batch
        if by is not None:
            sinks.swap_buckets(rows, root, merge, buckets, by)
        else:
            sinks.swap(merge(sinks.current(rows.sparkSession, root), rows), root)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_stream(stream: DataFrame, root: str, table: str, checkpoint: str, keys: list[str], order: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, by: str | None = None, name: str = "stream"):
    """Upsert each micro-batch into a table of the store at root; runs what is there and ends.

    A batch writes its own rows, and its number is part of the commit: one that is replayed, because the
    query was lost after the commit and before its checkpoint, commits nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root)
        if store.seen(name, number):
            return
        with store.commit((name, number)) as c:
            c.upsert(table, prepare(batch) if prepare else batch, keys, order, by)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str = "doc_id", at: str = "at", forget: str = "30 days") -> DataFrame:
    """Documents of a stream whose id was not seen within `forget` of their time at; older state is freed, so it doesn't grow with the stream's life. For the registry of all time, take out registered documents too (see index.not_ingested)."""
    return stream.withWatermark(at, forget).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, for monitoring a run."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
