"""Folders that an application uses on its way, in the one that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.session import shared_dir
from brindle.sources import files


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    root = f"{shared_dir(spark)}/brindle-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    at, fs = files.at(spark, root)
    fs.deleteOnExit(at)
    return root


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what follows may use it twice and computes it once, and joins know its size."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
