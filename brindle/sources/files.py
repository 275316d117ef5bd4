"""Small files and listings by way of the session's own file systems, whatever store a path is in."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """A path, and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def times(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder, and when each was changed, in seconds; nothing where there is no folder."""
    path, fs = at(spark, folder)
    return {x.getPath().getName(): x.getModificationTime() / 1000 for x in fs.listStatus(path)} if fs.exists(path) else {}


def names(spark: SparkSession, folder: str, folders: bool = False) -> list[str]:
    path, fs = at(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory() == folders] if fs.exists(path) else []


def pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointer files below root, falling."""
    return sorted((int(n.removeprefix("CURRENT-")) for n in names(spark, root) if n.startswith("CURRENT-")), reverse=True)


def text(spark: SparkSession, path: str) -> str:
    """A small file's text, read in one call."""
    found, fs = at(spark, path)
    stream = fs.open(found)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put(spark: SparkSession, path: str, body: str) -> None:
    found, fs = at(spark, path)
    out = fs.create(found, True)
    out.write(bytearray(body.encode()))
    out.close()


def put_new(spark: SparkSession, path: str, body: str) -> bool:
    """A file that must not be there yet, seen whole or not at all: written under another name and renamed. False if another was first."""
    folder, _, name = path.rpartition("/")
    made = f"{folder}/_{name}-{uuid.uuid4().hex}"
    put(spark, made, body)
    (a, fs), (b, _) = at(spark, made), at(spark, path)
    if not fs.exists(b) and fs.rename(a, b):
        return True
    fs.delete(a, False)
    return False


def delete(spark: SparkSession, path: str) -> None:
    found, fs = at(spark, path)
    fs.delete(found, True)
