"""The stored index over a folder's documents that the retrieval plans search: built once per application and state of the table's files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.operators import retrieve, sparse_index
from brindle.sources import files
from brindle.sources.readers import table
from brindle.sources.scratch import kept, own_folder  # noqa: F401
from brindle.sources.store import Store

_BUILT: dict[tuple, Store] = {}


def corpus_index(spark: SparkSession, folder: str) -> Store:
    """Stored term vectors and postings of the documents in a folder; a table whose files have changed is indexed anew."""
    at, fs = files.at(spark, f"{folder}/documents.parquet")
    status = fs.getFileStatus(at)
    state = tuple(sorted(files.times(spark, f"{folder}/documents.parquet").items())) if status.isDirectory() else (status.getLen(), status.getModificationTime())
    key = (spark.sparkContext.applicationId, folder, state)
    if key not in _BUILT:
        store = Store(spark, own_folder(spark, "corpus"))
        docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
        with store.commit() as c:
            sparse_index.add(store, c, retrieve.term_vectors(docs, "id"), fresh=True, ids=docs.select("id"))
        _BUILT[key] = store
    return _BUILT[key]
