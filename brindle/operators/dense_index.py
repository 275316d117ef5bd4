"""A stored dense index: inverted lists around centres, with insertion, deletion, and filters inside the search.

Centres are fitted once, on a bounded sample of the first vectors; every vector lies in the list of its
nearest centre, and the lists are the buckets of a table. A query visits the lists of its nearest
centres: only these are opened, a filter on payload columns goes into their scan, and blocks of queries
and of rows are multiplied list by list. Visiting all lists is an exact search. New vectors are written
beside the old ones and deleted ones as tombstones (see Store), so a change writes what it changes;
refit() draws new centres once the vectors have moved away from the old ones.

Vectors that are null, of another length than the centres', zero or not finite are not indexed.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from brindle.operators.retrieve import blocks_top_k, packed, top, unit
from brindle.sources.store import Change, Store

#: Rows that centres are fitted on, at most; lists; lists that a query visits.
SAMPLE, LISTS, PROBES = 20_000, 64, 12
SEED = 5


def _usable(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """rows with vec as a unit vector in double precision; those that can't be indexed are left out."""
    fine = rows.where("vec is not null").where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    fine = fine if dim is None else fine.where(F.size("vec") == dim)
    return fine.where(F.exists("vec", lambda x: x != 0)).withColumn("vec", unit(F.col("vec")))


def fit(rows: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> list[list[float]]:
    """Centres of a bounded sample (rows with the smallest hashes) of vectors of the most frequent length."""
    fine = _usable(rows)
    lengths = fine.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return []
    some = fine.where(F.size("vec") == lengths["dim"]).orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("vec").alias("features"))
    k = max(1, min(lists, lengths["n"] // 8))
    model = KMeans(k=k, seed=SEED, maxIter=10, initSteps=2).fit(some) if k > 1 else None
    centres = model.clusterCenters() if model is not None else [np.array(fine.where(F.size("vec") == lengths["dim"]).orderBy("id").first()["vec"])]
    return [[float(x) for x in c] for c in centres]


def nearest_lists(rows: DataFrame, centres: list[list[float]], probes: int = 1) -> DataFrame:
    """rows with list: one row for each of the probes nearest centres."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centres))
    at_vec = rows.columns.index("vec")

    def run(batches):
        import pyarrow as pa

        c = shared.value
        half = (c * c).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(at_vec).flatten().to_numpy().reshape(batch.num_rows, -1)
            away = half - x @ c.T
            n = min(probes, len(c))
            near = np.argpartition(away, n - 1, axis=1)[:, :n]
            took = batch.take(pa.array(np.repeat(np.arange(len(x)), n)))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(near.ravel().astype(np.int32))], names=[*took.schema.names, "list"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("list", IntegerType())]))


def add(store: Store, change: Change, rows: DataFrame, lists: int = LISTS) -> int:
    """rows (id, vec, any payload) in place of those with their ids; the first call fits the centres. Returns how many were indexed."""
    kept = store.read("centres")
    if kept is None:
        centres = fit(rows, lists)
        change.replace("centres", store.spark.createDataFrame(list(enumerate(centres)), "list int, vec array<double>"))
    else:
        centres = [r["vec"] for r in kept.orderBy("list").collect()]  # as many as there are lists
    if not centres:
        return 0
    fine = _usable(rows, len(centres[0]))
    placed = nearest_lists(fine, centres)
    # an id may move to another list: its old row is found by id, so buckets follow the list and the key is both
    old = store.read("lists")
    if old is not None:
        moved = old.select("id", F.col("list")).join(rows.select("id"), "id", "left_semi")
        change.delete("lists", moved)
    return change.upsert("lists", placed, ["id", "list"], by="list", buckets=len(centres))


def remove(store: Store, change: Change, ids: DataFrame) -> int:
    """Returns how many of the ids were indexed."""
    old = store.read("lists")
    return 0 if old is None else change.delete("lists", old.select("id", "list").join(ids.select("id").distinct(), "id", "left_semi"))


def search(store: Store, queries: DataFrame, k: int = 50, probes: int = PROBES, where: Column | None = None) -> DataFrame:
    """queries (qid, vec): qid, id, score (cosine to ten places), rank of the k nearest rows that fulfil `where` (over the payload), in the probes nearest lists."""
    centres = [r["vec"] for r in store.read("centres").orderBy("list").collect()]
    asked = nearest_lists(_usable(queries.select("qid", "vec"), len(centres[0])), centres, probes)
    rows = store.read("lists", asked.select("list"), exact=False)
    rows = rows if where is None else rows.where(where)
    d, q = packed(rows, "id", by="list"), packed(asked, "qid", by="list").withColumnsRenamed({"ids": "qids", "m": "qm"})
    return top(blocks_top_k(d.join(q, ["list", "dim"]), k), k)


def refit(store: Store, lists: int = LISTS) -> int:
    """New centres from the vectors that the index holds, and all of them dealt anew; returns how many."""
    rows = store.read("lists").drop("list")
    with store.commit() as c:
        centres = fit(rows, lists)
        c.replace("centres", store.spark.createDataFrame(list(enumerate(centres)), "list int, vec array<double>"))
        placed = nearest_lists(_usable(rows, len(centres[0])), centres)
        return c.replace("lists", placed, ["id", "list"], "list", len(centres))
