"""A stored inverted index with a maximum per block of postings, and top-k search that leaves out blocks that can't matter.

Rows are dealt into shards of some SHARD rows. postings holds one row per term and shard: the ids, their
values, and the greatest of them. A query's terms, weighted, times these maxima bound what any row of a
shard can score. The shards with the highest bounds are scored first; their k-th best score is a
threshold, and of the other shards only those whose bound reaches it are opened. No text is read, and the
result is that of scoring everything.

New rows get shards of their own; a row that is replaced or removed is listed as dead in its old shard,
and the terms' counts are corrected by what its stored vector held, so weights stay exact. What a
change writes follows the change. All tables of an index are in one store, beside others, and change in
one commit: vectors (id, shard, terms, values), postings, terms (term, df; changes that add up, with
the number of rows under a null term) and dead (id, shard).

Values must be more than 0, weights not less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.retrieve import top
from brindle.sources.scratch import kept
from brindle.sources.store import Change, Store

#: Rows of a shard, about; shards that are scored before there is a threshold.
SHARD, FIRST = 128, 4
#: Queries of a block, about.
QUERIES = 256


def add(store: Store, change: Change, rows: DataFrame, fresh: bool = False, ids: DataFrame | None = None) -> int:
    """rows (id, terms array, values array of the same length; a term at most once per row) in place of those with their ids; returns how many. fresh: the index is new, or begun anew, and holds none of them. ids: the rows' ids, where these are cheaper to read."""
    counts = (rows if ids is None else ids).groupBy("id").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    n = counts["n"] or 0
    base = change.state["marks"].get("shards", 0)
    shards = -(-n // SHARD)
    change.state["marks"]["shards"] = base + shards
    if not fresh:
        _bury(store, change, (rows if ids is None else ids).select("id"))
    place = F.lit(base) + F.pmod(F.xxhash64("id"), F.lit(max(1, shards)))
    vectors = rows.select("id", place.cast("long").alias("shard"), "terms", F.transform("values", lambda v: v.cast("double")).alias("values"))
    n = change.upsert("vectors", vectors, ["id"], by="id", unique=counts["most"] == 1)
    listed = _inverted(change.written("vectors"))
    change.append("postings", listed, by="term")
    counts = change.written("postings").groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    change.append("terms", counts.unionByName(_total(change, "postings", n)), by="term")
    return n


def _inverted(vectors: DataFrame) -> DataFrame:
    """The postings of vectors (id, shard, terms, values): a shard's rows are brought together and inverted in one go, so no entry of a vector is a row of a shuffle."""
    kinds = [vectors.schema[c].dataType for c in ("id", "terms")]

    def invert(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.sort_by("id")
        lists = rows.column("terms").combine_chunks()
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        some = coded.is_valid().to_numpy(zero_copy_only=False)
        row, value = np.repeat(np.arange(len(n)), n)[some], rows.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)[some]
        codes = coded.drop_null().indices.to_numpy()
        at = np.argsort(codes, kind="stable")  # rows of a term stay in order of id
        codes, row, value = codes[at], row[at], value[at]
        begin = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = pa.array(np.append(begin, len(codes)), pa.int32())
        most = np.maximum.reduceat(value, begin) if len(begin) else value
        ids = rows.column("id").combine_chunks().take(pa.array(row))
        shard = pa.repeat(pa.scalar(rows.column("shard")[0].as_py(), pa.int64()), len(begin))
        cols = [coded.dictionary.take(pa.array(codes[begin])), shard, pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(value)), pa.array(most)]
        return pa.table(cols, names=["term", "shard", "ids", "values", "most"])

    schema = f"term {kinds[1].elementType.simpleString()}, shard long, ids array<{kinds[0].simpleString()}>, values array<double>, most double"
    return vectors.select("id", "shard", "terms", "values").groupBy("shard").applyInArrow(invert, schema)


def remove(store: Store, change: Change, ids: DataFrame) -> int:
    """Rows that leave the index; returns how many of the ids it held."""
    n = _bury(store, change, ids)
    if n:
        change.delete("vectors", ids.select("id"))
    return n


def _total(change: Change, like: str, n: int) -> DataFrame:
    kind = change.written(like).schema["term"].dataType.simpleString()
    return change.store.spark.createDataFrame([(None, n)], f"term {kind}, df long")


def _bury(store: Store, change: Change, ids: DataFrame) -> int:
    """Old rows of ids: they are dead in their shards, and their terms count no more."""
    old = store.read("vectors", ids.select("id"))
    if old is None:
        return 0
    n = change.append("dead", old.select("id", "shard"))
    if n:
        counts = old.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        kind = old.schema["terms"].dataType.elementType.simpleString()
        gone = change.store.spark.createDataFrame([(None, -n)], f"term {kind}, df long")
        change.append("terms", counts.unionByName(gone), by="term")
    return n


def rebuild(store: Store, share: float = 0.0) -> bool:
    """The index anew from the vectors that it holds, without dead rows and with full shards; only where more than a share of its rows are dead. Returns whether it was."""
    tables = store.head()["tables"]
    rows = lambda name: sum(x["rows"] for x in tables.get(name, {"layers": []})["layers"])
    if rows("dead") <= share * rows("vectors"):
        return False
    held = store.read("vectors").select("id", "terms", "values")
    with store.commit() as c:
        for name in ("vectors", "postings", "terms", "dead"):
            c.state["tables"].pop(name, None)
        c.state["marks"]["shards"] = 0
        add(store, c, held, fresh=True)
    return True


def statistics(store: Store) -> DataFrame:
    """term, df: the rows that hold each term; under a null term, how many rows there are."""
    return store.read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def weighted(store: Store, asked: DataFrame) -> DataFrame:
    """asked (qid, term, tf): qid, term, w of terms that the index holds; w is tf times the term's inverse frequency in whole thousandths."""
    counts = store.read("terms").groupBy("term").agg(F.sum("df").alias("df"))
    size = counts.where("term is null").select(F.col("df").alias("n_rows"), F.lit(1).alias("one"))
    found = asked.join(counts, "term").where("df > 0").withColumn("one", F.lit(1)).join(F.broadcast(size), "one")
    idf = F.floor(F.log((F.col("n_rows") + 1).cast("double") / (F.col("df") + 1)) * 1000 + 1000)
    return found.select("qid", "term", (F.col("tf") * idf).cast("double").alias("w"))


def _asked(weights: DataFrame) -> DataFrame:
    """weights by term, in blocks of some QUERIES queries: term, block, qids, ws."""
    n = weights.select("qid").distinct().count()
    block = F.pmod(F.xxhash64("qid"), F.lit(-(-n // QUERIES) or 1)).alias("block")
    return weights.groupBy("term", block).agg(F.collect_list("qid").alias("qids"), F.collect_list("w").alias("ws"))


def _scored(asked: DataFrame, postings: DataFrame, shards: DataFrame, dead: DataFrame | None, k: int) -> DataFrame:
    """The rows of some shards (qid, block, shard) with their whole scores: a shard's postings of a block's terms are one product of two small matrices. Where no row is dead, only what can be among a query's k best is returned."""
    kinds = [asked.schema["qids"].dataType.elementType.simpleString(), postings.schema["ids"].dataType.elementType.simpleString()]
    most = k if dead is None else None

    def product(rows, wanted):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def cells(name):
            lists = rows.column(name).combine_chunks()
            return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))

        qids = wanted.column("qid").combine_chunks()
        (q, q_row), (w, _), (v, v_row) = cells("qids"), cells("ws"), cells("values")
        ids = cells("ids")[0].dictionary_encode()
        at = pc.index_in(q, value_set=qids)
        some = at.is_valid().to_numpy(zero_copy_only=False)
        left, right = np.zeros((len(qids), rows.num_rows)), np.zeros((rows.num_rows, len(ids.dictionary)))
        left[at.drop_null().to_numpy(), q_row[some]] = w.to_numpy()[some]
        right[v_row, ids.indices.to_numpy()] = v.to_numpy()
        met = np.zeros_like(left, np.float32)
        met[at.drop_null().to_numpy(), q_row[some]] = 1
        score = np.where(met @ (right > 0) > 0, np.round(left @ right, 10), -np.inf)
        least = np.full(len(score), -np.inf)
        if most is not None and score.shape[1] > most and len(score):
            least = np.partition(score, score.shape[1] - most, axis=1)[:, -most]
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        n = pa.scalar(rows.column("shard")[0].as_py() if rows.num_rows else 0, pa.int64())
        cols = [qids.take(pa.array(i)), pa.repeat(n, len(i)), ids.dictionary.take(pa.array(j)), pa.array(score[i, j])]
        return pa.table(cols, names=["qid", "shard", "id", "score"])

    opened = asked.join(postings.select("term", "shard", "ids", "values"), "term").join(shards.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
    new = [F.col(c).alias(f"_{c}") for c in ("shard", "block")]  # both sides come from one table: names of their own
    both = opened.withColumns({"_shard": F.col("shard"), "_block": F.col("block")}).groupBy("_shard", "_block").cogroup(shards.select("qid", *new).groupBy("_shard", "_block"))
    sums = both.applyInArrow(product, f"qid {kinds[0]}, shard long, id {kinds[1]}, score double")
    return sums if dead is None else sums.join(dead, ["id", "shard"], "left_anti")


def _bounds(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """qid, block, shard, bound (no row of the shard scores more), blocks (of postings that the query's terms have there)."""
    met = asked.join(postings.select("term", "shard", "most"), "term").select("block", "shard", "most", F.explode(F.arrays_zip("qids", "ws")).alias("e"))
    return met.groupBy(F.col("e.qids").alias("qid"), "block", "shard").agg(F.sum(F.col("e.ws") * F.col("most")).alias("bound"), F.count("*").alias("blocks"))


def top_k(store: Store, weights: DataFrame, k: int = 50, scope: bool = False, first: int = FIRST) -> DataFrame:
    """weights (qid, term, w; a term at most once per query): qid, id, score (dot product), rank; rows that share no term never appear.

    With scope, only the buckets of postings that can hold the queries' terms are opened: for few queries.
    """
    weights = kept(weights, "weights")
    postings, dead = store.read("postings", weights.select("term") if scope else None, exact=False), store.read("dead")
    # what several steps read is written once; few queries' terms are sent to the postings, which stay where they lie
    asked = kept(_asked(weights), "asked")
    bounds = kept(_bounds(asked, postings), "bounds")
    begun = top(bounds, first, "qid", "bound", "shard").select("qid", "block", "shard")
    early = kept(_scored(asked, postings, begun, dead, k), "early")
    enough = top(early, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    # bounds are sums in another order: a little more than rounding can take is allowed
    left = bounds.join(enough, "qid", "left").where(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("least")))
    late = _scored(asked, postings, left.select("qid", "block", "shard").join(begun, ["qid", "shard"], "left_anti"), dead, k)
    return top(early.unionByName(late).drop("shard"), k)


def opened(store: Store, weights: DataFrame, k: int = 50, first: int = FIRST) -> DataFrame:
    """One row: blocks of postings that the queries' terms have, and those that top_k opens; what the maxima spare."""
    postings = store.read("postings")
    asked = _asked(weights)
    bounds = _bounds(asked, postings)
    begun = top(bounds, first, "qid", "bound", "shard").select("qid", "block", "shard", F.lit(True).alias("early"))
    enough = top(_scored(asked, postings, begun.drop("early"), store.read("dead"), k), k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    told = bounds.join(begun.drop("block"), ["qid", "shard"], "left").join(enough, "qid", "left")
    reached = F.col("early") | F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("least"))
    return told.agg(F.sum("blocks").alias("blocks"), F.sum(F.when(reached, F.col("blocks")).otherwise(0)).alias("opened"))
