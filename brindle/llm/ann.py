"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as a sum of STAGES full-dimensional codewords, one per residual codebook of
CODEWORDS words, found by beam search; its reconstruction's norm is stored with the code. A query
scores codes from a table of its inner products with every codeword: the sum of the looked-up entries
over the stored norm. In each block the SHORTLIST best are then reranked by exact cosine in double
precision on the original vectors, and so is every other row that scores within MARGIN of the k-th
best: in a dense group, where codes hardly differ, the whole group is reranked.

Codebooks are fitted on a bounded sample (SAMPLE rows with the smallest seeded hashes); every row is
encoded. The index, blocks of codes with their vectors, is written once and shuffled once; the
queries, a small share of the rows, are sent round to its groups of blocks. Per query and block the k
best leave a task, and a window keeps the best of those.

Vectors of different length have no cosine: each length has codebooks and blocks of its own. Beyond
the LENGTHS most frequent ones, vectors are scored exactly in place of codes.

Cases: vectors that are null, empty, zero, or that hold null or non-finite components take no part,
neither as query nor as candidate; rows that repeat a vec_id count once (the first vector in order);
ties go to the smaller vec_id; a query that no candidate has the length of gets no row; a table
without usable vectors gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import stored
from brindle.llm.vectors import dtype, kmeans, matrices, nearest, once, samples, units, usable

STAGES = 16
CODEWORDS = 256
BEAM = 4
SAMPLE = 8192
ROUNDS = 6
SHORTLIST = 256
MARGIN = 0.1
QUERY_BLOCK = 256
CODE_BLOCK = 16384
#: Bytes of one block's vectors in double precision, at most.
BLOCK_BYTES = 2**23
#: Blocks that queries are sent to together, once there are more than FREE_GROUPS blocks.
GROUP_BLOCKS, FREE_GROUPS = 4, 64
SEED = 5


def fit(x, stages: int = STAGES, words: int = CODEWORDS, rounds: int = ROUNDS, seed: int = SEED):
    """Residual codebooks (stages, words, dim); every one spans all dimensions."""
    import numpy as np

    k = max(1, min(words, len(x) // 4 or len(x)))
    rest, books = x.astype(np.float32), []
    for s in range(stages):
        c = kmeans(rest, k, rounds, seed + s)
        if len(c) < k:
            c = np.concatenate([c, np.zeros((k - len(c), c.shape[1]), np.float32)])
        books.append(c)
        rest = rest - c[nearest(rest, c)]
    return np.stack(books)


def encode(x, books, beam: int = BEAM):
    """Codes (rows, stages) and reconstruction norms, by beam search over the codebooks in order."""
    import numpy as np

    stages, k, dim = books.shape
    flat = books.reshape(-1, dim)
    codes, norms = [], []
    word_sq = (flat * flat).sum(axis=1)
    every = np.arange(1024)
    for at in range(0, len(x), 1024):
        v = x[at : at + 1024].astype(np.float32)
        n = len(v)
        dots = v @ flat.T
        err = np.zeros((n, 1), np.float32)  # |sum|^2 - 2 <x, sum>
        sums = np.zeros((n, 1, dim), np.float32)
        path = np.zeros((n, 1, 0), np.uint8)
        for s in range(stages):
            w = flat[s * k : (s + 1) * k]
            grown = err[:, :, None] + (word_sq[s * k : (s + 1) * k] - 2 * dots[:, s * k : (s + 1) * k])[:, None, :] + 2 * (sums.reshape(-1, dim) @ w.T).reshape(n, -1, k)
            wide = grown.reshape(n, -1)
            keep = min(beam, wide.shape[1])
            best = np.empty((n, keep), np.int64)
            err = np.empty((n, keep), np.float32)
            for b in range(keep):  # a few passes for the smallest are faster than a partition
                best[:, b] = wide.argmin(axis=1)
                err[:, b] = wide[every[:n], best[:, b]]
                wide[every[:n], best[:, b]] = np.inf
            from_, word = best // k, best % k
            sums = np.take_along_axis(sums, from_[:, :, None], axis=1) + w[word]
            path = np.concatenate([np.take_along_axis(path, from_[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        top = err.argmin(axis=1)
        codes.append(path[np.arange(n), top])
        r = sums[np.arange(n), top]
        norms.append(np.sqrt((r * r).sum(axis=1)))
    if not codes:
        return np.zeros((0, stages), np.uint8), np.zeros(0, np.float32)
    return np.concatenate(codes), np.concatenate(norms).astype(np.float32)


def block_rows(dim: int) -> int:
    return max(256, min(CODE_BLOCK, BLOCK_BYTES // (8 * max(1, dim))))


def code_blocks(v: DataFrame, books: dict, beam: int = BEAM) -> DataFrame:
    """The index: rows of up to block_rows vectors of one length (part and nth: where a row was made; ids, codes, norms and the vectors as bytes). Lengths without books have no codes."""
    shared = v.sparkSession.sparkContext.broadcast(books)
    kind = dtype(v)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, nth = TaskContext.get().partitionId(), {}, 0

        def block(dim, rows):
            nonlocal nth
            ids, vecs = (np.concatenate(x) for x in zip(*rows, strict=True))
            codes, norms = encode(units(vecs), shared.value[dim], beam) if dim in shared.value else (np.zeros((len(ids), 0), np.uint8), np.zeros(0, np.float32))
            cells = [ids.astype("<i8"), codes, norms.astype("<f4"), vecs.astype(kind)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([nth], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["part", "nth", "dim", "ids", "codes", "norms", "vecs"])
            nth += 1

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, x in matrices(batch.column(1)):
                dim = x.shape[1]
                for lo in range(0, len(at), block_rows(dim)):
                    rows = held.setdefault(dim, [])
                    rows.append((ids[at[lo : lo + block_rows(dim)]], x[lo : lo + block_rows(dim)]))
                    if sum(len(i) for i, _ in rows) >= block_rows(dim):
                        yield from block(dim, held.pop(dim))
        for dim, rows in held.items():
            yield from block(dim, rows)

    return v.select("id", "vec").mapInArrow(run, "part long, nth long, dim int, ids binary, codes binary, norms binary, vecs binary")


def query_blocks(q: DataFrame) -> DataFrame:
    """Queries in rows of QUERY_BLOCK at most, of one length each: dim, q_ids and q_vecs as bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(dim, rows):
            ids, x = (np.concatenate(c) for c in zip(*rows, strict=True))
            for lo in range(0, len(ids), QUERY_BLOCK):
                cells = [ids[lo : lo + QUERY_BLOCK].astype("<i8"), units(x[lo : lo + QUERY_BLOCK]).astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["dim", "q_ids", "q_vecs"])

        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, x in matrices(batch.column(1)):
                rows = held.setdefault(x.shape[1], [])
                rows.append((ids[at], x))
                if sum(len(i) for i, _ in rows) >= QUERY_BLOCK:
                    yield from block(x.shape[1], held.pop(x.shape[1]))
        for dim, rows in held.items():
            yield from block(dim, rows)

    return q.select("id", "vec").mapInArrow(run, "dim int, q_ids binary, q_vecs binary")


def _scores(pairs: DataFrame, books: dict, kind: str, k: int, shortlist: int, margin: float) -> DataFrame:
    """Of each pair of blocks: every query's k best, by table scores and then exact cosines."""
    shared = pairs.sparkSession.sparkContext.broadcast(books)
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.frombuffer(row["ids"], "<i8")
                vecs = units(np.frombuffer(row["vecs"], kind).astype(np.float64).reshape(len(ids), dim))
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                q = np.frombuffer(row["q_vecs"], "<f8").reshape(len(q_ids), dim)
                own = shared.value.get(dim)
                if own is None:
                    scored = (vecs @ q.T).T
                else:
                    stages, words, _ = own.shape
                    codes = (np.frombuffer(row["codes"], np.uint8).reshape(len(ids), stages).astype(np.int64) + np.arange(stages) * words).T.copy()
                    norms = np.maximum(np.frombuffer(row["norms"], "<f4"), 1e-12)
                    tables = (q.astype(np.float32) @ own.reshape(-1, dim).T).copy()  # (queries, stages * words)
                found: list[list] = [[], [], []]
                for qi in range(len(q_ids)):
                    if own is None:
                        near = scored[qi].copy()
                    else:
                        near = tables[qi].take(codes[0])
                        for s in range(1, stages):
                            near += tables[qi].take(codes[s])
                        near /= norms
                    near[ids == q_ids[qi]] = -np.inf
                    n = min(shortlist, len(near))
                    best = np.sort(np.partition(near, len(near) - n)[-n:])
                    some = np.flatnonzero(near >= min(best[0], best[-min(k, n)] - margin))
                    some = some[ids[some] != q_ids[qi]]
                    score = (vecs[some] * q[qi]).sum(axis=1)  # equal vectors give equal sums, unlike a product by blocks
                    order = np.lexsort((ids[some], -score))[:k]
                    found[0].append(np.full(len(order), q_ids[qi]))
                    found[1].append(ids[some[order]])
                    found[2].append(score[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=names)

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 5, shortlist: int = SHORTLIST, margin: float = MARGIN, sample_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine; is_query is a condition on column id."""
    v = once(usable(vectors), "id", lambda df: df.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec")))
    spark = v.sparkSession
    books = {dim: fit(x) for dim, x in samples(v, sample_rows, SEED).items()}
    if not books:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = stored(code_blocks(v, books), "ann-codes")
    size = codes.agg(F.count("*").alias("n"), (F.max("nth") + 1).alias("wide")).first()
    groups = max(min(size["n"], FREE_GROUPS), size["n"] // GROUP_BLOCKS)
    dealt = codes.withColumn("g", F.pmod(F.col("part") * size["wide"] + F.col("nth"), F.lit(groups))).drop("part", "nth")
    # a stated query set against all rows, block by block: queries are sent to every group, codes to one
    sent = query_blocks(v.where(is_query)).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = dealt.join(sent.hint("merge"), ["g", "dim"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = _scores(pairs, books, dtype(v), k, shortlist, margin).withColumn("rank", F.row_number().over(best))
    return near.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
