"""Importance resampling towards a target's distribution of hashed n-grams.

Each text becomes a row of a sparse document-by-bucket count matrix, written once as CSR blocks
(parquet rows of some dozen documents: starts, buckets and counts as little-endian integers). The column sums of the corpus' and
the target's blocks are the two distributions; the gains of the buckets, one number each, are sent to
all tasks, and the sparse matrix-vector product of the blocks with them gives each document's weight.
Gumbel noise from a seeded hash of doc_id turns the weights into a draw without replacement: the
highest scores win. Ranks come from a range partition by score and prefix sums over the partitions.

Cases: null and empty texts have no features and weight 0; rows that repeat a doc_id are scored and
drawn each; a null doc_id has no score and is never drawn; an empty corpus gives no rows, an empty
target gives all documents a gain from smoothing alone; further columns are ignored. Very long texts
are one row of the matrix with `buckets` entries at most.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stored

BUCKETS = 10_000
RUNS = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Texts of so many bytes together, or one longer text, become one block.
BLOCK_BYTES = 1 << 18
_BLOCKS = "doc_ids array<long>, n_words array<long>, starts binary, buckets binary, counts binary"
#: Bytes of words: lower-case letters, digits and all beyond ASCII; everything else parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@lru_cache(maxsize=512)
def _shifts(n: int) -> np.ndarray:
    """Four tables of 256: what n further zero bytes make of each byte of a CRC-32 (which is linear in it)."""
    if n <= 64:
        none = zlib.crc32(bytes(n))
        return np.array([[zlib.crc32(bytes(n), b << 8 * k) ^ none for b in range(256)] for k in range(4)], np.uint32)
    half = _shifts(n // 2)
    twice = _shifted(half, half)
    return _shifted(_shifts(1), twice) if n % 2 else twice


def _shifted(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]


def joined_crc(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b for checksums of a and of b, and the bytes of b."""
    out = np.empty(len(before), np.uint32)
    order = np.argsort(length, kind="stable")
    lengths, first = np.unique(length[order], return_index=True)
    for n, lo, hi in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        at = order[lo:hi]
        out[at] = _shifted(_shifts(n), before[at]) ^ after[at]
    return out


def block_of(texts: list[str | None], buckets: int = BUCKETS, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the CSR rows (starts, buckets, counts) of its runs of 1 to `runs` words, joined by a space."""
    numbers: defaultdict = defaultdict(count().__next__)
    per_text = [np.fromiter(map(numbers.__getitem__, words(t)), np.int64) for t in texts]
    n = np.array([len(w) for w in per_text], np.int64)
    if not numbers:
        return n, np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    crc_of = np.array([zlib.crc32(w) for w in numbers], np.uint32)
    spaced_of = np.array([zlib.crc32(b" " + w) for w in numbers], np.uint32)
    length_of = np.array([len(w) + 1 for w in numbers], np.int64)
    w = np.concatenate(per_text)
    doc = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(w))  # words from each to its text's end
    crc, at, keys = crc_of[w], np.arange(len(w)), [doc * buckets + crc_of[w] % buckets]
    for k in range(1, runs):
        going = left[at] > k
        at, crc = at[going], crc[going]
        tail = w[at + k]
        crc = joined_crc(crc, spaced_of[tail], length_of[tail])
        keys.append(doc[at] * buckets + crc % buckets)
    cells, counts = np.unique(np.concatenate(keys), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(texts) + 1) * buckets)
    return n, starts.astype(np.int64), (cells % buckets).astype(np.int32), counts.astype(np.int32)


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """The sparse count matrix of docs: one row per block of documents."""

    def run(batches):
        import pyarrow as pa

        def block(held):
            n, starts, cells, counts = block_of([t for _, t in held], buckets, runs)
            cols = [pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (starts, cells, counts))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_ids", "n_words", "starts", "buckets", "counts"])

        held, size = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                held.append((i, t))
                size += len(t or "") + 64
                if size >= BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, _BLOCKS)


def _ints(cell, kind: str) -> np.ndarray:
    """A binary cell's integers, where they lie."""
    return np.frombuffer(cell.as_buffer(), kind)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of the whole matrix by bucket. A task sums its blocks first and sends a row per bucket."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for cells, counts in zip(batch.column(0), batch.column(1), strict=True):
                n += np.bincount(_ints(cells, "<i4"), _ints(counts, "<i4"), buckets).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of two tables of column sums: what one feature of each bucket adds to a weight, in thousandths. `buckets` numbers, however large the inputs."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for sums, out in ((corpus, s), (target, t)):
        for r in sums.collect():  # one row per bucket
            out[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times gain, as the floored mean over each document's features."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                ids, n = batch.column(0)[k].values, batch.column(1)[k].values
                starts, cells, counts = (_ints(batch.column(c)[k], kind) for c, kind in ((2, "<i8"), (3, "<i4"), (4, "<i4")))
                counts = counts.astype(np.int64)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (counts * shared.value[cells], counts)]
                total, features = (x[starts[1:]] - x[starts[:-1]] for x in sums)
                yield pa.RecordBatch.from_arrays([ids, n, pa.array(features), pa.array(total // np.maximum(features, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: weight plus Gumbel noise of the document's seeded hash, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """rows with rank, from 1 in the given order over the whole table, and how many there are.

    The order's range partitions are written with each row's place in its partition; the partitions'
    sizes, one number each, give every partition its base. Equal rows may be cut apart, so a value that a
    third of all rows shares doesn't meet in one task.
    """
    spread = rows.withColumn("_nth", F.monotonically_increasing_id())
    by = [*order, F.col("_nth")]
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    placed = stored(spread.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at).drop("_nth"), name)
    part = F.shiftright("_at", 33)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    base, total = {}, 0
    for p in sorted(sizes):
        base[p] = total
        total += sizes[p]
    bases = rows.sparkSession.createDataFrame([(int(p), int(b)) for p, b in base.items()], "_part long, _base long")
    out = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return out.withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND(2**33 - 1) + 1).drop("_part", "_base", "_at"), total


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, target_id: str = "item_id") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: 1, 2, 3 ... for the percent of documents with least_words words or more that are drawn, else null."""
    matrix = stored(count_matrix(docs, buckets=buckets, runs=runs), "counts")
    wanted = count_matrix(target, target_id, buckets=buckets, runs=runs)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets), buckets)
    rows = stored(scored(weights(matrix, gain), seed), "scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    places, n = ranked(rows.where(able), [F.desc("score"), F.col("doc_id")], "ranks")
    drawn = places.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, "rank").unionByName(rows.where(~able | F.col("score").isNull()).select(*columns, F.lit(None).cast("long").alias("rank")))
