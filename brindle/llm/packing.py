"""Packing by concatenate-and-cut.

Pass 1 encodes each document once and writes its ids, its place in its partition and the tokens
before it there. The partitions' totals (one number each) give every partition its global offset by
a prefix sum. Pass 2 cuts the one long token stream at multiples of the window; a document that
crosses a boundary becomes one record per window. Nothing is shuffled, and the only thing that
reaches the driver is one total per partition.

Cases: null or empty text is the end token alone; a null doc_id is kept as null; repeated rows are
packed once per row; very long texts give many pieces; an empty table gives no rows; further columns
are ignored, whatever their names. Only the last window is partly filled.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stored
from brindle.llm.tokens import default_path, tokenizer

WINDOW = 2048
END_ID = 1
_ENCODED = "doc_id long, part int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """One row per document: its ids (little-endian 32-bit), its partition and the tokens before it there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, part, before = tokenizer(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                raw = [bpe.raw(t) + end if t else end for t in texts.slice(lo, 256).to_pylist()]
                n = np.array([len(r) // 4 for r in raw], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 256], pa.int64()), pa.array(np.full(len(raw), part, np.int32)), pa.array(starts), pa.array(n), pa.array(raw, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, _ENCODED)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids themselves."""
    spark = docs.sparkSession
    tokens = stored(encoded(docs, path or default_path(), end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per input partition
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]
    shared = spark.sparkContext.broadcast(base)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            doc, part, before, ids = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            rows: list[tuple] = []
            for d, p, b, raw in zip(doc, part, before, ids, strict=True):
                at, n = shared.value[p] + b, len(raw) // 4
                start = 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    length = min(n - start, window - off)
                    piece = raw[4 * start : 4 * (start + length)]
                    rows.append((d, start, length, zlib.crc32(piece), n, seq, off, piece))
                    start += length
            for lo in range(0, len(rows), 4096):
                cols = list(zip(*rows[lo : lo + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(np.array(c, np.int64)) for c in cols[1:7]), pa.array(cols[7], pa.binary())], names=[f.split()[0] for f in PIECES.split(", ")])

    return tokens.mapInArrow(cut, PIECES)
