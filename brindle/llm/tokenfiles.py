"""Token ids of a corpus as flat binary files, in order of doc_id.

Format: a folder of shards. Shard k is part-<k>.bin, the ids of its documents one after another as
little-endian unsigned integers (16 bits where the vocabulary and the end id fit, else 32), and
part-<k>.idx, little-endian 64-bit numbers: how many documents n it holds, their doc_ids (n), a flag
each (n; 1 where doc_id is null), and n + 1 offsets, counted in ids over the whole corpus, from the first
document's start to the last one's end. shards.json lists the shards in order, with the width of an id.
Files can be memory-mapped; a window of the corpus is a slice of one shard or of two.

Pass 1 range-partitions whole texts by doc_id; each task encodes its documents in order and writes the
ids as it goes, one document in memory at a time, and an index whose offsets begin at 0. The shards' totals
(two numbers each) give every shard its base by a prefix sum. Pass 2 moves each index to its base.
A task that runs again writes the same bytes under a name of its own and renames them into place.

Cases: null and empty texts are the end id alone; a null doc_id stands before all others; rows that
repeat a doc_id stand side by side in order of a hash of their text, and equal rows may lie in two shards;
very long texts are one document; an empty table gives a folder without shards; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import shared_dir, stored
from brindle.llm.tokens import default_path, tokenizer

END_ID = 2
#: Ids that a reader looks at in one go.
READ_IDS = 1 << 22


def _files(root: str):
    """The file system of a folder or URI, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").strip("/")
    files, base = fs.FileSystem.from_uri(root)
    return files, base.rstrip("/")


def _put(files, to: str, write) -> None:
    """Write a file under a name of its own and rename it into place."""
    made = f"{to}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(made) as out:
        write(out)
    files.move(made, to)


def _index(doc_ids: list, ends: list[int], base: int) -> bytes:
    n = len(doc_ids)
    return np.array([n, *(d or 0 for d in doc_ids), *(int(d is None) for d in doc_ids), base, *(base + e for e in ends)], "<i8").tobytes()


class Shard:
    """One shard, memory-mapped where its file system is local, else read by ranges."""

    def __init__(self, root: str, name: str, width: int):
        self.files, self.base = _files(root)
        self.name, self.kind = name, np.dtype(f"<u{width}")
        index = self._map(f"{self.base}/{name}.idx", np.dtype("<i8"))
        n = int(index[:1][0])
        self.doc_ids, self.null, self.offsets = index[1 : n + 1], index[n + 1 : 2 * n + 1], index[2 * n + 1 : 3 * n + 2]
        self.all_ids = self._map(f"{self.base}/{name}.bin", self.kind)

    def _map(self, path: str, kind):
        from pyarrow import fs

        if isinstance(self.files, fs.LocalFileSystem):
            return np.memmap(path, kind, "r")
        return _Ranges(self.files.open_input_file(path), kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids by their places in the corpus, within this shard."""
        base = int(self.offsets[:1][0])
        return np.asarray(self.all_ids[start - base : stop - base])


class _Ranges:
    """Slices of a file that can't be mapped."""

    def __init__(self, file, kind):
        self.file, self.kind, self.n = file, kind, file.size() // kind.itemsize

    def __getitem__(self, s: slice) -> np.ndarray:
        lo, hi, _ = s.indices(self.n)
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at(max(0, hi - lo) * w, lo * w), self.kind)


def write(docs: DataFrame, root: str, path: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Write docs' token files to root, a folder or URI that driver and executors share, and return what shards.json lists."""
    path = path or default_path()
    width = 2 if max(len(tokenizer(path).width) - 1, end_id) < 2**16 else 4
    files, base = _files(root)
    files.create_dir(base, recursive=True)

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, to = tokenizer(path), _files(root)
        name = f"part-{TaskContext.get().partitionId():06d}"
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, ends, at = [], [], 0

        def ids(out) -> None:
            nonlocal at
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = np.frombuffer(bpe.raw(t.as_py()) + end, "<u4")
                    at += len(raw)
                    doc_ids.append(d)
                    ends.append(at)
                    out.write(raw.astype(f"<u{width}").tobytes())

        _put(to[0], f"{to[1]}/{name}.bin", ids)
        _put(to[0], f"{to[1]}/{name}.idx", lambda out: out.write(_index(doc_ids, ends, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ends)], pa.int64()), pa.array([at], pa.int64())], names=["shard", "docs", "ids"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    by = [F.asc_nulls_first("doc_id"), F.col("tie"), F.col("nth")]
    dealt = texts.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    shards = stored(dealt.mapInArrow(encode, "shard string, docs long, ids long"), "shards")
    listed, at, before = [], 0, 0
    for r in shards.where("docs > 0").orderBy("shard").collect():  # one row per shard
        listed.append({"shard": r["shard"], "docs": r["docs"], "ids": r["ids"], "base": at, "docs_before": before, "width": width})
        at += r["ids"]
        before += r["docs"]
    if listed:
        rows = docs.sparkSession.createDataFrame([(s["shard"], s["base"]) for s in listed], "shard string, base long").repartition(len(listed), "shard")

        def move(batches):
            import pyarrow as pa

            to = _files(root)
            for batch in batches:
                names = batch.column(0).to_pylist()
                for name, start in zip(names, batch.column(1).to_pylist(), strict=True):
                    with to[0].open_input_stream(f"{to[1]}/{name}.idx") as f:
                        index = np.frombuffer(f.read(), "<i8").copy()
                    offsets = index[2 * index[0] + 1 :]
                    offsets += start - offsets[0]  # a second run moves nothing
                    _put(to[0], f"{to[1]}/{name}.idx", lambda out, index=index: out.write(index.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["shard"])

        rows.mapInArrow(move, "shard string").write.format("noop").mode("overwrite").save()
    _put(files, f"{base}/shards.json", lambda out: out.write(json.dumps(listed).encode()))
    return listed


def shards_of(root: str) -> list[dict]:
    files, base = _files(root)
    with files.open_input_stream(f"{base}/shards.json") as f:
        return json.loads(f.read())


def read(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32. Shards are read in ranges of documents, each some READ_IDS ids or one long document."""
    shards = shards_of(root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, width, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                shard = Shard(root, name, width)
                ids, null, at = (np.asarray(x) for x in (shard.doc_ids[lo:hi], shard.null[lo:hi], shard.offsets[lo : hi + 1]))
                crc = np.array([_crc(shard, a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(s["shard"], s["width"], s["docs"], max(1, s["docs"] * READ_IDS // max(1, s["ids"]))) for s in shards], "shard string, width int, docs long, step long")
    lows = rows.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, "step")))
    ranges = lows.select("shard", "width", "lo", F.least("docs", F.col("lo") + F.col("step")).alias("hi"))
    return ranges.repartition(max(1, len(shards)), "shard", "lo").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _crc(shard: Shard, start: int, stop: int) -> int:
    out = 0
    for lo in range(start, stop, READ_IDS):
        out = zlib.crc32(shard.ids(lo, min(stop, lo + READ_IDS)).astype("<u4").tobytes(), out)
    return out


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs' token files to a new folder in the shared one, and read them back; the folder goes with the application."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/brindle-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    write(docs, root, path, end_id)
    return read(spark, root)
