"""Writers of artifacts. Tables that change are written as a new version; the caller swaps the pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.index import last_by_key
from brindle.sources import files
from brindle.sources.store import Store


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def reset(df: DataFrame, path: str, fmt: str = "json", keep: bool = False) -> None:
    """An empty artifact: created where there is none, and emptied unless keep."""
    df.limit(0).write.mode("ignore" if keep else "overwrite").format(fmt).save(path)


_fs, _pointers = files.at, files.pointers


def _pointed(spark: SparkSession, root: str) -> dict[str, str] | None:
    """What the newest pointer says: the folder of each bucket, or one folder under the empty name."""
    found = _pointers(spark, root)
    if not found:
        return None
    return json.loads(files.text(spark, f"{root}/CURRENT-{found[0]}"))


def _point(spark: SparkSession, root: str, to: dict[str, str]) -> None:
    """A new pointer file beside the old ones: written under another name and renamed, so that a reader sees all of it or the one before."""
    number = max(_pointers(spark, root), default=0) + 1
    made, fs = _fs(spark, f"{root}/_CURRENT-{number}-{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(to).encode()))
    out.close()
    final, _ = _fs(spark, f"{root}/CURRENT-{number}")
    if fs.exists(final) or not fs.rename(made, final):
        raise RuntimeError(f"another writer made {final.toString()} first")


def current(spark: SparkSession, root: str, doc_ids: list[str] | None = None) -> DataFrame | None:
    """The version of a table that its newest pointer names; of a bucketed one, only the buckets that can hold doc_ids are read, and only their rows returned."""
    to = _pointed(spark, root)
    if to is None or "tables" in to:  # a store: its points, or the table of it that root names
        above, _, name = root.rstrip("/").rpartition("/")
        held, name = (Store(spark, root), "points") if to else (Store(spark, above), name)
        return held.read(name, None if doc_ids is None else spark.createDataFrame([(d,) for d in doc_ids], "doc_id string"))
    if "" in to:
        rows = spark.read.parquet(f"{root}/{to['']}")
    else:
        n = int(to["buckets"])
        wanted = {str(r[0]) for r in spark.createDataFrame([(d,) for d in doc_ids], "d string").select(_bucket(F.col("d"), n)).collect()} if doc_ids is not None else set(to)
        paths = [f"{root}/{v}" for k, v in to.items() if k not in ("buckets", "any") and k in wanted]
        rows = spark.read.parquet(*paths) if paths else spark.read.parquet(f"{root}/{to['any']}").limit(0)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(*doc_ids))


def swap(df: DataFrame, root: str) -> str:
    """Write df as a new version, then point to it; a reader sees the old one or the new one, never a part, and a writer that fails leaves the old one."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    _point(df.sparkSession, root, {"": name})
    return name


def _bucket(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def swap_buckets(df: DataFrame, root: str, merge=None, buckets: int = 256, by: str = "doc_id") -> list[int]:
    """Rewrite only the buckets (hash of by) that df has rows in: merge(old rows there or None, df) gives their new rows. Returns the buckets.

    The first write fixes the number of buckets. A bucket is one folder; the pointer lists them all.
    """
    spark = df.sparkSession
    to = _pointed(spark, root) or {"buckets": str(buckets)}
    n = int(to["buckets"])
    dealt = df.withColumn("_bucket", _bucket(F.col(by), n))
    touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())  # one row per bucket at most
    if not touched and "any" in to:
        return []
    old = [f"{root}/{to[str(b)]}" for b in touched if str(b) in to]
    rows = df if merge is None else merge(spark.read.parquet(*old) if old else None, df)
    name = f"v-{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(F.col(by), n)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{name}")
    rows.limit(0).write.parquet(f"{root}/{name}-any")
    held = _fs(spark, f"{root}/{name}")[1]
    for b in touched:
        to.pop(str(b), None)
        if held.exists(_fs(spark, f"{root}/{name}/_bucket={b}")[0]):
            to[str(b)] = f"{name}/_bucket={b}"
    _point(spark, root, to | {"any": f"{name}-any"})
    return touched


def ensure(spark: SparkSession, root: str, schema: str, recreate: bool = False) -> bool:
    """An empty table where there is none, or in place of what is there; whether it was made."""
    if not recreate and _pointers(spark, root):
        return False
    swap(spark.createDataFrame([], schema), root)
    return True


def write_blobs(rows: DataFrame, root: str) -> DataFrame:
    """rows (asset_id, file_path, blob): write each blob below root, and return asset_id, file_path, n_bytes, error (null where it was written).

    Executors write; root is a folder or URI that all of them see. A blob is written under another name
    and renamed, so that a task that runs again replaces the same file.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for asset, path, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                error, to = None, f"{base}/{path}"
                try:
                    files.create_dir(to.rpartition("/")[0], recursive=True)
                    made = f"{to}.{uuid.uuid4().hex}.part"
                    with files.open_output_stream(made) as f:
                        f.write(blob or b"")
                    files.move(made, to)
                except OSError as x:
                    error = str(x)
                out.append((asset, path, len(blob or b""), error))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["asset_id", "file_path", "n_bytes", "error"])

    return rows.select("asset_id", "file_path", F.col("blob").cast("binary").alias("blob")).mapInArrow(run, "asset_id string, file_path string, n_bytes long, error string")


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the pointers of a swapped table but for the newest `keep`, and the folders that none of these names; returns how many folders."""
    found = _pointers(spark, root)
    stay = found[: max(1, keep)]
    used = {v.split("/")[0] for p in stay for k, v in json.loads(files.text(spark, f"{root}/CURRENT-{p}")).items() if k != "buckets"}
    for p in found[len(stay) :]:
        files.delete(spark, f"{root}/CURRENT-{p}")
    gone = [n for n in files.names(spark, root, folders=True) if n.startswith("v-") and n not in used]
    for n in gone:
        files.delete(spark, f"{root}/{n}")
    return len(gone)


def save_blobs(rows: DataFrame, root: str) -> DataFrame:
    """rows (asset_id, file_path, blob) as files below root, in two steps; returns asset_id, file_path, n_bytes, as written beside them.

    First all blobs are written to a folder of this call; a call that fails there deletes it and leaves no
    file. Then each is renamed into place, in tasks again; that step may be repeated. root is a folder or
    URI that all executors see. Of rows that share a file_path one is written, the same in any plan.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    stage = f"{root}/.staged-{job}"
    once = last_by_key(rows.select("asset_id", "file_path", F.col("blob").cast("binary").alias("blob")), ["file_path"])

    def steps(batches, put):
        import pyarrow as pa
        from pyarrow import fs

        where = fs.FileSystem.from_uri(root)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            for path, x in zip(cols[1], cols[2], strict=True):
                put(*where, path, x)
            size = cols[2] if batch.schema.field(2).name == "n_bytes" else [len(b or b"") for b in cols[2]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(size, pa.int64())], names=["asset_id", "file_path", "n_bytes"])

    def staged(fs_, base, path, blob):
        to = f"{base}/.staged-{job}/files/{path}"
        fs_.create_dir(to.rpartition("/")[0], recursive=True)
        made = f"{to}.{uuid.uuid4().hex}.part"  # a task that runs again writes beside the first one
        with fs_.open_output_stream(made) as f:
            f.write(blob or b"")
        fs_.move(made, to)

    def placed(fs_, base, path, _):
        from pyarrow import fs as kinds

        made, to = f"{base}/.staged-{job}/files/{path}", f"{base}/{path}"
        if fs_.get_file_info(made).type == kinds.FileType.NotFound:
            return  # moved by this task's first run
        fs_.create_dir(to.rpartition("/")[0], recursive=True)
        fs_.move(made, to)

    schema = "asset_id string, file_path string, n_bytes long"
    try:
        once.mapInArrow(lambda b: steps(b, staged), schema).write.parquet(f"{stage}/list")
        listed = spark.read.schema(schema).parquet(f"{stage}/list")
        listed.mapInArrow(lambda b: steps(b, placed), schema).write.parquet(f"{root}/_blobs/{job}")
    finally:
        files.delete(spark, stage)
    return spark.read.schema(schema).parquet(f"{root}/_blobs/{job}")


def report(stats: DataFrame, path: str, validation: DataFrame | None = None, run_id: str | None = None) -> None:
    """One JSON record; with the one row of a validation under its name, and the run's id."""
    if validation is not None:
        stats = stats.join(F.broadcast(validation.select(F.struct(*validation.columns).alias("validation"))))
    if run_id is not None:
        stats = stats.withColumn("run_id", F.lit(run_id))
    stats.coalesce(1).write.mode("overwrite").json(path)


def table_html(elements: DataFrame, wrap) -> DataFrame:
    """element_id, html of table elements, ready to be written as files."""
    return elements.where(F.col("type") == "table").select("element_id", wrap(F.col("content")).alias("html"))
