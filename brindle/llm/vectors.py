"""What the two vector operators share: usable vectors, bounded samples, k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Lengths of vectors that get codebooks, the most frequent ones; vectors of further lengths are compared exactly.
LENGTHS = 4


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", extra: tuple = ()) -> DataFrame:
    """Rows whose vector can be compared: (id, vec, dim, *extra), one per id (the first vector in order); vec keeps single precision, and anything else becomes double.

    Left out: null ids, null or empty vectors, null or non-finite components, zero vectors. Vectors of
    different length (dim) can't be compared with each other; each length is a world of its own.
    """
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<float>" if single else "array<double>").alias("vec"), *[vectors[c].alias(c) for c in extra])
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
    return v.withColumn("dim", F.size("vec"))


def dtype(v: DataFrame) -> str:
    """How the components of a usable vector are written as bytes."""
    return "<f4" if isinstance(v.schema["vec"].dataType.elementType, FloatType) else "<f8"


def once(df: DataFrame, key: str, first) -> DataFrame:
    """df as it is where no key repeats, and first(df) where one does; only the keys are shuffled to find that out."""
    repeats = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return first(df) if repeats.limit(1).count() else df


def samples(v: DataFrame, rows: int, seed: int) -> dict:
    """Per length, of the LENGTHS most frequent ones (ties to the shorter): the vectors with the smallest seeded hashes of their ids, unit length, as a float64 matrix of rows at most."""
    import numpy as np

    lengths = v.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    out = {}
    for r in lengths:
        got = v.where(F.col("dim") == r["dim"]).select("vec", F.xxhash64("id", F.lit(seed)).alias("h"), "id").orderBy("h", "id").limit(rows).select("vec").collect()
        out[r["dim"]] = units(np.array([r["vec"] for r in got], np.float64))
    return out


def matrices(column):
    """Of a list column of vectors: (row numbers, float64 matrix) per length."""
    import numpy as np

    offsets = column.offsets.to_numpy()
    values, dims = column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    starts = offsets[:-1] - offsets[0]
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, values[starts[at][:, None] + np.arange(d)].astype(np.float64)


def units(x):
    """Rows at unit length; scaled first, so that no square over- or underflows."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x, k: int, rounds: int, seed: int):
    """Lloyd's algorithm from seeded rows; an empty centre keeps its place."""
    import numpy as np

    r = np.random.RandomState(seed)
    x = x.astype(np.float32)
    c = x[r.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x, c):
    import numpy as np

    out = np.empty(len(x), np.int64)
    half = 0.5 * (c * c).sum(axis=1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ c.T - half).argmax(axis=1)
    return out
