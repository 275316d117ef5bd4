"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Only vectors with equal labels are compared. On unit vectors, cosine >= t means a distance of at
most r = sqrt(2 - 2 t).

1. Equal vectors of one label fold into one row (the smallest id) that carries their number.
2. Coarse k-means centres, fitted on a bounded sample, give inverted lists per label. A vector also
   visits every list j in which a neighbour within r can lie: the bisector of its own centre i and
   centre j must be within r, that is d(x, j)^2 - d(x, i)^2 <= 2 r d(i, j). These probes are
   sufficient: no pair is lost. A pair in two lists is met in the one with the larger number. Lists
   grow in number with the square root of the rows: with more of them, vectors that lie evenly in
   many dimensions would visit nearly all.
3. In a list, residuals are coded by PARTS subspace codebooks; a lookup table per vector gives its
   asymmetric distance to every code. Each code carries its own quantisation error e, so a pair is
   let go only if table distance - e > r, which no true neighbour fulfils.
4. What is left is compared by exact cosine in double precision. Lists are compared block by block;
   a task returns partial link counts and at most one edge per row, never a row per pair.
5. Connected components of the links.

Vectors of different length have no cosine and link with nothing of another length; each of the
LENGTHS most frequent lengths has centres and codebooks of its own, and vectors of further lengths are
compared by exact cosine alone, in one list per label and length.

Cases: vectors that are null, empty, zero or that hold null or non-finite components, and rows with a
null label, link with nothing but are returned; rows with a null id are left out; rows that repeat an
id count once (the first label and vector in order); ties go to the smaller id; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import block_pairs, blocked, connected_components, group_bounds, grouped_batches, join_groups, stored
from brindle.llm.vectors import dtype, kmeans, matrices, nearest, once, samples, units, usable

PARTS = 8
WORDS = 64
SAMPLE = 8192
ROUNDS = 6
#: Rows of a list in a table as large as this; lists grow with the square root of the rows.
LIST_ROWS = 1000
MOST_LISTS = 4096
#: Rows of a block, and bytes of its vectors in double precision at most.
BLOCK, BLOCK_BYTES = 8192, 2**23
TILE = 512
SEED = 11


def fit(x, lists: int, parts: int = PARTS, words: int = WORDS):
    """Coarse centres and, for the residuals, a codebook per subspace."""
    import numpy as np

    coarse = kmeans(x, lists, ROUNDS, SEED)
    rest = x.astype(np.float32) - coarse[nearest(x.astype(np.float32), coarse)]
    books = [kmeans(part, words, ROUNDS, SEED + 1 + i) for i, part in enumerate(np.array_split(rest, min(parts, x.shape[1]), axis=1))]
    return coarse, books


def listed(v: DataFrame, models: dict, radius: float) -> DataFrame:
    """v (id, label, copies, vec): one row per list a vector is in or visits, with home (whether it is its own list) and vec as bytes."""
    shared = v.sparkSession.sparkContext.broadcast({dim: coarse for dim, (coarse, _) in models.items()})
    kind, label = dtype(v), v.schema["label"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        frames: dict = {}
        for dim, coarse in shared.value.items():
            c = coarse.astype(np.float64)
            sq = (c * c).sum(axis=1)
            frames[dim] = c, sq, np.sqrt(np.maximum(0, sq[:, None] + sq[None] - 2 * c @ c.T))
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                b = whole.slice(lo, 2048)
                for at, raw in matrices(b.column(3)):
                    if raw.shape[1] in frames:
                        c, sq, between = frames[raw.shape[1]]
                        x = units(raw)
                        d2 = sq - 2 * x @ c.T
                        own = d2.argmin(axis=1)
                        gap = d2 - d2[np.arange(len(x)), own][:, None]
                        probe = (gap <= 2 * radius * between[own] + 1e-9) & (np.arange(len(c)) > own[:, None])
                        probe[np.arange(len(x)), own] = True
                        row, lst = np.nonzero(probe)
                        home = own[row] == lst
                    else:
                        row, lst = np.arange(len(raw)), np.zeros(len(raw), np.int64)
                        home = np.ones(len(raw), bool)
                    cells = raw.astype(kind)
                    vecs = pa.array([r.tobytes() for r in cells], pa.binary()).take(pa.array(row))
                    took = b.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([*(took.column(i) for i in range(3)), vecs, pa.array(np.full(len(row), raw.shape[1], np.int32)), pa.array(lst.astype(np.int32)), pa.array(home)], names=["id", "label", "copies", "vec", "dim", "list", "home"])

    return v.select("id", "label", "copies", "vec").mapInArrow(run, f"id long, label {label}, copies long, vec binary, dim int, list int, home boolean")


class Codes:
    """Product codes of the vectors at home in one list, and what their quantisation leaves out."""

    def __init__(self, x, coarse, books):
        import numpy as np

        self.x, self.coarse, self.books = x, coarse, books
        self.spoilt = np.zeros(len(x), np.float32)
        self.words = []
        if books is None:
            return
        rest = x - coarse
        self.splits = np.array_split(np.arange(x.shape[1]), len(books))
        spoilt = np.zeros(len(x))
        for dims, book in zip(self.splits, books, strict=True):
            code = nearest(rest[:, dims].astype(np.float32), book)
            self.words.append(code)
            spoilt += ((rest[:, dims] - book[code]) ** 2).sum(axis=1)
        self.spoilt = np.sqrt(spoilt).astype(np.float32)

    def near(self, q, lo: int, hi: int, threshold: float):
        """Pairs (i, j) of rows of q and of rows lo..hi of x with cosine >= threshold: table distances, then exact cosines."""
        import numpy as np

        if self.books is None:
            return np.nonzero(q @ self.x[lo:hi].T >= threshold)
        rest = q - self.coarse
        near2 = np.zeros((hi - lo, len(q)), np.float32)
        for dims, book, code in zip(self.splits, self.books, self.words, strict=True):
            part = rest[:, dims]
            table = ((part**2).sum(axis=1)[None] + (book**2).sum(axis=1)[:, None] - 2 * book @ part.T).astype(np.float32)
            near2 += table[code[lo:hi]]
        radius = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-3
        keep = near2 <= ((self.spoilt[lo:hi] + np.float32(radius)) ** 2)[:, None]
        j, i = np.nonzero(keep)
        if len(i) > 0.02 * keep.size:  # a dense group: one product for the tile
            good = (self.x[lo:hi] @ q.T)[j, i] >= threshold
        else:
            good = np.ones(len(i), bool)
            for at in range(0, len(i), 65536):
                s = slice(at, at + 65536)
                good[s] = np.einsum("nd,nd->n", q[i[s]], self.x[lo + j[s]]) >= threshold
        return i[good], j[good]


def compare(x, home, blk, copies, diagonal: bool, coarse, books, threshold: float):
    """Links within a block (diagonal) or between two: how many vectors each row is linked with, and each row's root."""
    import numpy as np

    n = np.zeros(len(x), np.int64)
    root = np.arange(len(x))

    def add(rows, cols):
        """Compare every row with the vectors cols, which are at home."""
        codes = Codes(x[cols], coarse, books)
        same = rows is cols
        for a in range(0, len(rows), TILE):
            r = rows[a : a + TILE]
            for b in range(a if same else 0, len(cols), 8 * TILE):
                hi = min(len(cols), b + 8 * TILE)
                i, j = codes.near(x[r], b, hi, threshold)
                j = j + b
                if same:
                    later = j > i + a
                    i, j = i[later], j[later]
                if not len(i):
                    continue
                i, j = r[i], cols[j]
                n[:] += np.bincount(i, weights=copies[j], minlength=len(x)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(x)).astype(np.int64)
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                cuts = np.flatnonzero(np.diff(i)) + 1
                for row, to in zip(i[np.concatenate([[0], cuts])], np.split(j, cuts), strict=True):
                    met = root[to]
                    if (met != root[row]).any():
                        met = np.unique(np.append(met, root[row]))
                        root[np.isin(root, met)] = met[0]

    if diagonal:
        at_home = np.flatnonzero(home)
        add(at_home, at_home)
        if not home.all():
            add(np.flatnonzero(~home), at_home)
    else:
        one = blk == blk.min()
        if one.any() and (~one).any():
            add(np.flatnonzero(one), np.flatnonzero(~one & home))
            add(np.flatnonzero(~one & ~home), np.flatnonzero(one & home))
    return n, root


def _pairs(dealt: DataFrame, models: dict, kind: str, threshold: float) -> DataFrame:
    keys = ["label", "dim", "list", "bi", "bj"]
    shared = dealt.sparkSession.sparkContext.broadcast(models)
    held = dealt.select(*keys, "blk", "id", "copies", "vec", "home").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in grouped_batches(batches, keys):
            ids, copies, home, blk, vec = (pdf[c].to_numpy() for c in ("id", "copies", "home", "blk", "vec"))
            dim, lst, bi, bj = (pdf[c].to_numpy() for c in ("dim", "list", "bi", "bj"))
            for lo, hi in group_bounds(pdf, keys):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                s = slice(lo, hi)
                x = units(np.frombuffer(b"".join(vec[s]), kind).astype(np.float64).reshape(hi - lo, -1))
                coarse, books = shared.value.get(int(dim[lo]), (None, None))
                centre = None if coarse is None else coarse[lst[lo]].astype(np.float64)
                count, root = compare(x, home[s].astype(bool), blk[s], copies[s], bi[lo] == bj[lo], centre, books, threshold)
                some = np.flatnonzero(count)
                yield pd.DataFrame({"id": ids[s][some], "n": count[some], "other": ids[s][root[some]]}).astype("int64")

    return held.mapInPandas(run, "id long, n long, other long")


def label_key(vectors: DataFrame, name: str = "label") -> Column:
    """A label in a form that is equal where labels are: whole numbers stay numbers, other types become text that tells all their values apart (zeros of either sign are one)."""
    kind, label = vectors.schema[name].dataType.typeName(), vectors[name]
    if kind in ("byte", "short", "integer", "long"):
        return label.cast("long")
    if kind in ("float", "double"):
        return (label.cast("double") + F.lit(0.0)).cast("string")
    if kind == "binary":
        return F.hex(label)
    return F.when(label.isNotNull(), F.to_json(F.struct(label.alias("l")), {"ignoreNullFields": "false"})) if kind in ("struct", "array", "map") else label.cast("string")


def links(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = SAMPLE) -> DataFrame:
    """One row per id: vec_id, n_links, component_id (smallest id reachable by links), kept."""
    import numpy as np

    every = vectors.where(vectors["vec_id"].isNotNull()).select(vectors["vec_id"].cast("long").alias("vec_id"), label_key(vectors).alias("label"), vectors["embedding"].alias("embedding"))
    every = once(every, "vec_id", lambda df: df.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding"))
    v = usable(every, extra=("label",)).where(F.col("label").isNotNull())
    element = v.schema["vec"].dataType.elementType
    v = v.withColumn("vec", F.transform("vec", lambda c: c + F.lit(0).cast(element)))  # no negative zeros
    reps = stored(v.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("vec")), "vector-classes")
    lists = int(np.clip(np.sqrt(reps.count() / LIST_ROWS), 1, MOST_LISTS))
    models = {dim: fit(x, lists) for dim, x in samples(reps, sample_rows, SEED).items()}
    if not models:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    inside = stored(listed(reps, models, radius), "vector-lists")
    rows = max(256, min(BLOCK, BLOCK_BYTES // (8 * max(models))))
    dealt = block_pairs(blocked(inside, ["label", "dim", "list"], inside.count(), rows), "id", rows)
    partial = stored(_pairs(dealt, models, dtype(v), threshold), "vector-links")
    near = partial.groupBy("id").agg(F.sum("n").alias("near"))
    moved = connected_components(partial.select(F.col("id").alias("a"), F.col("other").alias("b")))
    # a vector finds its class by a 128-bit hash; of classes with many copies, no task holds all
    key = [F.xxhash64(F.lit(k), F.col("vec")).alias(f"h{k}") for k in (1, 2)]
    found = reps.select("label", "id", F.col("copies").alias("n"), *key).join(near, "id", "left").join(moved.withColumnRenamed("node", "id"), "id", "left")
    found = found.select("label", "h1", "h2", "n", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    thin = stored(v.select(F.col("id").alias("vec_id"), "label", *key), "vector-keys")
    of = join_groups(thin, stored(found, "vector-found"), ["label", "h1", "h2"], thin.count()).select("vec_id", "links", "component")
    out = every.select("vec_id").join(of, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
