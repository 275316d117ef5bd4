"""Near-duplicate documents by min-max hashing.

Words are the runs of characters other than ASCII white space, after lower-casing A-Z; a document's
set holds its distinct 5-word shingles (with fewer words, the one sequence). Each of PERMUTATIONS
hash functions keeps the smallest and the largest value over the set, so PERMUTATIONS evaluations
give twice as many signature values, each of which agrees with probability J (the Jaccard
similarity), with less variance than as many independent minima.

1. Equal sets fold into one representative, the smallest doc_id; only representatives go on, so that
   groups of copies cost one row.
2. Signatures are cut into BANDS bands of ROWS values; documents that share a band meet in its bucket.
   At J = 0.85 a pair misses every bucket with probability (1 - J^4)^16 < 1e-5.
3. In a bucket, 8-bit signatures are compared with the pivot's (its smallest doc_id), and those unlike
   it with all others, block by block. Pairs estimated at SLACK below the threshold or less are let go
   (about five standard deviations); the others join a candidate group. A task returns one edge per row
   at most, whatever the bucket's size.
4. Candidate groups are compared in the same two steps on their full sets: exactly with the pivot's, and
   then, where a document isn't linked with the pivot, by matrix products of the shingle vectors.
5. Connected components of the exact links, over tables in the shared folder.

Cases: null, empty and blank texts have an empty set and link with nothing; rows with a null doc_id
are left out; rows that repeat a doc_id count as one document whose set is that of the first by set
hash; ties go to the smallest doc_id; further columns are ignored in links() and pass through
deduplicate() under any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import BLOCK_ROWS, Forest, group_bounds, grouped_batches, join_groups, star_components, stored

SHINGLE = 5
PERMUTATIONS = 32
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
SLACK = 0.25
SEED = 2024
_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"


def _mix(x):
    """Finaliser of splitmix64 on unsigned 64-bit arrays."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(h, found), np.uint64, len(found))
    n = max(1, len(w) - size + 1)
    acc = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for k in range(min(size, len(w))):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(acc)


def _functions():
    import numpy as np

    r = np.random.RandomState(SEED)
    a = r.randint(0, 2**32, size=(2, PERMUTATIONS), dtype=np.uint64)
    b = r.randint(0, 2**32, size=(2, PERMUTATIONS), dtype=np.uint64)
    return (a[0] << np.uint64(32) | a[1]) | np.uint64(1), b[0] << np.uint64(32) | b[1]


def signature(s, a, b):
    """The minima and the maxima of (a * x + b) mod 2^64 over a set, one after the other."""
    import numpy as np

    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(s), 4096):
        v = s[at : at + 4096, None] * a + b
        low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    return np.concatenate([low, high])


def signed(docs: DataFrame) -> DataFrame:
    """One row per document: set size, 128-bit hash of the set, 8-bit signature values, band hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        a, b = _functions()
        salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        names = [f.split()[0] for f in _SIGNED.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 512):
                n, sa, sb, sig, bands = [], [], [], [], []
                for t in texts.slice(lo, 512).to_pylist():
                    s = shingles(t)
                    n.append(len(s))
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    sa.append(whole >> 64)
                    sb.append(whole & (2**64 - 1))
                    if len(s):
                        # bits of a linear hash are weak at the low end; the mixed value is uniform
                        v = _mix(signature(s, a, b))
                        # rows of one band come from different functions, minima and maxima in turn
                        rows = v.reshape(2, PERMUTATIONS).T.reshape(-1).reshape(ROWS, BANDS)
                        k = salt.copy()
                        for r in rows:
                            k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + r)
                        bands.append(k.view(np.int64))
                        sig.append((v >> np.uint64(56)).astype(np.uint8).tobytes())
                    else:
                        bands.append(np.zeros(0, np.int64))
                        sig.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 512), pa.array(n, pa.int64()), pa.array(np.array(sa, np.uint64).view(np.int64)), pa.array(np.array(sb, np.uint64).view(np.int64)), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=names,
                )

    return docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, _SIGNED)


def _enough(least: float) -> float:
    """Of all signature values, how many must agree: equal bytes turn up by chance once in 256."""
    return 2 * PERMUTATIONS * (least + (1 - least) / 256)


def _likely_pairs(dealt: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """(id, pivot) of the documents whose signature agrees often enough with their pivot's."""
    keys = ["pivot", "blk"]
    held = dealt.join(sigs.hint("merge"), dealt["id"] == sigs["doc_id"]).select(*keys, "head", "id", "sig")
    held = held.repartition(*keys).sortWithinPartitions(*keys, F.desc("head"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in grouped_batches(batches, keys):
            v = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
            lo = np.repeat(*np.array([(a, b - a) for a, b in group_bounds(pdf, keys)]).T)  # where each row's head stands
            hit = ((v == v[lo]).sum(axis=1) >= _enough(least)) & (lo != np.arange(len(v)))
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[hit], "pivot": pdf["pivot"].to_numpy()[hit]})

    return held.mapInPandas(run, "id long, pivot long")


def _likely_rest(dealt: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that join the documents of a bucket whose signatures agree often enough."""
    keys = ["key", "bi", "bj"]
    held = dealt.join(sigs.hint("merge"), dealt["id"] == sigs["doc_id"]).select(*keys, "blk", "id", "sig")
    held = held.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in grouped_batches(batches, keys):
            ids, blk = pdf["id"].to_numpy(), pdf["blk"].to_numpy()
            bi, bj = pdf["bi"].to_numpy(), pdf["bj"].to_numpy()
            sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
            out: list[tuple[int, int]] = []
            for lo, hi in group_bounds(pdf, keys):
                if hi - lo > 1:
                    out += _linked(ids[lo:hi], blk[lo:hi], bi[lo] == bj[lo], lambda x, y, lo=lo: _agree(sigs[lo + x], sigs[lo + y]) >= _enough(least))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return held.mapInPandas(run, "a long, b long")


def _agree(x, y):
    """Counts of equal values between the rows of two signature matrices."""
    import numpy as np

    out = np.zeros((len(x), len(y)), np.int16)
    for k in range(x.shape[1]):
        out += x[:, k, None] == y[None, :, k]
    return out


def _linked(ids, blk, within: bool, compare) -> list[tuple[int, int]]:
    """Forest of the links within one block, or between two: compare(rows, rows) gives a boolean matrix."""
    import numpy as np

    k = len(ids)
    f = Forest(k)
    if within:
        at = np.arange(k)
        m = compare(at, at)
        np.fill_diagonal(m, False)
        f.join_matrix(m | m.T)
    else:
        first = blk.min()
        x, y = np.flatnonzero(blk == first), np.flatnonzero(blk != first)
        if len(x) and len(y):
            full = np.zeros((k, k), bool)
            full[np.ix_(x, y)] = compare(x, y)
            f.join_matrix(full | full.T)
    return [(int(ids[i]), int(ids[f.find(i)])) for i in range(k) if f.find(i) != i]


def overlap(sets: list):
    """Matrix of intersection sizes of sorted distinct arrays, by products over slices of the shared elements."""
    import numpy as np

    k = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(k), sizes)
    uniq, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((k, k), np.float32)
    shared = count[inv] > 1
    owner, inv = owner[shared], inv[shared]
    label = np.cumsum(count > 1) - 1
    col = label[inv]
    n = int(label[-1]) + 1 if len(label) else 0
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    step = 4096
    cuts = np.searchsorted(col, np.arange(0, n + step, step))
    for at, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if hi > lo:
            m = np.zeros((k, step), np.float32)
            m[owner[lo:hi], col[lo:hi] - at * step] = 1
            out += m @ m.T
    return out


def _verified_pairs(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(id, pivot) of the documents whose set is linked with their pivot's."""
    keys = ["pivot", "blk"]
    # one way at every size: candidates grow with the table, so they are never broadcast
    held = dealt.hint("merge").join(texts, dealt["id"] == texts["text_id"]).select(*keys, "head", "id", "text")
    held = held.repartition(*keys).sortWithinPartitions(*keys, F.desc("head"), "id")

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in grouped_batches(batches, keys, 256):
            ids, head, text, pivot = (pdf[c].to_numpy() for c in ("id", "head", "text", "pivot"))
            out: list[tuple[int, int]] = []
            for lo, hi in group_bounds(pdf, keys):
                sets = [shingles(t) for t in text[lo:hi]]
                n = int(head[lo:hi].sum())
                first = sets[_one_per_id(ids[lo : lo + n], sets[:n])[0]]
                for i in n + _one_per_id(ids[lo + n : hi], sets[n:]):
                    both = len(np.intersect1d(first, sets[i], assume_unique=True))
                    if 100 * both >= percent * (len(first) + len(sets[i]) - both):
                        out.append((int(ids[lo + i]), int(pivot[lo])))
            yield pd.DataFrame(out, columns=["id", "pivot"], dtype="int64")

    return held.mapInPandas(run, "id long, pivot long")


def _verified_rest(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Exact links of each pair of blocks as a forest (a, b)."""
    keys = ["key", "bi", "bj"]
    held = dealt.hint("merge").join(texts, dealt["id"] == texts["text_id"]).select(*keys, "blk", "id", "text")
    held = held.repartition(*keys).sortWithinPartitions(*keys, "id")

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in grouped_batches(batches, keys, 256):
            ids, blk, text = pdf["id"].to_numpy(), pdf["blk"].to_numpy(), pdf["text"].to_numpy()
            bi, bj = pdf["bi"].to_numpy(), pdf["bj"].to_numpy()
            out: list[tuple[int, int]] = []
            for lo, hi in group_bounds(pdf, keys):
                if hi - lo < 2:
                    continue
                # a doc_id that stands in several rows is one document: the text with the smallest set hash
                sets = [shingles(t) for t in text[lo:hi]]
                at = _one_per_id(ids[lo:hi], sets)
                sets = [sets[i] for i in at]
                size = np.array([len(s) for s in sets], np.float32)
                both = overlap(sets)
                link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
                out += _linked(ids[lo:hi][at], blk[lo:hi][at], bi[lo] == bj[lo], lambda x, y, link=link: link[np.ix_(x, y)])
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return held.mapInPandas(run, "a long, b long")


def _one_per_id(ids, sets):
    import numpy as np
    import xxhash

    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    best: dict[int, tuple] = {}
    for i, (d, s) in enumerate(zip(ids.tolist(), sets, strict=True)):
        whole = xxhash.xxh3_128_intdigest(s.tobytes())
        signed = tuple(x - 2**64 if x >= 2**63 else x for x in (whole >> 64, whole & (2**64 - 1)))
        best[d] = min(best.get(d, (signed, i)), (signed, i))
    return np.array(sorted(i for _, i in best.values()))


def links(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per doc_id: n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two documents are linked when 100 * intersection >= percent * union.
    """
    sig = stored(signed(docs), "signed")
    if sig.groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = sig.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "n_shingles", "sig", "bands")).alias("s"))
        sig = stored(first.select("doc_id", "s.n_shingles", "s.set_a", "s.set_b", "s.sig", "s.bands"), "signed")
    some = sig.where(F.col("n_shingles") > 0)
    sets = stored(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    reps = stored(some.join(sets.select("rep"), some["doc_id"] == F.col("rep"), "left_semi").select("doc_id", "sig", "bands"), "reps")
    members = stored(reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")), "buckets")
    sigs, least = reps.select("doc_id", "sig"), percent / 100 - SLACK
    near = star_components(members, "buckets", lambda d: _likely_pairs(d, sigs, least), lambda d: _likely_rest(d, sigs, least))
    near = stored(near.select(F.col("component").alias("key"), F.col("node").alias("id")), "candidates")
    texts = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("text_id"), docs["text"].cast("string").alias("text"))
    exact = star_components(near, "candidates", lambda d: _verified_pairs(d, texts, percent), lambda d: _verified_rest(d, texts, percent), BLOCK_ROWS // 2)
    moved = exact.where(F.col("node") != F.col("component"))
    classes = sets.join(moved, sets["rep"] == moved["node"], "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    out = join_groups(some, classes, ["set_a", "set_b"], sig.count()).select("doc_id", "n_shingles", "component")
    out = out.unionByName(sig.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("component") == F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stay: one of each group, and every one without a set or without a doc_id."""
    gone = links(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    gone = stored(gone, "gone")
    free = "".join(["gone_id", *["_" for c in docs.columns if c.startswith("gone_id")]])
    gone = gone.withColumnRenamed("gone_id", free)
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone[free], "left_anti")
