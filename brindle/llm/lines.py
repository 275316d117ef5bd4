"""Line dedup by a segment-partition edit join.

Two lines are near when at most MAX_EDITS (or as many as is asked for) insertions, deletions or substitutions of characters turn
one into the other. A line of length l is split into MAX_EDITS + 1 segments; if a longer or equal
line is near it, that line holds one of the segments unchanged, at a start that the lengths allow
(multi-match-aware selection). So each line is written under its own segments' keys (length, segment
number, hash of the substring) and under those of the substrings that it may share with shorter
lines, and near lines meet under some key.

1. Equal lines fold by a 128-bit hash; the first place (smallest doc_id, then line) of each stands for it.
2. Keys are dealt by hash and sorted; keys under which two different lines stand go on.
3. Lines of a key are compared with its pivot, and those unlike it block by block: strip what both begin
   and end with, then the banded bit-parallel edit distance on the rest. A task returns one edge per line at most.
4. Connected components give classes; the first occurrence (smallest doc_id, then line) of a class
   stays, and every other one goes.

With BY_LENGTH for a number of edits, the threshold grows with the shorter line: one edit per
BAND_CHARS characters, MOST_EDITS at most. Lines are dealt into bands of BAND_CHARS lengths. A band
with threshold t has t + 1 segments of one size, the first ones placed from the line's start and the
rest from its end, so that the i-th from either side moves by i at most: some segment i is whole with
exactly i edits before it. A line is written under its own band's keys, and under the band's below if
a line there can be near.

Only lines of at least MIN_CHARS characters take part; shorter ones, blank ones too, always stay.
Cases: null text is returned as null; empty text has no line that takes part; rows that repeat a
doc_id are versions of one document: a line goes from those rows alone that hold it at its number, and
what stands at a class's first place stays in every row; rows with a null doc_id are left as they
are; further columns pass through under any name; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Forest, group_bounds, grouped_batches, join_groups, let, star_components, stored
from brindle.llm.minhash import _mix

MAX_EDITS = 1
MIN_CHARS = 20
#: In place of a number of edits: as many as the shorter line's length allows.
BY_LENGTH = None
BAND_CHARS = 20
MOST_EDITS = 5
#: Odd base of the polynomial hash of substrings (any random odd number).
_BASE = 0xD6E8FEB86659FD93
#: Lines that a task remembers, so that copies are written under their keys once.
_SEEN = 1_000_000


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of edits + 1 segments that tile a length as evenly as can be, longer ones last."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    sizes = [short] * (parts - longer) + [short + 1] * longer
    out, at = [], 0
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def selection(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size): where a line of this length may hold the segments of a line of length other <= length."""
    gap, found = length - other, []
    for i, (p, size) in enumerate(segments(other, edits)):
        lo = max(0, p - i, p + gap - (edits - i))
        hi = min(length - size, p + i, p + gap + (edits - i))
        found += [(i, s, size) for s in range(lo, hi + 1)]
    return found


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most edits, by Hyyro's banded bit-parallel recurrence."""
    if abs(len(a) - len(b)) > edits:
        return False
    if len(a) < len(b):
        a, b = b, a
    lo = len(commonprefix((a, b)))
    a, b = a[lo:], b[lo:]
    hi = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not b:
        return len(a) <= edits
    # bit r of a column's vectors stands for row column - edits + r of the matrix (rows: a, columns: b)
    width = 2 * edits + 2
    mask = (1 << width) - 1
    m, n = len(a), len(b)
    vp, vn = mask ^ ((1 << edits) - 1), 0
    score = edits  # the matrix's value at the band's lowest row, and then at the last row
    for j in range(n):
        eq = 0
        for r in range(width):
            i = j - edits + r
            if 0 <= i < m and a[i] == b[j]:
                eq |= 1 << r
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        row = min(j + edits, m - 1)
        bit = row - (j - edits)
        if j + edits <= m - 1:
            score += 0 if d0 >> bit & 1 else 1
        else:
            score += (hp >> bit & 1) - (hn >> bit & 1)
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
        if score > edits + abs(m - n) + 2 * edits:
            return False
    return score <= edits


def within_many(a: list[str], b: list[str], edits):
    """within for many pairs at once (edits: one number for all, or one per pair): the same recurrence, a step for all pairs at a time."""
    import numpy as np

    edits = np.broadcast_to(edits, len(a))
    out = np.zeros(len(a), bool)
    size = np.array([[len(x) for x in a], [len(y) for y in b]]).reshape(2, -1)
    m, n = size.max(axis=0), size.min(axis=0)
    out[(m <= edits)] = True  # as many substitutions and insertions do
    left = (m > edits) & (m - n <= edits)
    for k in np.unique(edits[left]).tolist():
        at = np.flatnonzero(left & (edits == k))
        if 2 * k + 2 > 16 or len(at) < 32:  # wide bands, and few pairs
            out[at] = [within(a[i], b[i], k) for i in at]
            continue
        at = at[np.argsort(-n[at], kind="stable")]
        while len(at):
            step = max(1, min(4096, 2**20 // int(m[at[0]] + k + 1)))
            some, at = at[:step], at[step:]
            longer = [a[i] if len(a[i]) >= len(b[i]) else b[i] for i in some]
            shorter = [b[i] if len(a[i]) >= len(b[i]) else a[i] for i in some]
            out[some] = _chunk_within(longer, shorter, m[some], n[some], k)
    return out


def _columns(texts: list[str], sizes, before: int, after: int, fill: int):
    """Code points of some texts, a column each, between rows of a filler."""
    import numpy as np

    width = int(sizes.max(initial=0))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    held = np.full((len(texts), before + width + after), fill, np.uint32)
    held[:, before : before + width][np.arange(width) < sizes[:, None]] = points
    return held.T.copy()


def _chunk_within(longer, shorter, m, n, edits: int):
    """Pairs with longer texts of m > edits and shorter ones of n >= m - edits code points, n falling."""
    import numpy as np

    width = 2 * edits + 2
    mask = np.int32((1 << width) - 1)
    a = _columns(longer, m, edits, width + 1, 0xFFFFFFFF)
    b = _columns(shorter, n, 0, 0, 0xFFFFFFFE)
    out = np.zeros(len(m), bool)
    alive = np.arange(len(m))
    vp = np.full(len(m), mask ^ ((1 << edits) - 1), np.int32)
    vn = np.zeros(len(m), np.int32)
    score = np.full(len(m), edits, np.int32)
    last = m.astype(np.int32) - 1
    ends = n.copy()
    out[n == 0] = m[n == 0] <= edits
    shift = 0  # rows cut from a and b
    for j in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-ends, -j, side="left"))  # those with more than j columns stand first
        if live < len(alive) or (j % 16 == 15 and (score > 3 * edits).sum() * 4 > live):
            out[alive[live:]] |= score[live:] <= edits
            # all that is left of a pair is at least its score less the band's height
            keep = np.flatnonzero(score[:live] <= 3 * edits)
            if not len(keep):
                return out
            alive, vp, vn, score, last, ends = (x[keep] for x in (alive, vp, vn, score, last, ends))
            a, b, shift = a[j - shift :, keep], b[j - shift :, keep], j
        at = j - shift
        letter = b[at]
        eq = np.zeros(len(alive), np.int32)
        for r in range(width):
            eq |= (a[at + r] == letter).astype(np.int32) << r
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        inside = j + edits <= last
        bit = np.where(inside, 0, last - (j - edits))
        score += np.where(inside, 1 - (d0 >> (2 * edits) & 1), (hp >> bit & 1) - (hn >> bit & 1)).astype(np.int32)
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
    out[alive] |= score <= edits
    return out


def _cut(texts: list[str | None]):
    """Code points of some texts, one after the other, and of each line: text number, line number, start, length."""
    import numpy as np

    points = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
    breaks = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.concatenate([breaks, [len(points)]])
    per = np.array([(t or "").count("\n") + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), per)
    line = np.arange(len(starts)) - np.repeat(np.cumsum(per) - per, per)
    return points, text, line, starts, ends - starts


def line_hash(raw: bytes) -> int:
    """The first half of a line's hash, as hashes() gives it."""
    import xxhash

    h = xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(struct.pack("<i", 1), 42))
    return h - 2**64 if h >= 2**63 else h


def hashes(line: Column) -> tuple[Column, Column]:
    """Two differently seeded 64-bit halves of a line's hash."""
    return F.xxhash64(F.lit(1), line), F.xxhash64(F.lit(2), line)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line, h1, h2 of every line that takes part."""
    every = _texts(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).where(F.length("x") >= min_chars)
    h1, h2 = hashes(F.col("x"))
    return every.select("doc_id", "line", h1.alias("h1"), h2.alias("h2"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def keys_of(points, starts, lengths, edits: int):
    """(key, line) of every substring under which a line stands: its own segments', and those it may share with shorter lines'."""
    import numpy as np

    n = len(points)
    inverse = pow(_BASE, -1, 2**64)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
        back = np.concatenate([one, np.cumprod(np.full(n, inverse, np.uint64))])
        upto = np.concatenate([0 * one, np.cumsum(points.astype(np.uint64) * power[:n], dtype=np.uint64)])
        parts, keys, lines = edits + 1, [], []
        every = np.arange(len(starts))
        for gap in range(edits + 1):
            other = lengths - gap
            short, longer = other // parts, other % parts
            for i in range(parts):
                p = i * short + np.maximum(0, i - (parts - longer))
                size = short + (i >= parts - longer)
                lo = np.maximum(0, np.maximum(p - i, p + gap - (edits - i)))
                hi = np.minimum(lengths - size, np.minimum(p + i, p + gap + (edits - i)))
                salt = _mix((other.astype(np.uint64) * np.uint64(64) + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15))
                for step in range(2 * edits + 1):
                    s = lo + step
                    ok = (s <= hi) & (size > 0)
                    at = starts[ok] + s[ok]
                    h = (upto[at + size[ok]] - upto[at]) * back[at]
                    keys.append(_mix(h ^ salt[ok]))
                    lines.append(every[ok])
    return np.concatenate(keys), np.concatenate(lines)


def allowed(length, edits: int | None = BY_LENGTH):
    """The edits that a pair may differ by, from the shorter line's length (a number or an array)."""
    import numpy as np

    return np.minimum(length // BAND_CHARS, MOST_EDITS) if edits is BY_LENGTH else edits + 0 * length


def banded_keys_of(points, starts, lengths):
    """(key, line) of the substrings under which a line stands in its own band and in the one below."""
    import numpy as np

    n = len(points)
    inverse = pow(_BASE, -1, 2**64)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
        back = np.concatenate([one, np.cumprod(np.full(n, inverse, np.uint64))])
        upto = np.concatenate([0 * one, np.cumsum(points.astype(np.uint64) * power[:n], dtype=np.uint64)])
        keys, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for below in (0, 1):
            bands = lengths // BAND_CHARS - below
            limits = allowed(bands * BAND_CHARS)
            # the longest line of the band below must be near enough in length
            meets = (below == 0) | (lengths - (bands * BAND_CHARS + BAND_CHARS - 1) <= limits)
            for most in range(1, MOST_EDITS + 1):
                some = np.flatnonzero(meets & (limits == most))
                band, length, start = bands[some], lengths[some], starts[some]
                size = band * BAND_CHARS // (most + 1)
                for i in range(most + 1):
                    from_end = i > most // 2
                    moves = most - i if from_end else i
                    at = length - (most - i + 1) * size if from_end else i * size
                    salt = _mix((band.astype(np.uint64) * np.uint64(64) + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15))
                    for move in range(-moves, moves + 1):
                        s = at + move
                        ok = (s >= 0) & (s + size <= length)
                        a = start[ok] + s[ok]
                        h = (upto[a + size[ok]] - upto[a]) * back[a]
                        keys.append(_mix(h ^ salt[ok]))
                        lines.append(some[ok])
    return np.concatenate(keys), np.concatenate(lines)


def _keyed(docs: DataFrame, edits: int | None, min_chars: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo in range(0, len(texts), 512):
                some = texts[lo : lo + 512]
                points, _, _, starts, lengths = _cut(some)
                use = np.flatnonzero(lengths >= min_chars)
                if not len(use):
                    continue
                hashed = [line_hash(x.encode()) for t in some for x in t.split("\n") if len(x) >= min_chars]
                if len(seen) > _SEEN:
                    seen.clear()
                fresh = []  # copies within a task fold here
                for i, h in enumerate(hashed):
                    if h not in seen:
                        seen.add(h)
                        fresh.append(i)
                if not fresh:
                    continue
                use, h1 = use[fresh], np.array(hashed, np.int64)[fresh]
                key, line = banded_keys_of(points, starts[use], lengths[use]) if edits is BY_LENGTH else keys_of(points, starts[use], lengths[use], edits)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h1[line])], names=["key", "h1"])

    return _texts(docs).select("text").mapInArrow(run, "key long, h1 long")


def shared_keys(docs: DataFrame, edits: int | None = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, h1) of the keys under which two different lines stand, each once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last_key, last_h, alone = None, None, False  # the row before this batch, and whether it still waits for a second line
        for batch in batches:
            key, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            same_key = np.empty(len(key), bool)
            same_key[1:] = key[1:] == key[:-1]
            same_key[0] = last_key is not None and key[0] == last_key
            fresh = np.empty(len(key), bool)  # a line that its key hasn't had
            fresh[1:] = ~same_key[1:] | (h[1:] != h[:-1])
            fresh[0] = not same_key[0] or h[0] != last_h
            k, v, s = key[fresh], h[fresh], same_key[fresh]
            if last_key is not None and len(k) and s[0] and alone:
                k, v, s = np.concatenate([[last_key], k]), np.concatenate([[last_h], v]), np.concatenate([[False], s])
            if len(k):
                more = np.append(k[1:] == k[:-1], False)
                out = s | more
                alone = not out[-1]
                if out.any():
                    yield pa.RecordBatch.from_arrays([pa.array(k[out].astype(np.int64)), pa.array(v[out].astype(np.int64))], names=["key", "h1"])
            last_key, last_h = key[-1], h[-1]

    dealt = _keyed(docs, edits, min_chars).repartition("key").sortWithinPartitions("key", "h1")
    return dealt.mapInArrow(run, "key long, h1 long")


def _near_pairs(dealt: DataFrame, lines: DataFrame, edits: int | None) -> DataFrame:
    """(id, pivot) of the lines that are near their pivot."""
    keys = ["pivot", "blk"]
    held = dealt.hint("merge").join(lines, "id").select(*keys, "head", "id", "text")
    held = held.repartition(*keys).sortWithinPartitions(*keys, F.desc("head"), "id")

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in grouped_batches(batches, keys):
            ids, head, text, pivot = (pdf[c].to_numpy() for c in ("id", "head", "text", "pivot"))
            lo = np.repeat(*np.array([(a, b - a) for a, b in group_bounds(pdf, keys)]).T)  # where each row's head stands
            some = np.flatnonzero(~head.astype(bool))
            size = np.array([len(x) for x in text])
            hit = some[within_many(text[some].tolist(), text[lo[some]].tolist(), allowed(np.minimum(size[some], size[lo[some]]), edits))]
            yield pd.DataFrame({"id": ids[hit], "pivot": pivot[hit]})

    return held.mapInPandas(run, "id long, pivot long")


def _near_rest(dealt: DataFrame, lines: DataFrame, edits: int | None) -> DataFrame:
    """Near lines of each pair of blocks as a forest of edges (a, b)."""
    keys = ["key", "bi", "bj"]
    held = dealt.hint("merge").join(lines, "id").select(*keys, "blk", "id", "text")
    held = held.repartition(*keys).sortWithinPartitions(*keys, "id")

    def run(batches):
        import numpy as np
        import pandas as pd

        def profile(t: str):
            return np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, minlength=64).astype(np.int16)

        for pdf in grouped_batches(batches, keys):
            ids, text, blk = pdf["id"].to_numpy(), pdf["text"].to_numpy(), pdf["blk"].to_numpy()
            bi, bj = pdf["bi"].to_numpy(), pdf["bj"].to_numpy()
            size = np.array([len(t) for t in text])
            bags = np.stack([profile(t) for t in text])
            names, node = np.unique(ids, return_inverse=True)
            forest = Forest(len(names))
            waiting: list = []  # pairs of rows that lengths and bags don't tell apart, of all groups of the frame

            def settle(least: int, ids=ids, text=text, size=size, node=node, forest=forest, waiting=waiting):
                if sum(map(len, waiting)) <= least:
                    return
                pairs = np.concatenate(waiting)
                waiting.clear()
                # a pair that meets in several groups is compared once
                pairs = pairs[np.unique(np.sort(node[pairs], axis=1), axis=0, return_index=True)[1]]
                x, y = pairs.T
                for r, c in pairs[within_many(text[x].tolist(), text[y].tolist(), allowed(np.minimum(size[x], size[y]), edits))].tolist():
                    forest.join(node[r], node[c])

            for lo, hi in group_bounds(pdf, keys):
                at = lo + np.unique(ids[lo:hi], return_index=True)[1]  # rows that repeat a doc_id give a line more than once
                if len(at) < 2:
                    continue
                one = blk[at] == bi[lo]
                x, y = (at, at) if bi[lo] == bj[lo] else (at[one], at[~one])
                for a in range(0, len(x), 64):
                    rows, cols = np.nonzero(np.abs(size[x[a : a + 64]][:, None] - size[y][None]) <= allowed(np.minimum(size[x[a : a + 64]][:, None], size[y][None]), edits))
                    r, c = x[a + rows], y[cols]
                    if x is y:
                        r, c = r[r < c], c[r < c]
                    # an edit changes two of a bag's counts by one at most
                    near = np.abs(bags[r] - bags[c]).sum(axis=1) <= 2 * allowed(np.minimum(size[r], size[c]), edits)
                    if near.any():
                        waiting.append(np.stack([r[near], c[near]], axis=1))
                        settle(16384)
            settle(0)
            out = [(int(names[i]), int(names[forest.find(i)])) for i in range(len(names)) if forest.find(i) != i]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return held.mapInPandas(run, "a long, b long")


def _fetch(docs: DataFrame, places: DataFrame) -> DataFrame:
    """places (id, doc_id, line, h1, h2): (id, text) of the lines there that have these hashes."""
    at = F.struct("line", "id", "h1", "h2")
    by_doc = stored(places.groupBy(F.col("doc_id").alias("at_id")).agg(F.collect_list(at).alias("p")), "line-places")
    t = _texts(docs)
    some = t.join(by_doc.hint("merge"), t["doc_id"] == by_doc["at_id"])
    held = let(F.split("text", "\n"), lambda x: F.transform("p", lambda s: F.struct(s["id"].alias("id"), F.get(x, s["line"]).alias("text"), s["h1"].alias("h1"), s["h2"].alias("h2"))))
    found = some.select(F.explode(held).alias("s")).select("s.*")
    # of rows that repeat a doc_id, others may hold another line at that number
    h1, h2 = hashes(F.col("text"))
    return found.where(F.col("text").isNotNull() & (h1 == F.col("h1")) & (h2 == F.col("h2"))).select("id", "text")


def duplicates(docs: DataFrame, edits: int | None = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines that go: doc_id, line, h1, h2 (the line's hash), near (whether the line that stays differs from it)."""
    occ = stored(occurrences(docs, min_chars), "lines")
    multi = stored(shared_keys(docs, edits, min_chars), "line-keys")
    classes = occ.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first"))
    # one id per class: 64 bits of the hash aren't enough for that
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")
    wanted = stored(classes.join(multi.select("h1").distinct(), "h1", "left_semi").select("id", "first.doc_id", "first.line", "h1", "h2"), "line-wanted")
    members = stored(multi.hint("merge").join(wanted.select("h1", "id"), "h1").select("key", "id"), "line-members")
    lines = stored(_fetch(docs, wanted), "line-texts")
    components = star_components(members, "lines", lambda d: _near_pairs(d, lines, edits), lambda d: _near_rest(d, lines, edits))
    joined = classes.join(components.withColumnRenamed("node", "id"), "id", "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    joined = stored(joined.withColumn("component", F.coalesce("component", "id")), "line-dups")
    stays = joined.groupBy("component").agg(F.min("first").alias("stay"), F.count("*").alias("n"))
    per_line = join_groups(joined.withColumnRenamed("n", "copies"), stays, ["component"], joined.count()).select("h1", "h2", F.col("copies").alias("n"), "first", "stay")
    per_line = stored(per_line, "line-stays")
    gone = join_groups(occ, per_line, ["h1", "h2"], occ.count()).where((F.col("doc_id") != F.col("stay.doc_id")) | (F.col("line") != F.col("stay.line")))
    return gone.select("doc_id", "line", "h1", "h2", (F.col("first") != F.col("stay")).alias("near"))


def deduplicate(docs: DataFrame, edits: int | None = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with cleaned text, as a struct column doc, and n_lines, gone_exact, gone_near."""
    gone = duplicates(docs, edits, min_chars).groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set(F.struct("line", "h1", "h2", "near")).alias("gone"))
    gone = stored(gone, "line-gone")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].cast("long").alias("held_id"))
    # one way at every size: the list grows with the table, so it is never broadcast
    both = held.join(gone.hint("merge"), held["held_id"] == gone["gone_id"], "left")
    text = F.col("doc.text")

    def own(s: Column, x: Column) -> Column:
        h1, h2 = hashes(F.get(x, s["line"]))
        return (h1 == s["h1"]) & (h2 == s["h2"])

    def cut(x: Column, g: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.array_size(x) - 1), F.transform(g, lambda s: s["line"]))
        near = F.array_size(F.filter(g, lambda s: s["near"]))
        kept = F.when(F.array_size(g) > 0, F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")).otherwise(text)
        return F.struct(kept.alias("text"), F.array_size(x).alias("n_lines"), (F.array_size(g) - near).alias("exact"), near.alias("near"))

    # of rows that repeat a doc_id, only those that hold the line lose it
    gone_here = F.coalesce("gone", F.array().cast("array<struct<line:int,h1:bigint,h2:bigint,near:boolean>>"))
    both = both.select("doc", F.when(text.isNotNull(), let(F.split(text, "\n"), lambda x: let(F.filter(gone_here, lambda s: own(s, x)), lambda g: cut(x, g)))).alias("cut"))
    return both.select(
        F.struct(*[(F.col("cut.text") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns]).alias("doc"),
        F.coalesce("cut.n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("cut.exact", F.lit(0)).cast("long").alias("gone_exact"),
        F.coalesce("cut.near", F.lit(0)).cast("long").alias("gone_near"),
    )


def cleaned(docs: DataFrame, edits: int | None = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without repeated lines; a document that loses all of its text goes, one that had none stays."""
    out = deduplicate(docs, edits, min_chars)
    lost = (F.col("gone_exact") + F.col("gone_near") > 0) & (F.trim(F.col("doc.text")) == "")
    return out.where(~F.coalesce(lost, F.lit(False))).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
