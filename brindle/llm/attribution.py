"""Token counts by offset-mapped attribution.

A document is encoded once as a whole. Its ids' byte widths give each token's span; the sections'
spans are joined with them by binary search on the sorted starts (an interval join of two sorted
lists). A token that crosses a boundary is allocated by rule: "start" gives it to the section that
holds its first byte, "end" to the one with its last byte, "most" to the one with most of its bytes
(ties to the earlier one). Each token is counted exactly once.

A section is a line with its line feed, so that sections tile the text. Cases: null or empty text
has one empty section and no tokens; repeated rows are counted once each; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.llm.tokens import default_path, tokenizer

RULES = ("start", "end", "most")
SECTIONS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def line_sections(raw: bytes):
    """Byte starts of the lines of a text."""
    import numpy as np

    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(raw)]]).astype(np.int64)


def attribute(width, starts, n_bytes: int, rule: str = "start"):
    """Tokens per section and, of those, the ones that cross a boundary.

    width: bytes of each token; starts: sorted byte starts of the sections that tile the text.
    """
    import numpy as np

    end = np.cumsum(width)
    first = end - width
    last = np.maximum(end - 1, first)
    lo = np.searchsorted(starts, first, side="right") - 1
    hi = np.searchsorted(starts, last, side="right") - 1
    crossing = hi > lo
    to = hi.copy() if rule == "end" else lo.copy()
    if rule == "most":
        stops = np.append(starts[1:], n_bytes)
        for t in np.flatnonzero(crossing):
            s = np.arange(lo[t], hi[t] + 1)
            held = np.minimum(stops[s], end[t]) - np.maximum(starts[s], first[t])
            to[t] = s[int(held.argmax())]
    return np.bincount(to, minlength=len(starts)), np.bincount(to[crossing], minlength=len(starts))


def token_counts(docs: DataFrame, path: str | None = None, rule: str = "start") -> DataFrame:
    """One row per document and line: character span (start, end), tokens allocated to it, how many of those cross a boundary, and the document's tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or default_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = tokenizer(path)
        names = [f.split()[0] for f in SECTIONS.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                doc_ids: list = []
                cols: list[list] = [[] for _ in names[1:]]
                for doc, text in zip(ids[lo : lo + 256], texts.slice(lo, 256).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    starts = line_sections(raw)
                    width = bpe.width[bpe.ids(text or "")]
                    count, crossing = attribute(width, starts, len(raw), rule)
                    chars = starts
                    total = len(raw)
                    if len(raw) != len(text or ""):  # characters before each byte
                        lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        chars, total = lead[starts], int(lead[-1])
                    k = len(starts)
                    doc_ids.append(pa.nulls(k, pa.int64()) if doc is None else pa.array(np.full(k, doc, np.int64)))
                    for col, v in zip(cols, (np.arange(k), chars, np.append(chars[1:], total), count, crossing, np.full(k, len(width))), strict=True):
                        col.append(v)
                out = [pa.concat_arrays(doc_ids), pa.array(np.concatenate(cols[0]).astype(np.int32)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SECTIONS)
