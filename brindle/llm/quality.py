"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows of the labels table with quality 1; unlabelled text is any document. The
non-negative risk  pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])  is minimised by gradient steps
with the logistic loss; where the second part turns negative its gradient is reversed, as published
with the estimator. The class prior pi is estimated from positives and unlabelled text alone, as the
share of unlabelled text that the positives can account for: a classifier of positives against
unlabelled rows is fitted on half of the sample, and on the other half the best bin of its scores
bounds the share from above (see mixture_share). No row of quality 0 is read.

A text is described by statistics of its whole length (character classes, words, lines,
repetition), each cut into quantile bins; the score is a logistic function of a weight per bin.
Training reads at most SAMPLE positives and SAMPLE unlabelled rows, those with the smallest seeded
hashes; everything is scored. Rows with crc32(doc_id as text) mod 3 = 1 are held out of training.

Cases: null text counts as empty; an empty text is scored like any other; without positives or
documents to learn from every score is 0.5; rows that repeat a doc_id are
each scored; null doc_ids are scored and learned from by none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000
BINS = 12
STEPS = 1500
RATE = 0.05
DECAY = 1e-5
SEED = 3


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)).cast("int"), F.lit(1))


def _classes():
    import numpy as np

    t = np.zeros(256, np.uint8)  # 0: control and others
    t[ord("a") : ord("z") + 1] = 1
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("0") : ord("9") + 1] = 3
    t[[9, 10, 11, 12, 13, 32]] = 4
    t[[ord(c) for c in ".,;:'\"?-()"]] = 5
    for b in range(33, 127):
        if t[b] == 0:
            t[b] = 6
    t[128:192] = 7  # continuation bytes
    t[192:] = 8
    return t


_TABLE = None


def features(text: str | None):
    """Statistics of one whole text."""
    import numpy as np

    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    raw = (text or "").encode()
    b = np.frombuffer(raw, np.uint8)
    n = np.bincount(_TABLE[b], minlength=9).astype(float)
    chars = max(1.0, len(b) - n[7])
    letters = max(1.0, n[1] + n[2] + n[8])
    words = raw.split()
    k = max(1, len(words))
    low = raw.lower().split()
    distinct = len(set(low))
    pairs = len(set(zip(low, low[1:], strict=False)))
    lines = raw.split(b"\n")
    full = [x for x in lines if x]
    ends = sum(w[-1] in b"!#$%&*+/<=>@\\^_`|~" for w in words)
    bare = sum(len(w) == 1 and not (65 <= w[0] <= 90 or 97 <= w[0] <= 122 or w[0] >= 128) for w in words)
    capital = sum(65 <= w[0] <= 90 for w in words)
    same = sum(x == y for x, y in zip(low, low[1:], strict=False))
    return np.array(
        [
            np.log1p(len(words)),
            len(raw) / k,
            n[2] / letters,
            n[3] / chars,
            n[4] / chars,
            n[5] / chars,
            n[6] / chars,
            n[8] / chars,
            distinct / k**0.8,
            pairs / k,
            same / k,
            len(set(full)) / max(1, len(full)),
            np.log1p(len(words) / max(1, len(full))),
            ends / k,
            bare / k,
            capital / k,
            sum(w[-1] in b".!?" for w in words) / k,
            max((len(w) for w in words), default=0) ** 0.5,
            n[0] / chars,
        ]
    )


class Model:
    """Quantile bins and a weight for each; picklable."""

    def __init__(self, edges, weights, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def binned(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x):
        import numpy as np

        if not len(x):
            return np.zeros(0)
        g = np.full(len(x), self.bias)
        if self.edges is not None:
            at = self.binned(x)
            for j in range(at.shape[1]):
                g = g + self.weights[j, at[:, j]]
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _binned(positive, unlabelled) -> tuple[Model, object, object]:
    """A model without weights, and the places of each row's bins among all weights."""
    import numpy as np

    both = np.concatenate([positive, unlabelled])
    qs = np.linspace(0, 1, BINS + 1)[1:-1]
    # rare values lie at the ends: finer bins there
    qs = np.unique(np.concatenate([qs, [0.005, 0.01, 0.02, 0.04, 0.96, 0.98, 0.99, 0.995]]))
    edges = [np.unique(np.quantile(both[:, j], qs)) for j in range(both.shape[1])]
    f, width = both.shape[1], max(len(e) for e in edges) + 1
    model = Model(edges, np.zeros((f, width)), 0.0)
    at = model.binned(both) + np.arange(f) * width
    return model, at[: len(positive)], at[len(positive) :]


def _minimise(model: Model, p, u, bias: float, steps: int, slopes: Callable) -> Model:
    """Full-batch Adam steps; slopes(positives' scores, unlabelled ones', spread) gives a gradient."""
    import numpy as np

    f, width = model.weights.shape
    w = np.zeros(f * width + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)

    def spread(rows, slope):
        out = np.bincount(rows.ravel(), weights=np.repeat(slope, f), minlength=f * width + 1)
        out[-1] = slope.sum()
        return out

    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-(w[rows].sum(axis=1) + w[-1]))) for rows in (p, u))
        grad = slopes(sp, su, spread)
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = w[:-1].reshape(f, width), float(w[-1])
    return model


def fit(positive, unlabelled, prior: float, steps: int = STEPS) -> Model:
    """Minimises the non-negative risk."""
    import numpy as np

    prior = float(np.clip(prior, 0.01, 0.99))
    start = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(None, None, start)
    model, p, u = _binned(positive, unlabelled)

    def slopes(sp, su, spread):
        loss_u = -np.log(np.maximum(1 - su, 1e-12)).mean()
        loss_p_as_n = -np.log(np.maximum(1 - sp, 1e-12)).mean()
        grad_negative = spread(u, su / len(u)) - prior * spread(p, sp / len(p))
        if loss_u - prior * loss_p_as_n >= 0:
            return prior * spread(p, (sp - 1) / len(p)) + grad_negative
        return -grad_negative

    return _minimise(model, p, u, start, steps, slopes)


def mixture_share(positive, unlabelled, steps: int = 300, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled rows, by best-bin estimation.

    Of unlabelled rows, at least pi q_p(t) score t or more, where q_p(t) is the share of positives that
    do: so q_u(t) / q_p(t) bounds pi from above at every t. The bound is taken where it is smallest
    once sampling errors (at confidence 1 - delta) are added, on rows that the scores weren't fitted on.
    """
    import numpy as np

    (pa, pb), (ua, ub) = ((x[::2], x[1::2]) for x in (positive, unlabelled))
    if not len(pb) or not len(ub):
        return 0.5
    model, p, u = _binned(pa, ua)
    model = _minimise(model, p, u, 0.0, steps, lambda sp, su, spread: spread(p, (sp - 1) / len(p)) + spread(u, su / len(u)))
    sp, su = np.sort(model.score(pb)), np.sort(model.score(ub))
    cuts = np.unique(sp)
    q_p, q_u = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    error = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(su))) + np.sqrt(np.log(4 / delta) / (2 * len(sp))))
    best = int(((q_u + error) / q_p).argmin())
    return float(min(1.0, q_u[best] / q_p[best]))


def _featured(df: DataFrame) -> DataFrame:
    """df (kind, text): their features."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            if x:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.stack(x)), pa.list_(pa.float64()))], names=["kind", "x"])

    return df.select("kind", "text").mapInArrow(run, "kind int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """Learns from bounded samples of the training folds."""
    import numpy as np

    known = labels.where((fold(labels["doc_id"]) != 1) & labels["quality"].isNotNull()).select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality"))
    at = F.xxhash64("doc_id", F.lit(SEED))
    p = known.where("quality = 1").select("doc_id").distinct().orderBy(at, "doc_id").limit(sample_rows).select("doc_id", F.lit(1).alias("kind"))
    u = docs.where(fold(docs["doc_id"]) != 1).select(docs["doc_id"].alias("doc_id")).orderBy(at, "doc_id").limit(sample_rows).distinct().select("doc_id", F.lit(0).alias("kind"))
    wanted = [(r["doc_id"], r["kind"]) for r in p.union(u).collect()]  # 2 * sample_rows ids at most
    if not wanted:
        return Model(None, None, 0.0)
    ids = docs.sparkSession.createDataFrame(wanted, "id long, kind int")
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = _featured(texts.join(F.broadcast(ids), texts["doc_id"] == ids["id"])).collect()
    x = {k: np.array([r["x"] for r in rows if r["kind"] == k]) for k in (0, 1)}
    if not len(x[1]) or not len(x[0]):
        return Model(None, None, 0.0)
    return fit(x[1], x[0], mixture_share(x[1], x[0]))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([features(t) for t in batch.column(2).to_pylist()])
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = (fold(docs["doc_id"]) == 1) & docs["doc_id"].isNotNull()
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were."""
    model = train(docs, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                s = shared.value.score(np.stack([features(t) for t in batch.column(at).to_pylist()]))
                yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
