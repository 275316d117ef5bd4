"""The as-of join, the token files and the importance resampling against plain statements of their rules."""

import hashlib
import math
import random
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("brindle.llm")

from brindle.llm import asof, resample, tokenfiles, tokens  # noqa: E402

DAY = asof.DAY
START = datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, at string, value string, key string"
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, slice string, bucket string"


def micros(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def crc(n):
    return zlib.crc32(str(n).encode())


def plain_last_orders(clicks, sales):
    """One pass per click over all of its client's orders."""
    orders = []
    for sid, client, total, sold, priority, *_ in sales:
        if client is None or sold is None:
            continue
        at = micros(sold)
        at -= at % DAY if sid is not None and crc(sid) % 2 else 0
        cents = math.floor(100 * total + 0.5) if total is not None and math.isfinite(total) else None
        orders.append((client, at, sid, priority, cents))
        if sid is not None and crc(sid) % 3:
            orders.append((client, at, -1 - sid, None if priority is None else 6 - priority, cents))
    low = -(10**30)
    out = {}
    for cid, ts, client, *_ in clicks:
        if cid is None or cid in out:
            continue
        at = None if ts is None else micros(ts) - (micros(ts) % DAY if crc(cid) % 2 else 0)
        near = [o for o in orders if at is not None and o[0] == client and o[1] <= at <= o[1] + 3 * DAY]
        last = [o for o in near if o[1] == max(x[1] for x in near)]
        best = max(last, key=lambda o: (low if o[3] is None else o[3], low if o[2] is None else -o[2], low if o[4] is None else o[4]), default=None)
        out[cid] = (cid, client, at, *((best[2], at - best[1], best[4], len(last)) if best else (None, None, None, 0)))
    return sorted(out.values())


def shop(seed, n_clicks, n_sales, clients, seconds):
    r = random.Random(seed)
    who = lambda: r.choice([7, 7, 7, None, *range(clients)])
    when = lambda: r.choice([None] + 30 * [START + timedelta(seconds=r.randrange(seconds), microseconds=r.choice([0, 1, 999_999]))])
    sales = [(i, who(), r.choice([None, float("nan"), round(r.uniform(0, 99), 2)]), when(), r.choice([None, 1, 3, 5]), "clash", "clash") for i in range(n_sales)]
    sales += [*sales[:9], (None, 7, 1.0, START, 3, "clash", "clash")]
    clicks = [(i, when(), who(), "clash", "clash", "clash") for i in range(n_clicks)]
    return clicks + clicks[:20], sales


@pytest.mark.parametrize(("seed", "n", "clients", "seconds"), [(1, 300, 4, 20 * 86400), (2, 400, 1, 5 * 86400), (3, 500, 1, 900), (4, 60, 9, 200 * 86400)])
def test_last_orders(spark, monkeypatch, seed, n, clients, seconds):
    """With limits so small that buckets are sliced and slices salted."""
    monkeypatch.setattr(asof, "LARGE", 4)
    clicks, sales = shop(seed, n, n, clients, seconds)
    got = asof.last_orders(spark.createDataFrame(clicks, CLICKS).repartition(3), spark.createDataFrame(sales, SALES).repartition(3))
    assert got.columns == ["click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied"]
    assert sorted(tuple(r) for r in got.collect()) == plain_last_orders(clicks, sales)


def test_last_orders_of_empty_tables(spark):
    clicks, sales = shop(5, 10, 10, 2, 86400)
    none = [spark.createDataFrame([], CLICKS), spark.createDataFrame([], SALES)]
    assert asof.last_orders(none[0], spark.createDataFrame(sales, SALES)).count() == 0
    got = asof.last_orders(spark.createDataFrame(clicks, CLICKS), none[1]).collect()
    assert len(got) == 10 and {(r["sale_id"], r["n_tied"]) for r in got} == {(None, 0)}


def test_as_of_any_key_and_bounds(spark):
    """The tolerance counts to the microsecond; keys may be text, times may lie before 1970."""
    points = spark.createDataFrame([("a", -5, 1), ("a", 100, 2), ("a", 101, 3), ("b", 0, 4), ("a", -6, 5)], "key string, at long, id int")
    events = spark.createDataFrame([("a", -5, 1), ("a", -5, 3), ("a", 50, 2)], "key string, at long, value int")
    got = asof.as_of(points, events, tolerance=50, width=7).select("id", "match.at", "match.value", "match.n_tied").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {1: (-5, 3, 2), 2: (50, 2, 1), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}


def test_times_without_a_zone(spark):
    df = spark.createDataFrame([(START + timedelta(microseconds=k),) for k in (0, 1, 86_399_999_999, -1)], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r[0] - micros(START) for r in df.select(asof.micros(df, "t")).collect()] == [0, 1, 86_399_999_999, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ranks_do_not_meet_in_one_task(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("score"), F.col("id").alias("doc_id"))
    got, n = resample.ranked(df, [F.desc("score"), F.col("doc_id")], "t")
    want = sorted(((-(i % 3), i) for i in range(1000)))
    assert n == 1000 and [(r["score"], r["doc_id"]) for r in got.orderBy("rank").collect()] == [(-a, b) for a, b in want]
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, 1001))


TEXT = "doc_id long, text string, n_words string, rank string"


def odd_texts(r, n):
    alphabet = ["a", "B", "Zoë", "日本", "x1", "ÀÉ", "w" * 90, "v" * 4097, "the", "of"]
    texts = [r.choice([" ", ", ", "\n", "-"]).join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 19, 20, 60]))) for _ in range(n)]
    return [*texts, None, "", "...", "one two " * 3000]


def plain_words(t):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]


def plain_features(t):
    w = plain_words(t)
    return w + [a + b" " + b for a, b in zip(w, w[1:])]


def test_resampling(spark):
    r = random.Random(3)
    docs = [(i, t, "clash", "clash") for i, t in enumerate(odd_texts(r, 80))]
    docs += [docs[3], docs[3], (None, "a b c " * 20, "clash", "clash")]
    target = [(i, t) for i, t in enumerate(odd_texts(r, 5))]
    size, runs = 50, 2
    s, t = np.zeros(size), np.zeros(size)
    for counts, rows in ((s, docs), (t, target)):
        for row in rows:
            for f in plain_features(row[1]):
                counts[zlib.crc32(f) % size] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + size) / ((s[b] + 1) * (t.sum() + size)))) for b in range(size)]
    want = []
    for i, text, *_ in docs:
        f = plain_features(text)
        weight = sum(gain[zlib.crc32(x) % size] for x in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))))
    able = sorted((w for w in want if w[4] >= 20 and w[0] is not None), key=lambda w: (-w[3], w[0]))
    ranks = {}
    for k, w in enumerate(able[: 25 * len(able) // 100]):
        ranks.setdefault(w[:4], []).append(k + 1)
    frame = spark.createDataFrame(docs, TEXT).repartition(3)
    got = resample.resample(frame, spark.createDataFrame(target, "item_id long, text string"), buckets=size, runs=runs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [tuple(x) for x in got.collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((x[:4] for x in rows), key=key) == sorted((w[:4] for w in want), key=key)
    assert sorted(x[4] for x in rows if x[4]) == list(range(1, 25 * len(able) // 100 + 1))
    assert all(x[4] in ranks.get(x[:4], []) for x in rows if x[4])


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], TEXT), spark.createDataFrame([(1, "a b " * 40, "", "")], TEXT)
    target = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, target).count() == 0
    assert resample.resample(some, target).first()["rank"] is None  # a quarter of one document is none


def test_checksums_of_joined_parts():
    r = random.Random(4)
    parts = [(r.randbytes(r.randrange(9)), r.randbytes(r.choice([0, 1, 2, 63, 64, 65, 200, 5000]))) for _ in range(300)]
    a, b = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    assert resample.joined_crc(a, b, np.array([len(p[1]) for p in parts])).tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_longer_runs():
    texts = ["a b c d e", "", "x", "a b"]
    n, starts, cells, counts = resample.block_of(texts, 97, 3)
    for i, t in enumerate(texts):
        w = t.encode().split()
        want: dict = {}
        for k in (1, 2, 3):
            for j in range(len(w) - k + 1):
                b = zlib.crc32(b" ".join(w[j : j + k])) % 97
                want[b] = want.get(b, 0) + 1
        assert dict(zip(cells[starts[i] : starts[i + 1]].tolist(), counts[starts[i] : starts[i + 1]].tolist(), strict=True)) == want and n[i] == len(w)


def test_token_files(spark, tmp_path):
    r = random.Random(5)
    docs = [(i * 7 % 101, t, "", "") for i, t in enumerate(odd_texts(r, 90))] + [(3, "again", "", ""), (3, "again", "", ""), (3, None, "", ""), (None, "no id <|endoftext|>", "", ""), (500, "long " * 60_000, "", "")]
    frame = spark.createDataFrame(docs, TEXT).repartition(4)
    root = str(tmp_path / "tokens")
    shards = tokenfiles.write(frame, root)
    got = [tuple(x) for x in tokenfiles.read(spark, root).orderBy("start").collect()]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    want = sorted((d[0] is not None, d[0] or 0, zlib.crc32(np.array(ids(d[1]), "<u4").tobytes()), len(ids(d[1]))) for d in docs)
    assert sorted((d is not None, d or 0, c, n) for d, _, n, c in got) == want
    assert [(d is not None, d or 0) for d, *_ in got] == [w[:2] for w in want], "in order of doc_id, null first"
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert at == sum(s["ids"] for s in shards)
    # the whole corpus from mapped files, without Spark
    flat = np.concatenate([tokenfiles.Shard(root, s["shard"], s["width"]).ids(s["base"], s["base"] + s["ids"]) for s in tokenfiles.shards_of(root)])
    assert flat.dtype == np.uint16 and zlib.crc32(flat[: got[0][2]].astype("<u4").tobytes()) == got[0][3]
    assert isinstance(tokenfiles.Shard(root, shards[0]["shard"], 2).all_ids, np.memmap)
    assert not [f for f in (tmp_path / "tokens").iterdir() if f.suffix not in (".bin", ".idx", ".json")], "nothing half written is left"


def test_token_files_again_and_wider(spark, tmp_path):
    """A second write gives the same files; end ids beyond 16 bits make wider ones; empty tables make no shard."""
    frame = spark.createDataFrame([(i, f"text {i}", "", "") for i in range(20)], TEXT).repartition(2)
    root = str(tmp_path / "a")
    assert tokenfiles.write(frame, root) == tokenfiles.write(frame, root)
    assert tokenfiles.write(frame, str(tmp_path / "b"), end_id=70_000)[0]["width"] == 4
    assert tokenfiles.read(spark, str(tmp_path / "b")).select(F.sum("n_tokens")).first() == tokenfiles.read(spark, root).select(F.sum("n_tokens")).first()
    none = spark.createDataFrame([], TEXT)
    assert tokenfiles.round_trip(none).count() == 0


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.7, 1.2, -0.0, 0.0, None]), ("string", ["a", "b", "a", "", "", None]), ("int", [1, 2, 1, 0, 0, None]), ("decimal(9,2)", ["1.20", "1.70", "1.20", "0.00", "0.00", None]), ("boolean", [True, False, True, None, None, None]), ("array<string>", [["a,b"], ["a", "b"], ["a,b"], [], [], None])])
def test_near_vectors_with_labels_of_any_type(spark, kind, labels):
    """Labels are compared as they are: 1.2 is not 1.7, zeros of either sign are one, null is like nothing."""
    from decimal import Decimal

    from brindle.llm import vectordup

    values = [Decimal(x) if x is not None and kind.startswith("dec") else x for x in labels]
    got = vectordup.links(spark.createDataFrame([(i, x, [1.0, 0.5]) for i, x in enumerate(values)], f"vec_id long, label {kind}, embedding array<float>")).collect()
    want = {0: (1, 0), 1: (0, 1), 2: (1, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5)} if kind != "boolean" else {0: (1, 0), 1: (0, 1), 2: (1, 0), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_empty_tables(spark):
    from brindle.llm import ann, attribution, vectordup

    vectors = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vectordup.links(vectors).count() == 0
    assert ann.search(vectors, F.col("id") % 50 == 0).count() == 0
    assert attribution.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
