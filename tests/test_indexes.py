"""The stored indexes against brute force, through insertions, replacements and deletions; runs that build them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import config as C, providers
from brindle.operators import dense_index, retrieve, sparse_index
from brindle.plans import jobs
from brindle.sources import sinks
from brindle.sources.store import Store


def best(rows, k):
    """rows {id: score}: the k best, ties by id."""
    return sorted(((-round(s, 10), i) for i, s in rows.items()))[:k]


def test_sparse_index(spark, tmp_path):
    r = random.Random(1)
    kind = "id string, terms array<int>, values array<double>"

    def vector():
        # few frequent terms, many rare ones
        found = {min(int(r.paretovariate(0.4)), 3000): float(r.randrange(1, 9)) for _ in range(12)}
        return list(found), list(found.values())

    held = {f"d{i:04}": vector() for i in range(1500)}
    s = Store(spark, str(tmp_path))

    def frame(rows):
        return spark.createDataFrame([(i, *v) for i, v in rows.items()], kind)

    with s.commit() as c:
        assert sparse_index.add(s, c, frame(held)) == 1500
    asked = {q: dict(zip(*vector())) for q in range(8)} | {8: {99_999: 1.0}, 9: {1: 1.0}}
    weights = spark.createDataFrame([(q, t, w) for q, v in asked.items() for t, w in v.items()], "qid int, term int, w double")

    def check(k):
        got = {}
        for x in sparse_index.top_k(s, weights, k, scope=k == 5).orderBy("qid", "rank").collect():
            got.setdefault(x.qid, []).append((-x.score, x.id))
        want = {}
        for q, v in asked.items():
            scores = {i: sum(v[t] * x for t, x in zip(terms, values) if t in v) for i, (terms, values) in held.items() if set(v) & set(terms)}
            if scores:
                want[q] = best(scores, k)
        assert got == want
        df = {x.term: x.df for x in sparse_index.statistics(s).collect()}
        assert df.pop(None) == len(held)
        count = {}
        for terms, _ in held.values():
            for t in terms:
                count[t] = count.get(t, 0) + 1
        assert df == count

    check(10)
    new = {f"d{i:04}": vector() for i in range(1490, 1600)}
    with s.commit() as c:
        assert sparse_index.add(s, c, frame(new)) == 110
    held |= new
    gone = [f"d{i:04}" for i in range(0, 1500, 50)]
    with s.commit() as c:
        assert sparse_index.remove(s, c, spark.createDataFrame([(g,) for g in [*gone, "never"]], "id string")) == len(gone)
    held = {i: v for i, v in held.items() if i not in gone}
    check(5)
    # a rare term decides: shards that have only the frequent one stay closed
    rare = next(t for t in sorted({t for v in held.values() for t in v[0]}) if sum(t in v[0] for v in held.values()) in (3, 4))
    told = sparse_index.opened(s, spark.createDataFrame([(0, 1, 0.1), (0, rare, 10.0)], weights.schema), 3, first=3).first()
    assert told.opened < 0.7 * told.blocks
    assert sparse_index.rebuild(s, 0.5) is False and sparse_index.rebuild(s) and s.read("dead") is None and s.head()["marks"]["shards"] == -(-len(held) // sparse_index.SHARD)
    check(10)
    plan = sparse_index.top_k(s, weights, 5)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "/vectors/" not in plan


def test_dense_index(spark, tmp_path):
    """Recall against brute force after inserts, replacements and deletes; filters inside the search; all lists are exact."""
    g = np.random.default_rng(2)
    centres = g.normal(size=(40, 24))

    def some(n, first):
        return {first + i: (centres[g.integers(40)] + 0.6 * g.normal(size=24)).tolist() for i in range(n)}

    held = some(3000, 0)
    s = Store(spark, str(tmp_path))
    frame = lambda rows: spark.createDataFrame([(i, v, f"doc{i % 3}") for i, v in rows.items()], "id long, vec array<double>, doc_id string")
    odd = spark.createDataFrame([(-1, None, "x"), (-2, [0.0] * 24, "x"), (-3, [1.0], "x"), (-4, [float("nan")] * 24, "x")], "id long, vec array<double>, doc_id string")
    with s.commit() as c:
        assert dense_index.add(s, c, frame(held).unionByName(odd), lists=24) == 3000
    new = some(400, 2900)
    with s.commit() as c:
        assert dense_index.add(s, c, frame(new)) == 400
    held |= new
    gone = list(range(0, 3300, 11))
    with s.commit() as c:
        assert dense_index.remove(s, c, spark.createDataFrame([(i,) for i in gone], "id long")) == len(gone)
    held = {i: v for i, v in held.items() if i not in set(gone)}
    queries = some(60, 0)
    q = spark.createDataFrame(list(queries.items()), "qid long, vec array<double>")
    ids = np.array(sorted(held))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit(np.array(list(queries.values()))) @ unit(np.array([held[i] for i in ids.tolist()])).T

    def found(**more):
        out = {}
        for x in dense_index.search(s, q, 10, **more).orderBy("qid", "rank").collect():
            out.setdefault(x.qid, []).append(x.id)
        return out

    want = {n: ids[np.lexsort((ids, -np.round(cos[n], 10)))[:10]].tolist() for n in queries}
    assert found(probes=24) == want
    got = found(probes=8)
    assert sum(len(set(got[n]) & set(want[n])) for n in queries) >= 0.9 * 600
    only = found(probes=24, where=F.col("doc_id") == "doc1")
    mine = [k for k, i in enumerate(ids.tolist()) if i % 3 == 1]
    assert only == {n: ids[mine][np.lexsort((ids[mine], -np.round(cos[n][mine], 10)))[:10]].tolist() for n in queries}
    assert dense_index.refit(s, 16) == len(held) and found(probes=16) == want


def make_parser():
    def parser(path, content):
        if content == b"broken":
            yield 1, 0, "text", "TEXT", "half of it", [0.0, 0.0, 10.0, 10.0]
            raise ValueError("no such thing")
        if content != b"empty":
            yield 1, 0, "text", "TEXT", f"Words of {content.decode()}, about relays.", [0.0, 0.0, 10.0, 10.0]
            yield 1, 1, "table", "TABLE", "<table><tr><td>1</td></tr></table>", [0.0, 50.0, 10.0, 60.0]

    return parser


def test_ingest_registers_what_it_parsed(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    for name, body in (("good.pdf", b"good"), ("bad.pdf", b"broken"), ("none.pdf", b"empty")):
        (raw / name).write_bytes(body)
    conf = C.Settings(quality=C.Quality(min_score=0.0))

    def run():
        jobs.ingest(spark, str(raw), out, make_parser(), conf, tags=["t"])
        return spark.read.json(f"{out}/report").first()

    told = run()
    s = Store(spark, out)
    assert (told.written.documents, told.written.failed, told.written.chunks) == (2, 1, 2)
    docs = s.read("documents").orderBy("doc_slug").collect()
    assert [d.doc_slug for d in docs] == ["good", "none"] and docs[0].run_id == told.run_id and docs[0].tags == ["t"] and docs[0].ingested_at.endswith("Z")
    failure = s.read("failures").first()
    assert failure.path.endswith("bad.pdf") and failure.error == "ValueError: no such thing" and failure.tries == 1
    assert s.read("chunks").where("content like '%half%'").count() == 0
    html = sorted(p.name for p in (tmp_path / "out" / "assets").iterdir() if not p.name.startswith((".", "l-")) and p.suffix == ".html")
    assert html == [f"{r.asset_id}.html" for r in s.read("assets").collect()]
    told = run()  # only the broken file is offered again
    assert (told.written.documents, told.written.failed, told.written.elements) == (0, 1, 0) and s.read("failures").first().tries == 2
    (raw / "bad.pdf").write_bytes(b"mended")
    told = run()
    assert told.written.documents == 1 and s.read("failures").count() == 0 and s.read("documents").count() == 3


def test_blobs_in_two_steps(spark, tmp_path):
    rows = spark.createDataFrame([("a1", "x/a1.png", bytearray(b"abc")), ("a2", "x/y/a2.html", None), ("a2", "x/y/a2.html", None)], "asset_id string, file_path string, blob binary")
    for _ in range(2):
        got = {r.asset_id: r.n_bytes for r in sinks.save_blobs(rows, tmp_path.as_uri()).collect()}
        assert got == {"a1": 3, "a2": 0}
    assert (tmp_path / "x" / "a1.png").read_bytes() == b"abc" and [p.name for p in (tmp_path / "x" / "y").iterdir()] == ["a2.html"]

    @F.udf("binary")
    def fails(x):
        if x == "x/b9.png":
            raise RuntimeError("lost")
        return x.encode()

    bad = spark.range(10).select(F.concat(F.lit("b"), "id").alias("asset_id"), F.concat(F.lit("x/b"), "id", F.lit(".png")).alias("file_path")).withColumn("blob", fails("file_path"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_blobs(bad, tmp_path.as_uri())
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["a1.png", "y"] and not [p for p in tmp_path.iterdir() if p.name.startswith(".staged")]


def test_index_runs(spark, tmp_path):
    """A run writes what it is given, prunes, reports, and the search of some documents equals that of all, cut."""
    root = str(tmp_path / "i")
    words = "relay pump wire valve motor fuse cable switch lamp sensor".split()
    chunk = "chunk_id string, doc_id string, content string, type string, metadata struct<page_label:string,page_number:int,section:string,linked_asset_id:string>"
    rows = [(f"c{i}", f"d{i % 20}", " ".join(words[(i * k) % 10] for k in range(1, 8)) + f" part{i}", "text", ("1", 1, None, None)) for i in range(200)]
    jobs.build_index(spark, spark.createDataFrame(rows, chunk), root)
    changed = [r for r in rows if r[1] == "d3"][:-2] + [("c900", "d3", "a new relay", "text", ("1", 1, None, None))]
    assert jobs.build_index(spark, spark.createDataFrame(changed, chunk), root).first().wanted == len(changed)
    told = spark.read.json(f"{root}/report").first()
    assert (told.upserted, told.removed) == (len(changed), 2) and told.run_id.startswith("run_") and told.validation.missing == 0
    s = Store(spark, root)
    assert s.read("points").count() == 199 == s.read("lists").count() == s.read("vectors").count()
    q = spark.createDataFrame([(1, "new relay"), (2, "part77")], "qid long, query string")
    found = jobs.search(spark, root, q).orderBy("qid", "rank").collect()
    assert found[0].chunk_id == "c900" and found[5].chunk_id == "c77"
    some = jobs.search(spark, root, q, docs=spark.createDataFrame([("d3",), ("d17",)], "doc_id string")).collect()
    assert {r.doc_id for r in some} == {"d3", "d17"} and [r.chunk_id for r in some if r["rank"] == 1] == ["c900", "c77"]
    assert all(r.ok for r in jobs.smoke(spark, root, "relay").collect())
    assert jobs.maintain(spark, root, 0.0, 1, 0.0)["deleted"] > 0 and s.read("points").count() == 199
    assert [r.chunk_id for r in jobs.search(spark, root, q).orderBy("qid", "rank").collect()] == [r.chunk_id for r in found]
    corpus = s.read("points").select(F.col("chunk_id").alias("id"), providers.sparse_encode(F.col("content")).alias("sparse"))
    plain = retrieve.sparse_vector_top_k(corpus, q.select("qid", providers.sparse_encode(F.col("query")).alias("sparse")), 20)
    stored = sparse_index.top_k(s, jobs._sparse_weights(q.select("qid", F.col("query").alias("text")), providers.sparse_encode), 20)
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    assert key(plain) == key(stored)


def test_swapped_tables_expire(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(4):
        sinks.swap(spark.range(n + 1), root)
    assert sinks.expire(spark, root, 2) == 2 and sinks.current(spark, root).count() == 4




def test_sparse_vectors_in_blocks(spark, monkeypatch):
    """Against brute force, with repeated ids and indices, signs, zeros, what isn't finite and many terms; no pair of a query and a row is a row of the plan (F1)."""
    r = random.Random(5)
    inf, nan = float("inf"), float("nan")
    kind = "{} int, sparse struct<indices: array<int>, values: array<double>>"

    def rows(n, odd):
        # what isn't finite stands under indices that a vector holds once
        at = lambda: r.sample(range(40), 8) if odd else [r.randrange(6000) if r.random() < 0.3 else r.randrange(5) for _ in range(8)]
        return [(i % (n if odd else n - 3), (at(), [r.choice([1.0, 2.5, -1.0, 0.0, *odd]) for _ in range(8)])) for i in range(n)]

    def brute(corpus, queries, k):
        def entries(vectors):
            out = {}
            for i, (at, x) in vectors:
                out.setdefault(i, []).extend(zip(at, x))
            return out

        found = {}
        for q, a in entries(queries).items():
            scores = []
            for i, b in entries(corpus).items():
                parts = [x * y for s, x in a for t, y in b if s == t]
                if parts:
                    scores.append((round(sum(parts), 10), i))
            rank = lambda x: (-inf, 0) if x != x else (-x, 1)  # noqa: E731  NaN is above all
            found[q] = [(i, str(s + 0.0)) for s, i in sorted(scores, key=lambda x: (rank(x[0]), x[1]))[:k]]
        return {q: x for q, x in found.items() if x}

    for odd in ((), (inf, -inf, nan)):
        corpus, queries = rows(300, odd), rows(20, odd and (2.0,))
        c, q = spark.createDataFrame(corpus, kind.format("id")), spark.createDataFrame(queries, kind.format("qid"))
        got: dict = {}
        for x in retrieve.sparse_vector_top_k(c, q, 12).orderBy("qid", "rank").collect():
            got.setdefault(x.qid, []).append((x.id, str(x.score + 0.0)))
        assert got == brute(corpus, queries, 12)
    plan = retrieve.sparse_vector_top_k(c, q, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan


def test_sparse_index_reads_postings_once(spark, tmp_path):
    """Postings are inverted by shard, without a shuffle of entries; a search's bounds and first shards are computed once, and few queries don't make postings move (F2). Repeated ids, nulls and empty texts too."""
    texts = [(i % 300, None if i % 97 == 0 else " ".join(f"w{(i * j) % 53}" for j in range(i % 9))) for i in range(310)]
    docs = spark.createDataFrame(texts, "id int, text string")
    s = Store(spark, str(tmp_path))
    with s.commit() as c:
        assert sparse_index.add(s, c, retrieve.term_vectors(docs, "id"), fresh=True, ids=docs.select("id")) == 300
    held = {r.id: dict(zip(r.terms, r["values"])) for r in s.read("vectors").collect()}
    shard = {r.id: r.shard for r in s.read("vectors").collect()}
    got = {(r.term, r.shard): (list(zip(r.ids, r["values"])), r.most) for r in s.read("postings").collect()}
    want: dict = {}
    for i in sorted(held):
        for t, x in held[i].items():
            want.setdefault((t, shard[i]), []).append((i, x))
    assert got == {k: (v, max(x for _, x in v)) for k, v in want.items()}
    assert "explode" not in sparse_index._inverted(s.read("vectors"))._jdf.queryExecution().optimizedPlan().toString()
    weights = spark.createDataFrame([(0, "w1", 2.0), (0, "w5", 1.0)], "qid int, term string, w double")
    found = sparse_index.top_k(s, weights, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "most#" not in plan and "BroadcastHashJoin" in plan
    scores = {i: 2.0 * v.get("w1", 0) + v.get("w5", 0) for i, v in held.items() if {"w1", "w5"} & set(v)}
    assert [(-r.score, r.id) for r in found.orderBy("rank").collect()] == best(scores, 7)
