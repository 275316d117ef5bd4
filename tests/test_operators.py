"""Operators on small fixtures."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from brindle import config as C, providers
from brindle.functions.ids import asset_id
from brindle.operators import captions, chat, chunking, evaluate, index, layout, rag, report, retrieve
from brindle.operators.assets import attachments, resolve


def test_packing(spark):
    df = spark.createDataFrame([("one two\n\nthree four\n\nfive six",), ("",), ("a\n\n" + "b" * 120 + "\n\nc",)], "t string")
    got = [r[0] for r in df.select(chunking.pack_paragraphs(F.col("t"), 3, 100)).collect()]
    assert got == [["one two\n\nthree four", "five six"], [], ["a", "b" * 120, "c"]]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n-", max_size=300))
def test_split_text(text):
    out = chunking.split_text(text, 40, 10, ("\n\n", "\n- ", "\n* ", "\n", ". ", " "))
    assert all(p.strip() == p and p for p in out)
    assert all(len(p) <= 40 or not any(s in p.strip() for s in ("\n\n", ". ")) for p in out)
    assert set("".join(out).split()) or not text.strip()
    # nothing but white space is lost
    left = "".join(out).replace(" ", "").replace("\n", "")
    assert len(left) >= len("".join(text.split()))


def test_split_text_overlaps():
    words = " ".join(f"w{i:03d}" for i in range(60))
    out = chunking.split_text(words, 50, 15, (" ",))
    assert all(len(p) <= 50 for p in out) and len(out) > 5
    assert all(set(a.split()[-2:]) & set(b.split()) for a, b in zip(out, out[1:]))


def test_chunk_records_work_once(spark):
    """Long parts between short ones keep their place; each content is read once and each chunk scored once."""
    long_ = ["word%d " % k * 300 for k in range(3)]
    body = "\n\n".join(["few words here " * 12, long_[0], "more words there " * 12, long_[1], long_[2], "the end of it " * 12])
    rows = [("e1", "d", "text", body), ("e2", "d", "image_caption", "x" * 1200), ("e3", "d", "text", ""), ("e4", "d", "text", None)]
    el = spark.createDataFrame(rows, "element_id string, doc_id string, type string, content string")
    conf = C.Chunking()
    got = {(r.element_id, r.chunk_index): r.chunk_text for r in chunking.chunk_texts(el, conf).collect()}
    want = []
    for part in [x.strip() for x in body.split("\n\n")]:
        want += chunking.split_text(part, conf.size, conf.overlap, conf.separators) if len(part) > conf.size else [part]
    assert got == {("e1", i): t for i, t in enumerate(want)} | {("e2", 0): "x" * 1200}
    plan = chunking.chunk_records(el)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("not legible") == 1


def test_chunk_records(spark):
    el = spark.createDataFrame([("doc_p0_01_text", "doc", "text", "Short text content.", 1), ("doc_p0_02_table", "doc", "table_md", "|a|b| |1|2|", 1), ("doc_p0_03_image", "doc", "image_caption", "Image caption for test.", 1), ("doc_p0_04_text", "doc", "text", "", 1)], "element_id string, doc_id string, type string, content string, page_number int")
    got = chunking.chunk_records(el, q=C.Quality(min_score=0.0)).orderBy("element_id").collect()
    assert [r["type"] for r in got] == ["text", "table_md", "image_caption"]
    assert all(r["chunk_index"] == 0 and len(r["chunk_id"]) == 32 and r["metadata"]["page_number"] == 1 for r in got)
    assert spark.range(1).select(asset_id(F.lit("doc_p0_02_table"))).first()[0].startswith("asset_")


def items(spark, rows):
    return spark.createDataFrame([("d", 1, i, *r) for i, r in enumerate(rows)], "doc_id string, page_no int, item_ord long, kind string, label string, text string, bbox array<double>")


def test_paragraph_gaps(spark):
    box = lambda top: [0.0, top, 10.0, top + 10]
    rows = [("text", "TEXT", "a", box(0.0)), ("text", "TEXT", "b", box(42.0)), ("text", "TEXT", "c", box(84.1)), ("text", "TEXT", "", box(200.0)), ("text", "TEXT", "d", box(260.0)), ("text", "PAGE_HEADER", "", box(280.0)), ("table", "TABLE", "t", box(290.0)), ("text", "TEXT", "e", box(300.0)), ("text", "TEXT", "f", None)]
    got = layout.paragraphs(items(spark, rows)).orderBy("seq").collect()
    # a text without a box sorts as if at the top left
    assert [(r["type"], r["subtype"], r["content"]) for r in got] == [("text", "body", "a\nf\nb"), ("text", "body", "c"), ("text", "body", "d"), ("text", "header", ""), ("table", "body", "t"), ("text", "body", "e")]
    assert [r["seq"] for r in got] == list(range(1, len(got) + 1))
    assert got[0]["element_id"] == "d_p0_01_text"


def test_fusion(spark):
    d = spark.createDataFrame([(1, 7, 0.2, 1), (1, 8, 0.1, 2)], "qid int, id int, score double, rank int")
    s = spark.createDataFrame([(1, 7, 0.2, 1), (1, 9, 5.0, 2)], "qid int, id int, score double, rank int")
    got = {r["id"]: r for r in retrieve.fuse(d, s, rrf_k=5).collect()}
    assert got[7]["rrf_score"] == 2 / 6 and got[7]["rank"] == 1
    assert (got[8]["rank"], got[9]["rank"]) == (2, 3)
    assert got[9]["dense_score"] is None and got[9]["compat_dense_score"] == 5.0


def test_rerank(spark):
    c = spark.createDataFrame([(1, i, "alpha beta", t, i) for i, t in enumerate(["x", "alpha", "beta alpha", "alpha"], 1)], "qid int, id int, query string, text string, rank int")
    got = retrieve.rerank(c, 3, retrieve.overlap_score(F.col("query"), F.col("text"))).orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 2, 4]
    assert [r["id"] for r in retrieve.rerank(c, 2).orderBy("rank").collect()] == [1, 2]


def context_docs(spark, contents):
    return spark.createDataFrame([(1, i, c, f"T{i}", "s", "1", 1, None, str(i), 0.5, 0.1, None) for i, c in enumerate(contents, 1)], "qid int, rank int, content string, title string, doc_slug string, page_label string, page_number int, linked_asset_id string, chunk_id string, rerank_score double, rrf_score double, score double")


def test_context_budget(spark):
    one = rag.context(context_docs(spark, ["a" * 100, "b" * 500, "c"]), 300).first()
    assert one["allowed"] == ["S1"] and "bbb" not in one["context"] and "--- Source [S1]: T1 (Page 1) ---" in one["context"]
    none = rag.context(context_docs(spark, ["a" * 400]), 300).first()
    assert none["context"] == "" and none["allowed"] == []


def test_answers(spark):
    docs = context_docs(spark, ["The fuse is 5 A. More text."])
    q = spark.createDataFrame([(1, "which fuse?")], "qid int, query string")
    assert rag.answer(docs, q, providers.extractive_answer).first()["answer"] == "The fuse is 5 A. [S1]"
    assert rag.answer(docs, q, lambda p, c: F.lit("no source")).first()["answer"] == C.NO_ANSWER
    assert "HISTORY" in rag.answer(docs, q, lambda p, c: p, C.Retrieval(enforce_citations=False), spark.createDataFrame([(1, "User: hi")], "qid int, history string")).first()["answer"]


def test_history_cut_comes_first(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "" if i == 9 else f"m{i}") for i in range(10)], "chat_id int, turn int, role string, content string")
    assert rag.history(m, 3).first()["history"] == "Assistant: m7\nUser: m8"


def test_metrics(spark):
    r = spark.createDataFrame([(1, ["a", "b"], ["x", "a", "a"]), (2, [], ["a"]), (3, ["z"], None)], "qid int, expected array<string>, retrieved array<string>")
    got = {(x["qid"], x["k"]): x for x in evaluate.per_query(r, [3, 1, 3]).collect()}
    assert got[1, 3]["recall"] == 0.5 and abs(got[1, 3]["precision"] - 1 / 3) < 1e-12 and got[1, 3]["mrr"] == 0.5
    assert got[1, 1]["recall"] == 0 and got[2, 1]["recall"] is None and got[3, 3]["precision"] == 0
    avg = {x["k"]: x for x in evaluate.averages(evaluate.per_query(r, [3])).collect()}
    assert avg[3]["queries"] == 2 and avg[3]["recall"] == 0.25
    one = spark.createDataFrame([(1, ["asset-1"], ["asset-1"])], r.schema)
    assert evaluate.hit_rate(one, [1]).first().asDict() == {"k": 1, "hit_rate": 1.0, "queries": 1}


def manifest(spark):
    return spark.createDataFrame([(0, "a1", "e1", "d1", "1", "image_asset", "p0"), (1, "a1", "e9", "d1", "1", "image_asset", "p1"), (2, "a2", "e2", "d1", "1", "table_asset", "p2"), (3, "a3", "e3", "d2", "1", "image_asset", "p3"), (4, "a4", "e4", "d2", None, "image_asset", "p4")], "pos long, asset_id string, element_id string, doc_id string, page_label string, type string, file_path string")


def test_resolver_and_attachments(spark):
    docs = spark.createDataFrame([(1, 1, "a1", "none", "d9", "x1", "5", 1), (1, 2, None, "e3", "d2", "x2", "1", 1), (1, 3, None, "none", "d1", "x1", "1", 1)], "qid int, rank int, linked_asset_id string, element_id string, doc_id string, doc_slug string, page_label string, page_number int")
    got = resolve(docs, manifest(spark)).orderBy("pos").collect()
    assert [(r["asset_id"], r["file_path"]) for r in got] == [("a1", "p1"), ("a3", "p3"), ("a2", "p2")]
    hits = spark.createDataFrame([(1, 1, "a4", "d2", None, None, "p4", "image_asset"), (1, 2, "zz", "d77", None, "1", "pz", "image_asset")], "qid int, rank int, asset_id string, doc_id string, doc_slug string, page_label string, file_path string, type string")
    kept = attachments(resolve(docs, manifest(spark)), hits, docs, manifest(spark)).orderBy("pos").collect()
    assert [r["asset_id"] for r in kept] == ["a1", "a3", "a2"]


def test_captions(spark):
    raw = ['```json\n{"component_name": "Relay", "part_numbers": ["K1",], "connections": []}\n```', "{“component_name”: “Pump”, “visual_type”: “Photo”}", 'x {"component_name": "Unknown", "part_numbers": []} y', "[1, 2]", "nonsense"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", captions.parse(F.col("r")).alias("c"))
    got = {r["i"]: r["t"] for r in df.select("i", F.when(captions.useful(F.col("c")), captions.rendered(F.col("c"))).alias("t")).collect()}
    assert got == {0: "Diagram for Relay. Part Numbers: K1.", 1: "Photo for Pump.", 2: None, 3: None, 4: None}


def test_index_maintenance(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 0), (2, "y", 1), (3, "z", 0)], "id int, v string, n int")
    assert sorted((r["id"], r["v"]) for r in index.upsert(old, new, ["id"], "n").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    have = spark.createDataFrame([("d1", "c1"), ("d1", "c2"), ("d2", "c3")], "doc_id string, chunk_id string")
    want = spark.createDataFrame([("d1", "c1"), ("d1", "c9")], "doc_id string, chunk_id string")
    assert sorted(r["chunk_id"] for r in index.prune(have, want).collect()) == ["c1", "c3"]
    assert sorted(r["chunk_id"] for r in index.prune(have, want, full_sync=True).collect()) == ["c1"]
    assert index.validate(have, want).first().asDict() == {"indexed": 3, "wanted": 2, "missing": 1}


def test_reports_fill_empty_buckets(spark):
    got = {r["bucket"]: r["n"] for r in report.score_histogram(spark.createDataFrame([(0.3,), (0.95,)], "score double")).collect()}
    assert got == {"0.0-0.3": 0, "0.3-0.5": 1, "0.5-0.7": 0, "0.7-0.9": 0, "0.9-1.0": 1}


def test_offline_embedding(spark):
    df = spark.createDataFrame([("alpha beta",), ("",)], "t string").select(providers.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert abs(sum(x * x for x in df[0]["v"]) - 1) < 1e-6 and sum(map(abs, df[1]["v"])) == 0


def test_texts_that_hold_a_passage(spark):
    texts = [(1, "a red  fox runs over the old\nbridge at dawn"), (2, "fox runs over the"), (3, "the red fox runs over them"), (4, ""), (5, None), (6, "a red  fox runs over the old\nbridge at dawn")]
    passages = [("whole", "a red  fox runs over the old\nbridge at dawn"), ("cut words", "d  fox runs over the old\nbri"), ("one space", "red fox runs over the"), ("short", "x runs"), ("space first", " runs over the"), ("empty", ""), ("null", None), ("nowhere", "one two three four five six"), ("again", "red  fox runs over the old")]
    corpus, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(passages, "qid string, passage string")
    got = sorted(map(tuple, retrieve.holding(corpus, asked).collect()))
    assert got == sorted((q, i) for i, t in texts for q, p in passages if t is not None and p is not None and p in t)


def test_chats_are_placed_across_hours(spark):
    rows = [(i, f"2024-01-0{1 + i % 3}T{i % 5:02d}:{i % 7:02d}:00Z" if i % 11 else None) for i in range(60)]
    got = {r["chat_id"]: r["place"] for r in chat.listed(spark.createDataFrame(rows, "chat_id long, updated_at string")).collect()}
    order = sorted(sorted(rows), key=lambda r: r[1] or "", reverse=True)
    assert got == {r[0]: n for n, r in enumerate(order, 1)}


def test_resolve_spreads_and_cuts(spark):
    """A page with many assets is dealt to many tasks, and each query's first assets alone can be asked for (F9, F10)."""
    from brindle.operators import assets

    kind = "pos long, asset_id string, element_id string, doc_id string, page_label string, type string, file_path string"
    manifest = spark.createDataFrame([(i, None if i % 31 == 0 else f"a{i % 150}", f"e{i % 7}", f"d{i % 2}", str(i % 3 // 2), "image_asset", f"f{i}") for i in range(200)], kind)
    wanted = [(q, r, "a3" if (q + r) % 5 == 0 else None, "e2" if (q + r) % 4 == 0 else "none", f"d{(q * r) % 2}", str(q % 2), None) for q in range(20) for r in range(1, 6)]
    docs = spark.createDataFrame(wanted, "qid int, rank int, linked_asset_id string, element_id string, doc_id string, page_label string, page_number int")
    rows = lambda df: [tuple(r) for r in df.orderBy("qid", "pos").collect()]
    every = rows(assets.resolve(docs, manifest))
    held = [r.asDict() for r in manifest.collect()]
    last = {k: {m[k]: m for m in held if m[k]} for k in ("asset_id", "element_id")}
    want = []
    for q in range(20):
        seen: dict = {}
        for _, r, linked, element, doc, page, _ in (w for w in wanted if w[0] == q):
            m = last["asset_id"].get(linked) or last["element_id"].get(element)
            for x in [m] if m else [m for m in held if (m["doc_id"], m["page_label"]) == (doc, page)]:
                if x["asset_id"]:
                    seen.setdefault(x["asset_id"], (x["type"], x["file_path"], x["page_label"], x["element_id"]))
        want += [(q, i, a, *x) for i, (a, x) in enumerate(seen.items(), 1)]
    assert every == want
    assert rows(assets.resolve(docs, manifest, 4)) == [r for r in every if r[1] <= 4]
    assert assets.resolve(docs, manifest)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= 3


def test_term_statistics_in_one_pass(spark):
    """Terms are counted once for df, tf and idf (F20)."""
    import math

    from brindle.operators import retrieve

    docs = spark.createDataFrame([(1, "a a b"), (2, "B c"), (2, "c"), (3, None), (4, "")], "id int, text string")
    found = retrieve.term_statistics(retrieve.term_counts(docs), docs)
    idf = lambda df: math.floor(math.log(6 / (df + 1)) * 1000 + 1000)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2, idf(1)), ("b", 2, 2, idf(2)), ("c", 1, 2, idf(1))]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode") == 1


def test_dense_blocks_are_not_copied(spark):
    """Of a batch of pairs of blocks, Python holds one pair's product at a time, no copy of the batch (F17)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from brindle.operators import retrieve

    class Pairs:
        schema = StructType.fromDDL("ids array<long>, qids array<long>")

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

        def withColumn(self, *_):  # noqa: N802
            return self

    g, n = np.random.default_rng(3), 40
    rows, asked = [g.normal(size=(1000, 64)) for _ in range(n)], g.normal(size=(4, 64))
    ids = [list(range(1000 * i, 1000 * i + 1000)) for i in range(n)]
    batch = pa.record_batch([pa.array([64] * n, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array([x.tobytes() for x in rows]), pa.array([[7, 8, 9, 10]] * n, pa.list_(pa.int64())), pa.array([asked.tobytes()] * n)], names=["dim", "ids", "m", "qids", "qm"])
    run = retrieve.blocks_top_k(Pairs(), 3).run
    tracemalloc.start()
    found = [b.to_pylist() for b in run([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6, "of", batch.nbytes / 1e6)
    for i, got in enumerate(found):
        want = {(7 + q, 1000 * i + int(j)) for q, s in enumerate(asked @ rows[i].T) for j in np.argsort(-s)[:3]}
        assert {(x["qid"], x["id"]) for x in got} == want
    assert peak < batch.nbytes / 4
