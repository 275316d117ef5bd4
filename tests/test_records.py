"""Readers, sinks and providers that queries don't cover."""

import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from brindle import providers
from brindle.functions import text as T
from brindle.operators import assets, captions, index, rag
from brindle.plans import jobs
from brindle.sources import readers, runs, sinks
from brindle.streaming import incremental


def test_pointer_survives_a_failed_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert sinks.current(spark, root) is None
    sinks.swap(spark.range(3), root)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_point", broken)
        with pytest.raises(OSError):
            sinks.swap(spark.range(9), root)
    assert sinks.current(spark, root).count() == 3
    sinks.swap(spark.range(5), root)
    assert sinks.current(spark, root).count() == 5
    assert not sinks.ensure(spark, root, "id long") and sinks.ensure(spark, root, "id long", recreate=True)
    assert sinks.current(spark, root).count() == 0


def test_buckets_rewrite_what_they_touch(spark, tmp_path):
    root = str(tmp_path / "b")
    rows = spark.createDataFrame([(f"d{i % 40}", f"c{i}", "old") for i in range(200)], "doc_id string, chunk_id string, v string")
    merge = lambda now, new: new if now is None else index.upsert(now, new, ["doc_id", "chunk_id"])
    assert len(sinks.swap_buckets(rows, root, merge, buckets=16)) > 4
    new = spark.createDataFrame([("d3", "c3", "new"), ("d3", "x", "new")], rows.schema)
    assert len(sinks.swap_buckets(new, root, merge)) == 1
    got = {(r.doc_id, r.chunk_id): r.v for r in sinks.current(spark, root).select("doc_id", "chunk_id", "v").collect()}
    assert len(got) == 201 and got["d3", "c3"] == "new" and got["d3", "c43"] == "old"
    one = sinks.current(spark, root, ["d3"])
    assert one.count() == 6 and len(one.inputFiles()) < len(sinks.current(spark, root).inputFiles())
    assert sinks.swap_buckets(new.limit(0), root, merge) == []


def test_stream_into_buckets(spark, tmp_path):
    src, root = str(tmp_path / "s"), str(tmp_path / "i")
    spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 1)], "doc_id string, k int, at int").write.parquet(src)
    for _ in range(2):
        stream = incremental.read_stream(spark, src, "doc_id string, k int, at int")
        incremental.index_stream(stream, root, str(tmp_path / "ck"), ["doc_id", "k"], "at", by="doc_id", buckets=4).awaitTermination()
    assert sorted((r.doc_id, r["at"]) for r in sinks.current(spark, root).collect()) == [("a", 2), ("b", 1)]


def test_upsert_picks_the_same_row(spark):
    now = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "k int, v string")
    got = [sorted(map(tuple, index.upsert(now, new.repartition(n), ["k"]).collect())) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 2


def test_blobs(spark, tmp_path):
    rows = spark.createDataFrame([("a1", "x/a1.png", bytearray(b"abc")), ("a2", "x/a2.html", None)], "asset_id string, file_path string, blob binary")
    for _ in range(2):
        got = {r.asset_id: (r.n_bytes, r.error) for r in sinks.write_blobs(rows, tmp_path.as_uri()).collect()}
        assert got == {"a1": (3, None), "a2": (0, None)}
    assert sorted(os.listdir(tmp_path / "x")) == ["a1.png", "a2.html"] and (tmp_path / "x/a1.png").read_bytes() == b"abc"


def test_parsing_tells_failures(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Title\n\nSome   text\nhere.\n\n|a|b|\n|1|2|")
    (tmp_path / "a.html").write_text("<h1>Top</h1><p>Body</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    files = readers.raw_files(spark, str(tmp_path), "*")
    assert [r.path.rpartition("/")[2] for r in readers.in_order(files).orderBy("place").collect()] == ["a.html", "b.md", "c.pdf"]
    tried = readers.parse_files(files, readers.plain_parser).cache()
    assert [r.path.rpartition("/")[2] for r in readers.failures_of(tried).collect()] == ["c.pdf"]
    got = sorted((r.kind, r.label, r.text) for r in readers.items_of(tried).collect())
    assert got == [("table", "TEXT", "|a|b|\n|1|2|"), ("text", "SECTION_HEADER", "Title"), ("text", "SECTION_HEADER", "Top"), ("text", "TEXT", "Body"), ("text", "TEXT", "Some text here.")]
    assert readers.resolve_raw("x.pdf", "/raw/") == "/raw/x.pdf" and readers.resolve_raw("/a/x.pdf", "/raw") == "/a/x.pdf"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("".join(f'{{"n": {i}}}\n' + ("\n" if i == 5 else "") for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {r.n: r.line for r in readers.json_lines(spark, str(path), "n int", skip=3).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: i + (i > 5) for i in range(3, 3000)}


def test_runs(tmp_path):
    at = datetime(2024, 5, 1, 10, 20, 30, tzinfo=UTC)
    assert runs.now_iso(at) == "2024-05-01T10:20:30Z" and runs.run_id(at, "abc123") == "run_20240501_102030_abc123"
    r = runs.Run(str(tmp_path))
    r.log.info("begun")
    r.close()
    assert "begun" in (tmp_path / "logs" / f"{r.id}.log").read_text() and (tmp_path / "assets").is_dir()


def test_report_holds_validation(spark, tmp_path):
    sinks.report(spark.createDataFrame([(3,)], "chunks int"), str(tmp_path / "r"), spark.createDataFrame([("PASS",)], "status string"), "run_1")
    r = spark.read.json(str(tmp_path / "r")).first()
    assert (r.chunks, r.validation.status, r.run_id) == (3, "PASS", "run_1")


def test_prompts(spark):
    q = spark.createDataFrame([("what?", "ctx"), (" ", "ctx")], "q string, c string")
    plain = [r[0] for r in q.select(rag.chain_prompt(F.col("q"), F.col("c"))).collect()]
    images = [r[0] for r in q.select(rag.image_prompt(F.col("q"), F.col("c"))).collect()]
    assert all("CONTEXT:\nctx" in x for x in plain + images) and "QUERY:\nwhat?" in images[0] and "What does the image show?" in images[1]


def test_answer_services(spark):
    def fails(_):
        raise RuntimeError("down")

    df = spark.createDataFrame([("p",)], "p string")
    ask = lambda *s: df.select(providers.generator(*s)(F.col("p"), F.col("p"))).first()[0]
    assert ask(fails, lambda p: "said " + p) == "said p" and "down" in ask(fails) and "configured" in ask()


def test_images(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\x03"
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X" + b"\x0a\x00\x00\x00" + b"\x00" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    df = spark.createDataFrame([(bytearray(jpeg),), (bytearray(webp),), (bytearray(b"\xff\xd8\xff"),), (bytearray(b""),), (None,)], "b binary")
    got = [(r[0]["width"], r[0]["height"]) if r[0] else None for r in df.select(assets.image_size(F.col("b"))).collect()]
    assert got[:2] == [(200, 300), (100, 50)] and got[2] == (None, None)
    assert [r[0] for r in df.select(assets.image_problem(F.col("b"))).collect()][:4] == [None, None, "undecodable", "empty"]
    v = [r[0] for r in df.select(providers.image_embedding(F.col("b"), 8)).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[3] is None and v[4] is None
    load = lambda: lambda files: [[float(len(f))] for f in files]
    assert df.select(providers.image_encoder(load)(F.col("b"))).first()[0] == [float(len(jpeg))]


def test_captions_between_text(spark):
    df = spark.createDataFrame([('Sure [ok]: {"component_name": "Pump"} and {"x": 1}',), ("none",)], "t string")
    got = df.select(captions.first_json(F.col("t"))).collect()
    assert got[0][0] == '{"component_name": "Pump"}' and got[1][0] is None
    assert df.select(captions.parse_first(F.col("t"))["component_name"]).first()[0] == "Pump"


def test_smoke(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "d1", "a figure of it"), ("c2", "d1", "other words")], "chunk_id string, doc_id string, content string")
    points = rows.withColumn("dense", providers.hashed_embedding(F.col("content")))
    sinks.swap(points, str(tmp_path / "i"))
    assert {r.branch: (r.n, r.ok) for r in jobs.smoke(spark, str(tmp_path / "i")).collect()} == {"dense": (2, True), "sparse": (1, True)}


def test_text_ids_and_dense_search(spark):
    from brindle.operators import retrieve

    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [1.0, 0.0, 0.0]), ("e", None)], "id string, vec array<double>")
    q = spark.createDataFrame([("q1", [1.0, 0.1]), ("q2", [0.0, 0.0])], "qid string, vec array<double>")
    got = {}
    for r in retrieve.dense_top_k(corpus, q, 2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {"q1": ["a", "c"], "q2": ["a", "b"]}


def test_density_reason_digits(spark):
    df = spark.createDataFrame([("abc " + "#" * 16 + " d",)], "t string")
    reasons = df.select(T.quality(F.col("t"), F.lit("text"))["reasons"]).first()[0]
    assert "low_text_density (0.18)" in reasons


def test_image_placements_and_search(spark):
    from brindle.operators import layout, retrieve

    pages = spark.createDataFrame([("d", 1, [(7, [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]]), (8, [])]), ("d", 2, None)], "doc_id string, page_no int, images array<struct<xref:int,rects:array<array<double>>>>")
    assert [(r.page_no, r.xref, r.rect_no, r.bbox) for r in layout.placements(pages).orderBy("rect_no").collect()] == [(1, 7, 0, [0.0, 0.0, 1.0, 1.0]), (1, 7, 1, [2.0, 2.0, 3.0, 3.0])]
    images = [bytes([n]) * 9 for n in range(4)]
    held = spark.createDataFrame([(f"a{n}", bytearray(b)) for n, b in enumerate(images)], "id string, image binary").select("id", providers.image_embedding(F.col("image")).alias("vec"))
    asked = spark.createDataFrame([(1, bytearray(images[2])), (2, None)], "qid int, image binary")
    got = retrieve.search_images(held, asked, providers.image_embedding, "image", 3, None).orderBy("rank").collect()
    assert (got[0].qid, got[0].id, got[0].score) == (1, "a2", 1.0) and {r.qid for r in got} == {1}


def test_chat_view_and_windowed_counts(spark, tmp_path):
    from brindle.operators import chat

    chats = spark.createDataFrame([("c", "T", "2024-01-01", "2024-01-02", "x")], "chat_id string, title string, created_at string, updated_at string, secret string")
    assert chat.chat_view(chats).first().asDict() == {"id": "c", "title": "T", "created_at": "2024-01-01", "updated_at": "2024-01-02"}
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "a")], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    assert sorted(r.n for r in incremental.windowed_counts(events).collect()) == [1, 2]
    events.write.parquet(str(tmp_path / "e"))
    once = incremental.new_documents(incremental.read_stream(spark, str(tmp_path / "e"), "ts timestamp, event_type string"), "event_type")
    once.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_captions_are_tried_again(spark, tmp_path):
    """A service that fails twice is asked a third time, each wait twice the one before; one that never answers gives null."""
    import time

    folder = str(tmp_path)

    def ask(image):
        import os
        import time

        image = bytes(image).decode()
        with open(os.path.join(folder, image), "a") as f:
            f.write(f"{time.time()}\n")
        if image == "never" or len(open(os.path.join(folder, image)).readlines()) < 3:
            raise OSError("busy")
        return f"caption of {image}"

    rows = spark.createDataFrame([(bytearray(b"slow"),), (bytearray(b"never"),)], "image binary").coalesce(1)
    began = time.time()
    got = {bytes(r.image).decode(): r.c for r in rows.select("image", providers.captioner(ask, 3, 0.2)(F.col("image")).alias("c")).collect()}
    assert got == {"slow": "caption of slow", "never": None} and time.time() - began >= 1.2
    for name in got:
        at = [float(x) for x in (tmp_path / name).read_text().split()]
        assert len(at) == 3 and at[1] - at[0] >= 0.2 and at[2] - at[1] >= 0.4
