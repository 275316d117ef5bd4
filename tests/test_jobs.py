"""Whole runs over temporary folders, with a fake parser."""

import json

from pyspark.sql import functions as F

from brindle import __main__ as cli, config as C
from brindle.plans import jobs
from brindle.sources import sinks


def make_parser():
    """A local function, so that it travels to the workers by value."""

    def parser(path, content):
        yield 1, 0, "text", "TEXT", "Short text content about relays and wires.", [0.0, 0.0, 10.0, 10.0]
        yield 1, 1, "table", "TABLE", "|a|b|\n|1|2|", [0.0, 50.0, 10.0, 60.0]
        yield 1, 2, "image", "PICTURE", f"Image caption {content.decode()}.", [0.0, 90.0, 10.0, 99.0]

    return parser


def test_ingest_index_search(spark, tmp_path):
    raw, out, root = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "index")
    raw.mkdir()
    (raw / "One manual.pdf").write_bytes(b"one")
    parser = make_parser()
    conf = C.Settings(quality=C.Quality(min_score=0.0))
    assert jobs.ingest(spark, str(raw), out, parser, conf).first().asDict() | {"mean_score": 0} == {"documents": 1, "chunks": 3, "mean_score": 0, "low": 0, "max_kept_pages": 1, "assets": 2}
    (raw / "Two.pdf").write_bytes(b"two")
    (raw / "Copy of one.pdf").write_bytes(b"one")
    assert jobs.ingest(spark, str(raw), out, parser, conf).first()["documents"] == 2
    chunks = sinks.current(spark, f"{out}/chunks")
    assert sorted(r["type"] for r in chunks.collect()) == ["image_caption"] * 2 + ["table_md"] * 2 + ["text"] * 2
    assert sinks.current(spark, f"{out}/page_to_assets").count() == 2
    assert jobs.build_index(spark, chunks, root).first().asDict() == {"indexed": 6, "wanted": 6, "missing": 0}
    found = jobs.search(spark, root, spark.createDataFrame([(1, "image caption two")], "qid long, query string"))
    best = found.orderBy("rank").first()
    assert best["content"] == "Image caption two." and best["rerank_score"] == 1.0
    gold = tmp_path / "gold.jsonl"
    gold.write_text(json.dumps({"id": "g1", "query": "image caption two", "expected_retrieval": {"text_chunk_ids": [best["chunk_id"]]}}) + "\n")
    from brindle.sources import readers

    g = readers.gold(spark, str(gold))
    m = jobs.evaluate_run(g, found.select(F.lit("g1").alias("qid"), "rank", "chunk_id"), [1], chunks.select("chunk_id", "element_id"))
    assert {r["kind"]: r["recall"] for r in m.collect()} == {"strict": 1.0, "relaxed": 1.0}
    manifest = sinks.current(spark, f"{out}/assets").withColumn("embedding", F.array(F.lit(1.0)))
    docs = sinks.current(spark, f"{out}/documents").withColumn("pos", F.lit(1))
    assert jobs.index_assets(spark, manifest, docs, chunks.withColumn("pos", F.col("chunk_index")), str(tmp_path / "assets")) == 4


def test_arguments():
    a = cli.arguments(["search", "--root", "x", "--query", "a", "--query", "b"])
    assert (a.what, a.query, a.top) == ("search", ["a", "b"], 5)
