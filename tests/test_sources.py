"""Readers, writers and the streaming index over temporary folders."""

import json

from brindle.sources import readers, sinks
from brindle.streaming import incremental


def test_raw_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "My manual (1).pdf").write_bytes(b"abc")
    (tmp_path / "x.txt").write_bytes(b"no")
    r = readers.raw_files(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["doc_id"] == "900150983cd24fb0d6963f7d28e17f72"
    assert "manual" in r[0]["title"]
    items = readers.parsed(readers.raw_files(spark, str(tmp_path)), lambda path, content: [(1, 0, "text", "TEXT", content.decode(), None)])
    assert items.first()["text"] == "abc"


def test_gold_shapes(spark, tmp_path):
    q = {"id": "q1", "query": "x", "expected_pages": ["s#p1"]}
    for name, body in (("a.json", [q]), ("b.json", {"queries": [q]}), ("c.json", {"items": [q]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert readers.gold(spark, str(tmp_path / name)).first()["id"] == "q1"
    (tmp_path / "d.jsonl").write_text(json.dumps(q) + "\n")
    assert readers.gold(spark, str(tmp_path / "d.jsonl")).count() == 1
    (tmp_path / "e.json").write_text('{"other": 1}')
    try:
        readers.gold(spark, str(tmp_path / "e.json"))
        raise AssertionError
    except ValueError:
        pass


def test_maps_and_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"e1": ["c1", "c2"], "e2": []}')
    got = readers.array_map(spark, str(tmp_path / "m.json"), "element_id", "chunk_ids").collect()
    assert {r["element_id"]: r["chunk_ids"] for r in got} == {"e1": ["c1", "c2"], "e2": []}
    (tmp_path / "a.json").write_text('[{"asset_id": "a", "page_label": "1"}, {"asset_id": "b"}]')
    assert readers.manifest(spark, str(tmp_path / "a.json")).count() == 2


def test_swap_and_stream(spark, tmp_path):
    root, src = str(tmp_path / "index"), str(tmp_path / "src")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(src)
    run = lambda: incremental.index_stream(incremental.read_stream(spark, src, "id int, v string"), root, str(tmp_path / "ck"), ["id"]).awaitTermination()
    run()
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").write.mode("append").parquet(src)
    run()
    assert sorted((r["id"], r["v"]) for r in sinks.current(spark, root).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_reset(spark, tmp_path):
    p = str(tmp_path / "x")
    df = spark.createDataFrame([(1,)], "id int")
    sinks.append(df, p, "parquet")
    sinks.reset(df, p, "parquet", keep=True)
    assert spark.read.parquet(p).count() == 1
    sinks.reset(df, p, "parquet")
    assert spark.read.schema("id int").parquet(p).count() == 0


def test_html_items(spark):
    pages = spark.createDataFrame([(1, "<h1>Top</h1><p>One <b>two</b></p><table><tr><td>x</td></tr></table>")], "page_id long, html string")
    got = readers.html_items(pages).orderBy("item_ord").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("text", "Top"), ("text", "One two"), ("table", "x")]


def test_html_items_whole(spark):
    """Unclosed paragraphs, text outside known tags and images are kept; scripts, titles and comments aren't text."""
    html = """<html><head><title>no</title><script>var t="</p><p>no";</script></head><body>loose &amp; <i>text</i><!-- <p>no</p> -->
<div class="ad">in a div</div><article><h1>Top</h1><p><b>first.<br><p>second<ul><li>a<li>b</ul><img src="x.png" alt="a cat"><p>last<br></article>after<table><tr><td>x<p>y</table><footer>end</footer></body></html>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "only text")], "page_id long, html string")
    got = [(r["doc_id"], r["kind"], r["text"]) for r in readers.html_items(pages).orderBy("doc_id", "item_ord").collect()]
    want = ["loose &amp; text", "in a div", "Top", "first.", "second", "a", "b", ("image", "a cat"), "last", "after", ("table", "x y"), "end"]
    assert got == [("1", *(("text", w) if isinstance(w, str) else w)) for w in want] + [("4", "text", "only text")]


def test_every_query_has_columns(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50
    df = e.entry(spark)
    assert df.limit(1).count() == 1


def test_document_source(spark, tmp_path):
    """Files in ranges, one task each; files that can't be parsed are rows with an error."""
    from brindle.sources import document_source

    (tmp_path / "sub").mkdir()
    for n in range(6):
        (tmp_path / "sub" / f"{n}.md").write_text(f"# Title {n}\n\nText {n}")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF")
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = document_source.documents(spark, str(tmp_path), bytes="40")
    assert rows.rdd.getNumPartitions() >= 3
    tried = rows.cache()
    assert sorted((r.kind, r.label, r.text) for r in readers.items_of(tried).collect()) == sorted(x for n in range(6) for x in (("text", "SECTION_HEADER", f"Title {n}"), ("text", "TEXT", f"Text {n}")))
    failed = readers.failures_of(tried).collect()
    assert [(r.path.rpartition("/")[2], r.error) for r in failed] == [("bad.pdf", "ValueError: no parser for .pdf files")] and len(failed[0].doc_id) == 32
    assert tried.where("path like '%empty.txt'").count() == 1
    plain = readers.parse_files(readers.raw_files(spark, str(tmp_path), "*"), readers.plain_parser)
    key = lambda df: sorted((r.doc_id, r.error or "", r.text or "", r.item_ord or 0) for r in df.collect())
    assert key(plain) == key(tried.where("path not like '%empty.txt'")), "Spark's binary reader leaves empty files out"
    assert document_source.documents(spark, str(tmp_path), pattern="*.md").select("path").distinct().count() == 6


def test_small_files_share_frames():
    """What a batch of small files holds goes on in few frames, in order, with a row for each file that fails or is empty."""
    import pandas as pd

    from brindle.sources import readers

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    run = readers.parse_files(Files(), readers.plain_parser)
    kinds = ("txt", "pdf", "md")
    pdf = pd.DataFrame([(f"f{i}.{kinds[i % 3]}", b"" if i % 3 == 2 else b"one\n\ntwo", f"d{i}") for i in range(3000)], columns=["path", "content", "doc_id"])
    frames = list(run([pdf]))
    assert [len(f) for f in frames] == [readers.FRAME_ROWS, 4000 - readers.FRAME_ROWS]
    rows = pd.concat(frames)
    assert rows["path"].drop_duplicates().tolist() == pdf["path"].tolist()
    assert rows.groupby("doc_id").size().loc[["d0", "d1", "d2"]].tolist() == [2, 1, 1]
    assert rows["error"].notna().sum() == 1000 and rows["kind"].notna().sum() == 2000
