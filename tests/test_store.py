"""Tables of a store: layers, commits, versions, and what is built on them."""

import os

import pytest
from pyspark.sql import functions as F

from brindle.sources import files, ledger
from brindle.sources.chats import Chats
from brindle.sources.store import Conflict, Store
from brindle.streaming import incremental

ROWS = "doc_id string, chunk_id string, v int"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_upserts_and_tombstones(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("t") is None and s.tables() == []
    with s.commit() as c:
        assert c.upsert("t", spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 3), ("b", "3", 4)], ROWS), ["chunk_id"], "v", by="doc_id") == 3
    with s.commit() as c:
        assert c.upsert("t", spark.createDataFrame([("a", "2", 20), ("c", "4", 40)], ROWS), ["chunk_id"]) == 2
        assert c.delete("t", spark.createDataFrame([("b", "3")], "doc_id string, chunk_id string")) == 1
    assert rows_of(s.read("t"), "chunk_id", "v") == [("1", 1), ("2", 20), ("4", 40)]
    with s.commit() as c:
        c.upsert("t", spark.createDataFrame([("b", "3", 5, "new")], ROWS + ", extra string"), ["chunk_id"])
    want = [("1", 1), ("2", 20), ("3", 5), ("4", 40)]
    assert rows_of(s.read("t"), "chunk_id", "v") == want and set(s.read("t").columns) == {"doc_id", "chunk_id", "v", "extra"}
    assert rows_of(s.read("t", version=1), "chunk_id", "v") == [("1", 1), ("2", 2), ("3", 4)]
    assert s.compact() == ["t"] and s.compact() == [] and rows_of(s.read("t"), "chunk_id", "v") == want
    assert all(not x["changes"] for x in s.head()["tables"]["t"]["layers"])
    for n in range(3):
        with s.commit() as c:
            c.append("log", spark.createDataFrame([(n,)], "n int"))
    assert s.compact("log", most=2) == ["log"] and len(s.head()["tables"]["log"]["layers"]) == 1 and rows_of(s.read("log"), "n") == [(0,), (1,), (2,)]
    one = spark.createDataFrame([("a",)], "doc_id string")
    assert rows_of(s.read("t", one), "chunk_id") == [("1",), ("2",)]
    with pytest.raises(ValueError):
        with s.commit() as c:
            c.upsert("flat", one, ["doc_id"])
        s.read("flat", one)


def test_a_change_writes_what_it_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    many = spark.range(200_000).select(F.col("id").cast("string").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    with s.commit() as c:
        c.upsert("t", many, ["chunk_id"])
    before = size(tmp_path)
    with s.commit() as c:
        assert c.upsert("t", many.limit(2000).withColumn("v", F.upper("v")), ["chunk_id"]) == 2000
    assert size(tmp_path) - before < 0.03 * before
    assert s.read("t").count() == 200_000 and s.read("t").where("v = upper(v) and v <> lower(v)").count() == 2000


def test_scoped_reads_open_few_files(spark, tmp_path):
    """Of 500 documents, five are read: some hundredth of the bytes."""
    s = Store(spark, str(tmp_path))
    every = spark.range(500).select(F.col("id").cast("string").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("n")).withColumn("chunk_id", F.col("n").cast("string")).withColumn("v", F.sha2(F.concat_ws("-", "doc_id", "chunk_id"), 512))
    with s.commit() as c:
        c.upsert("t", every, ["doc_id", "chunk_id"], by="doc_id", buckets=250)
    read = s.read("t", spark.createDataFrame([("7",), ("8",), ("9",)], "doc_id string"))
    assert read.count() == 120
    opened = sum(os.path.getsize(f.removeprefix("file://")) for f in read.inputFiles())
    plan = read._jdf.queryExecution()
    metrics = {}
    plan.executedPlan().execute().count()

    def visit(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return visit(node.executedPlan())
        if "QueryStage" in name:
            return visit(node.plan())
        if "Scan parquet" in name:
            metrics[len(metrics)] = node.metrics().get("filesSize").get().value()
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan.executedPlan())
    assert metrics and sum(metrics.values()) < 0.05 * size(tmp_path) and opened <= size(tmp_path)


def test_commits_of_several_tables(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    a = spark.createDataFrame([("a", 1)], "k string, v int")
    with s.commit() as c:
        c.upsert("x", a, ["k"])
        c.upsert("y", a, ["k"])
    with pytest.raises(OSError), s.commit() as c:
        c.upsert("x", a.withColumn("v", F.lit(2)), ["k"])
        raise OSError("lost between two tables")
    assert [s.read(t).first()["v"] for t in ("x", "y")] == [1, 1] and s.head()["version"] == 1
    with monkeypatch.context() as m:
        m.setattr(files, "put_new", lambda *_: (_ for _ in ()).throw(OSError("lost before the pointer")))
        with pytest.raises(OSError), s.commit() as c:
            c.delete("x", a)
    assert s.read("x").count() == 1
    with pytest.raises(Conflict), s.commit() as slow:
        slow.upsert("x", a.withColumn("v", F.lit(3)), ["k"])
        with s.commit() as fast:
            fast.upsert("y", a.withColumn("v", F.lit(4)), ["k"])
    assert [s.read(t).first()["v"] for t in ("x", "y")] == [1, 4]
    assert not [n for n in os.listdir(tmp_path) if n.startswith("_")]


def test_expiry_keeps_readers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for v in range(5):
        with s.commit() as c:
            c.replace("t", spark.createDataFrame([("a", v)], "k string, v int"))
        if v == 1:
            pin = s.pinned()
            held = s.read("t", version=pin.__enter__())
    assert s.expire(keep=2) == 0, "layers are younger than a day"
    assert s.expire(keep=2, hours=0) == 2
    assert held.first()["v"] == 1 and s.read("t").first()["v"] == 4 and s.read("t", version=4).first()["v"] == 3
    pin.__exit__(None, None, None)
    assert s.expire(keep=1, hours=0) == 2 and s.read("t").first()["v"] == 4 and sorted(n for n in os.listdir(tmp_path) if n.startswith("CUR")) == ["CURRENT-5"]


def test_replayed_batches_commit_nothing(spark, tmp_path):
    src, root = str(tmp_path / "s"), str(tmp_path / "t")
    schema = "k string, v int"

    def run(checkpoint):
        stream = incremental.read_stream(spark, src, schema)
        incremental.store_stream(stream, root, "t", str(tmp_path / checkpoint), ["k"], "v").awaitTermination()

    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(src)
    run("c1")
    spark.createDataFrame([("b", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    run("c1")
    s = Store(spark, root)
    assert rows_of(s.read("t"), "k", "v") == [("a", 1), ("b", 2)] and s.head()["marks"] == {"stream": 1}
    version = s.head()["version"]
    run("c2")  # as if the checkpoint were lost: batch 0 comes again
    assert s.head()["version"] == version and rows_of(s.read("t"), "k", "v") == [("a", 1), ("b", 2)]


def test_streams_forget(spark, tmp_path):
    """A repeated id is dropped; once the watermark has passed it, its state is gone."""
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    schema = "doc_id string, at timestamp"

    def run(rows):
        spark.createDataFrame(rows, "doc_id string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(src)
        seen = incremental.first_seen(incremental.read_stream(spark, src, schema), forget="1 day")
        q = seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    run([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01")])
    assert run([("b", "2024-01-01"), ("c", "2024-01-09")]) == 1, "only the last one is remembered"
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_calls_are_paid_once(spark, tmp_path):
    """A model that fails in the middle: the slices before are kept, and no input is called again."""
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def model(broken):
        @F.pandas_udf("string")
        def ask(x):
            import os
            import uuid

            for v in x:
                if v == broken:
                    raise RuntimeError("down")
                with open(os.path.join(folder, f"{v}-{uuid.uuid4().hex}"), "w"):
                    pass
            return x.map(lambda v: None if v == "empty" else f"said {v}")

        return ask

    rows = spark.createDataFrame([(i, f"q{i % 12}") for i in range(40)] + [(99, "empty")], "id int, text string").repartition(2)
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match="down"):
        ledger.answered(s, "calls", rows, model("q7"), "text", slices=12)
    kept = {r["call_id"] for r in s.read("calls").collect()}
    before = len(os.listdir(calls))
    got = {r["id"]: r["result"] for r in ledger.answered(s, "calls", rows, model(None), "text", slices=12).collect()}
    assert got == {i: f"said q{i % 12}" for i in range(40)} | {99: None}
    paid = [n.split("-")[0] for n in os.listdir(calls)]
    assert kept and len(kept) <= before, "what was committed was called before the failure"
    assert s.read("calls").count() == 13
    n = len(paid)
    ledger.answered(s, "calls", rows, model("q7"), "text", slices=12)
    again = [x.split("-")[0] for x in os.listdir(calls)]
    assert len(again) == n + 1 and again.count("empty") == paid.count("empty") + 1, "only the call without a result is tried again"


def test_chats(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    chats = Chats(s)
    chats.create(spark.createDataFrame([("c1", "", "2024-01-01", "2024-01-01"), ("c2", "Named", "2024-01-02", "2024-01-02")], "chat_id string, title string, created_at string, updated_at string"))
    kind = "message_id string, chat_id string, turn long, role string, content string, created_at string, sources_json string, attachments_json string"
    message = lambda i, c, t, role: (f"m{i}", c, t, role, f"text {i}", f"2024-02-0{i}", None, None)
    assert chats.post(spark.createDataFrame([message(1, "c1", 0, "user"), message(2, "c1", 1, "assistant"), message(3, "c2", 0, "user")], kind)) == 3
    assert rows_of(chats.chats(), "chat_id", "title", "updated_at") == [("c1", "text 1", "2024-02-02"), ("c2", "Named", "2024-02-03")]
    chats.post(spark.createDataFrame([message(4, "c1", 2, "user")], kind))
    assert rows_of(chats.chats(), "chat_id", "title", "updated_at")[0] == ("c1", "text 1", "2024-02-04")
    with pytest.raises(KeyError):
        chats.post(spark.createDataFrame([message(5, "none", 0, "user")], kind))
    assert chats.messages().count() == 4
    chats.rename(spark.createDataFrame([("c1", "Mine", "2024-03-01")], "chat_id string, title string, updated_at string"))
    assert chats.delete(spark.createDataFrame([("c2",), ("never",)], "chat_id string")) == (1, 1)
    assert rows_of(chats.chats(), "chat_id", "title") == [("c1", "Mine")] and chats.messages().select("chat_id").distinct().count() == 1
