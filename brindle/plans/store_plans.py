"""Plans over stored tables and indexes: each builds its store from the given tables, changes it, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import dense_index, index, retrieve, sparse_index
from brindle.plans import jobs
from brindle.plans.corpus import own_folder
from brindle.plans.registry import plan
from brindle.plans.retrieval_plans import DENSE, TOKENS
from brindle.sources import document_source, ledger, readers, sinks
from brindle.sources.chats import Chats
from brindle.sources.readers import table
from brindle.sources.store import Store


def _store(spark, name: str) -> Store:
    return Store(spark, own_folder(spark, name))


@plan(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) AS nth FROM client_changes)
  SELECT client_id, change_id, segment, city, balance FROM c WHERE nth = 1 AND op <> 'D'"""
)
def store_merge(spark, d):
    """Changes of clients in three commits, upserts and tombstones, with a compaction between; what is read is the last state of clients that are left."""
    store = _store(spark, "clients")
    changes = table(spark, d, "client_changes").withColumn("at", F.struct("seq", "change_id"))
    for lo, hi in ((-1, 9), (9, 39), (39, 2**62)):
        last = index.last_by_key(changes.where((F.col("seq") > lo) & (F.col("seq") <= hi)), ["client_id"], "at")
        with store.commit() as c:
            c.upsert("clients", last.where("op <> 'D'").select("client_id", "change_id", "segment", "city", "balance"), ["client_id"], by="client_id", buckets=16)
            c.delete("clients", last.where("op = 'D'"))
        if lo == 9:
            store.compact("clients")
    return store.read("clients")


@plan("SELECT d.doc_id, length(text) AS chars, md5(text) AS text_md5 FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def scoped_read(spark, d):
    """Documents with a toxic label, of whose table only the buckets that hold them are opened."""
    store = _store(spark, "documents")
    with store.commit() as c:
        c.upsert("documents", table(spark, d, "documents"), ["doc_id"], by="doc_id")
    some = store.read("documents", table(spark, d, "labels").where("toxic = 1").select("doc_id"))
    return some.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@plan(f"WITH {DENSE.replace('FROM embeddings),', 'FROM embeddings WHERE label <> 3),').replace('FROM qv, dv)', 'FROM qv, dv WHERE label <> 5)')} SELECT qid, id, rank, round(score, 6) AS score FROM dense")
def dense_index_topk(spark, d):
    """The stored dense index after vectors of one label were deleted and those of another replaced, with a filter inside the search; all lists are visited, so the result is exact."""
    store = _store(spark, "dense")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid")).join(rows.select(F.col("id").alias("qid"), "vec"), "qid")
    with store.commit() as c:
        dense_index.add(store, c, rows)
    with store.commit() as c:
        dense_index.remove(store, c, rows.where("label = 3"))
        dense_index.add(store, c, rows.where("label = 4"))
    found = dense_index.search(store, queries, 50, dense_index.LISTS, F.col("label") != 5)
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


KEPT = f"dt AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents WHERE lang <> 'fr') GROUP BY 1, 2)"


@plan(
    f"""WITH qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2), {KEPT},
  idf AS (SELECT term, floor(ln(((SELECT count(*) FROM documents WHERE lang <> 'fr') + 1)::DOUBLE / (count(*) + 1)) * 1000 + 1000)::BIGINT AS idf FROM dt GROUP BY 1),
  s AS (SELECT qid, id, sum(qtf * tf * idf)::BIGINT AS score FROM qt JOIN dt USING (term) JOIN idf USING (term) GROUP BY 1, 2)
  SELECT qid, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""
)
def sparse_index_topk(spark, d):
    """The stored sparse index after documents of one language were removed and those of another replaced: weights and results are those of what is left."""
    store = _store(spark, "sparse")
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")

    def add(c, some):
        sparse_index.add(store, c, retrieve.term_vectors(some, "id"), ids=some.select("id"))

    with store.commit() as c:
        add(c, docs)
    with store.commit() as c:
        sparse_index.remove(store, c, docs.where("lang = 'fr'"))
    with store.commit() as c:
        add(c, docs.where("lang = 'de'"))
    asked = retrieve.term_counts(table(spark, d, "benchmark"), "item_id").withColumnRenamed("id", "qid")
    found = sparse_index.top_k(store, sparse_index.weighted(store, asked), 10)
    return found.select("qid", "id", "rank", F.col("score").cast("long").alias("score"))


@plan("SELECT conv_id, turn, md5(text) AS result, 1 AS tries FROM conversations")
def call_ledger(spark, d):
    """Calls for every message, of which the users' had been paid for before: their inputs are not called again, so no input has more than one try."""
    store = _store(spark, "calls")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    call = lambda text: F.md5(text.cast("binary"))
    ledger.answered(store, "calls", rows.where("role = 'user'"), call, "text", slices=2)
    got = ledger.answered(store, "calls", rows, call, "text", slices=2).withColumn("call_id", ledger.key_of(F.col("text")))
    return got.join(store.read("calls").select("call_id", "tries"), "call_id").select("conv_id", "turn", "result", "tries")


@plan(
    """WITH m AS (SELECT conv_id::VARCHAR AS chat_id, turn, role, text AS content FROM conversations WHERE conv_id % 3 <> 0),
  t AS (SELECT chat_id, arg_min(content, turn) FILTER (role = 'user') AS q, count(*) AS n, max(turn) AS last FROM m GROUP BY 1)
  SELECT chat_id, CASE WHEN q IS NULL THEN '' WHEN length(trim(replace(q, chr(10), ' '))) > 60 THEN NULL ELSE trim(replace(q, chr(10), ' ')) END AS short_title, n AS n_messages, printf('%05d', last) AS updated_at FROM t"""
)
def chat_store(spark, d):
    """Chats that are created, get their messages, and some of which are deleted with them: what is left, with titles of 60 characters at most and the time of the last message."""
    chats = Chats(_store(spark, "chats"))
    c = table(spark, d, "conversations")
    at = F.lpad(F.col("turn").cast("string"), 5, "0")
    messages = c.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").cast("string").alias("chat_id"), "turn", "role", F.col("text").alias("content"), at.alias("created_at"), F.lit(None).cast("string").alias("sources_json"), F.lit(None).cast("string").alias("attachments_json"))
    chats.create(messages.select("chat_id").distinct().select("chat_id", F.lit("").alias("title"), F.lit("00000").alias("created_at"), F.lit("").alias("updated_at")))
    chats.post(messages.where("turn < 2"))
    chats.post(messages.where("turn >= 2"))
    chats.delete(c.where("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("chat_id")))
    counts = chats.messages().groupBy("chat_id").agg(F.count("*").alias("n_messages"))
    cut = F.when(~F.col("title").endswith("..."), F.col("title"))
    return chats.chats().join(counts, "chat_id").select("chat_id", cut.alias("short_title"), "n_messages", "updated_at")


@plan(
    """SELECT page_id, CASE WHEN html LIKE '%lang="fr"%' THEN 0 ELSE 1 END AS registered, CASE WHEN html LIKE '%lang="fr"%' THEN 2 ELSE 0 END AS tries, CASE WHEN html LIKE '%lang="fr"%' THEN 'ValueError: no parser for .pdf files' END AS error FROM pages"""
)
def ingest_failures(spark, d):
    """Pages as files in 256 folders, French ones of a kind that has no parser, ingested twice: files that can't be read are failures, are offered again, and are not registered."""
    raw, out = own_folder(spark, "raw"), own_folder(spark, "ingested")
    suffix = F.when(F.col("html").contains('lang="fr"'), ".pdf").otherwise(".html")
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    files = table(spark, d, "pages").select(name.alias("asset_id"), F.concat(F.format_string("%03d/", F.pmod("page_id", F.lit(256))), name, suffix).alias("file_path"), F.concat(F.lit("<!-- "), name, F.lit(" -->"), "html").cast("binary").alias("blob"))
    sinks.save_blobs(files, raw)
    for _ in range(2):
        jobs.ingest(spark, raw, out, readers.plain_parser, pattern="page-*")
    store = Store(spark, out)
    page = F.regexp_extract(F.col("path"), "page-(\\d+)", 1).cast("long").alias("page_id")
    held = store.read("documents").select(F.col("source_uri").alias("path")).select(page, F.lit(1).alias("registered"), F.lit(0).alias("tries"), F.lit(None).cast("string").alias("error"))
    return held.unionByName(store.read("failures").select(page, F.lit(0).alias("registered"), "tries", "error"))


@plan(
    """SELECT page_id, CASE WHEN html LIKE '%lang="de"%' THEN 'ValueError: no parser for .bin files' END AS error, CASE WHEN html LIKE '%lang="de"%' THEN 0 ELSE 1 END AS parsed FROM pages"""
)
def document_files(spark, d):
    """Pages as files, German ones of a kind without a parser, read by the data source of documents: an outcome for each file."""
    raw = own_folder(spark, "files")
    suffix = F.when(F.col("html").contains('lang="de"'), ".bin").otherwise(".html")
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    sinks.save_blobs(table(spark, d, "pages").select(name.alias("asset_id"), F.concat(name, suffix).alias("file_path"), F.col("html").cast("binary").alias("blob")), raw)
    tried = document_source.documents(spark, raw, pattern="page-*", bytes=str(2**20))
    page = F.regexp_extract("path", "page-(\\d+)", 1).cast("long").alias("page_id")
    return tried.groupBy(page).agg(F.max("error").alias("error"), F.max((F.col("kind").isNotNull()).cast("int")).alias("parsed"))
