"""Plans over single records and small rules: identities, cuts, views, checks, upkeep counts, sparse vectors, uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle import config as C, providers
from brindle.functions import ids, text as T
from brindle.operators import assets, captions, chat, evaluate, index, layout, rag, retrieve
from brindle.plans.registry import plan
from brindle.sources.readers import table


def _documents(spark, d):
    return table(spark, d, "documents")


@plan("SELECT vec_id, 'asset_' || substr(md5('e' || vec_id), 1, 12) AS asset_id FROM embeddings")
def asset_ids(spark, d):
    return table(spark, d, "embeddings").select("vec_id", ids.asset_id(F.concat(F.lit("e"), F.col("vec_id").cast("string"))).alias("asset_id"))


@plan("SELECT doc_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT doc_id, CASE WHEN length(text) <= 12000 THEN text ELSE left(text, 12000) || chr(10) || chr(10) || '...[truncated]' END AS t FROM documents)")
def prompt_cut(spark, d):
    t = T.shorten_prompt(F.col("text"))
    return _documents(spark, d).select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t.cast("binary")).alias("text_md5"))


@plan("SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def iso_times(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.iso_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))


@plan(
    """WITH v AS (SELECT vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0.28) AS own, list_filter(range(len(embedding)), lambda i: embedding[i + 1] < -0.2) AS other, embedding FROM embeddings)
  SELECT vec_id, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE other END, ',') AS indices, round(coalesce(list_sum(list_transform(CASE WHEN len(own) > 0 THEN own ELSE other END, lambda i: embedding[i + 1]::DOUBLE)), 0), 6) AS total FROM v"""
)
def sparse_choice(spark, d):
    """A stored sparse vector (large components) counts unless both of its arrays are empty; then the other one (small components) does."""
    e = table(spark, d, "embeddings")
    cells = F.transform("embedding", lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("x")))

    def sparse(keep):
        some = F.filter(cells, lambda c: keep(c["x"].cast("double")))
        return F.struct(F.transform(some, lambda c: c["i"]).alias("indices"), F.transform(some, lambda c: c["x"]).alias("values"))

    chosen = e.select("vec_id", index.choose_sparse(sparse(lambda x: x > 0.28), sparse(lambda x: x < -0.2)).alias("s"))
    return chosen.select("vec_id", F.array_join("s.indices", ",").alias("indices"), F.round(F.aggregate("s.values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@plan(
    """WITH m AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS m FROM conversations)
  SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(m) + 1), lambda i: list_position(m, m[i]) = i), lambda i: m[i]), ',') AS members FROM m"""
)
def safe_set(spark, d):
    """The words of a message as members, with white space around some and nulls between: trimmed, in order, without empty ones and repeats."""
    padded = F.transform(F.split("text", " "), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("\t "), x)).when(i % 3 == 1, F.concat(x, F.lit("  "))).otherwise(x))
    members = F.concat(padded, F.array(F.lit(None).cast("string"), F.lit(" ")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.safe_set(members), ",").alias("members"))


@plan(
    """WITH a AS (SELECT item_id, text, greatest(0, (length(text) + 59) // 60) AS n FROM benchmark)
  SELECT item_id, n + 2 AS n_events, 'start' AS first_type, 'final' AS last_type, text AS joined FROM a"""
)
def stream_events(spark, d):
    """A start, slices of 60 characters whose concatenation is the answer, and the whole."""
    e = table(spark, d, "benchmark").select("item_id", T.events(F.col("item_id"), F.col("text")).alias("e"))
    tokens = F.filter("e", lambda x: x["type"] == "token")
    return e.select("item_id", F.size("e").cast("long").alias("n_events"), F.col("e")[0]["type"].alias("first_type"), F.element_at("e", -1)["type"].alias("last_type"), F.array_join(F.transform(tokens, lambda x: x["content"]), "").alias("joined"))


@plan("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'l' || (doc_id % 7) || ',t' || CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 11 END || ',r5,b0' END AS box FROM documents")
def box_edges(spark, d):
    k = F.col("doc_id")
    box = F.when(k % 4 != 0, F.struct((k % 7).cast("double").alias("l"), F.when(k % 3 != 0, (k % 11).cast("double")).alias("t"), F.lit(5.0).alias("r"), F.lit(None).cast("double").alias("b")))
    named = F.zip_with(F.array(*map(F.lit, "ltrb")), F.transform("e", lambda x: x.cast("long").cast("string")), lambda n, x: F.concat(n, x))
    return _documents(spark, d).select("doc_id", layout.edges(box).alias("e")).select("doc_id", F.when(F.col("e").isNotNull(), F.array_join(named, ",")).alias("box"))


@plan("SELECT doc_id % 30 AS doc_id, count(*) FILTER (doc_id % 4 < 2) AS n_text, count(*) FILTER (doc_id % 4 = 2) AS n_table, count(*) FILTER (doc_id % 4 = 3) AS n_image FROM documents GROUP BY 1")
def item_counts(spark, d):
    k = F.col("doc_id")
    items = _documents(spark, d).select((k % 30).alias("doc_id"), F.element_at(F.array(*map(F.lit, ("text", "text", "table", "image"))), (k % 4 + 1).cast("int")).alias("kind"))
    return layout.item_counts(items)


def _versions(spark, d):
    k = F.col("doc_id")
    docs = _documents(spark, d)
    now = docs.where("doc_id % 2 = 0").select(k.alias("k"), F.lit("old").alias("v"), F.lit(0).cast("long").alias("at"))
    new = docs.select((k - k % 3).alias("k"), F.concat(F.lit("new"), k.cast("string")).alias("v"), k.alias("at"))
    return now, new


@plan(
    """WITH n AS (SELECT doc_id - doc_id % 3 AS k, max(doc_id) AS newest FROM documents GROUP BY 1)
  SELECT k, 'new' || newest AS v FROM n UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT k FROM n)"""
)
def upsert_repeated(spark, d):
    """Of new rows that share a key, the last by order replaces the old one."""
    now, new = _versions(spark, d)
    return index.upsert(now, new, ["k"], "at").select("k", "v")


@plan(
    """WITH n AS (SELECT DISTINCT doc_id - doc_id % 3 AS k FROM documents), o AS (SELECT doc_id AS k FROM documents WHERE doc_id % 2 = 0)
  SELECT count(*) AS upserted, count(*) FILTER (o.k IS NULL) AS inserted, count(o.k) AS replaced FROM n LEFT JOIN o USING (k)"""
)
def upsert_counts(spark, d):
    now, new = _versions(spark, d)
    return index.upsert_counts(now, new, ["k"])


@plan("SELECT count(*) FILTER (doc_id % 7 = 0 AND doc_id % 40 < 30) AS removed FROM documents")
def prune_counts(spark, d):
    """Chunks that are gone, of documents that still have some."""
    k = F.col("doc_id")
    rows = _documents(spark, d).select(F.concat(F.lit("d"), (k % 40).cast("string")).alias("doc_id"), F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), k.alias("n"))
    return index.prune_counts(rows, rows.where("n % 7 <> 0 AND n % 40 < 30"))


@plan("SELECT change_id, city AS page_label, segment AS section, NULL::VARCHAR AS absent FROM client_changes")
def flat_or_nested(spark, d):
    """A flat column counts even where it is null; without one the nested field does, and without both null."""
    c = table(spark, d, "client_changes")
    rows = c.select("change_id", F.col("city").alias("page_label"), F.struct(F.col("source").alias("page_label"), F.col("segment").alias("section")).alias("metadata"))
    return rows.select("change_id", *[index.meta(rows, k).alias(k) for k in ("page_label", "section", "absent")])


@plan("SELECT conv_id::VARCHAR || '-' || turn AS id, conv_id::VARCHAR AS chat_id, role, text AS content, CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS n_sources FROM conversations")
def message_views(spark, d):
    c = table(spark, d, "conversations")
    chat_id, turn = F.col("conv_id").cast("string"), F.col("turn")
    sources = F.when(turn % 2 == 0, F.lit('["a", {"b": 1}]'))
    rows = c.select(F.concat_ws("-", chat_id, turn.cast("string")).alias("message_id"), chat_id.alias("chat_id"), "role", F.col("text").alias("content"), F.lit("").alias("created_at"), sources.alias("sources_json"), F.lit(None).cast("string").alias("attachments_json"))
    return chat.message_view(rows).select("id", "chat_id", "role", "content", F.size("sources").alias("n_sources"))


@plan(
    """SELECT click_id, array_to_string(list_filter(['device', 'items', 'k', 'other', 'tags'], lambda x: NOT list_contains(CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_keys(props) ELSE [] END, x)), ',') AS missing FROM clicks"""
)
def gold_missing_keys(spark, d):
    """Records of all shapes, broken and null ones too; the keys that each lacks, in order."""
    return table(spark, d, "clicks").select("click_id", F.array_join(evaluate.missing_keys(F.col("props"), ("k", "device", "tags", "items", "other")), ",").alias("missing"))


@plan(
    """WITH r AS (SELECT doc_id AS n, CASE WHEN doc_id % 2 = 0 THEN 'd' || (doc_id % 10) END AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN 's' || (doc_id % 10) ELSE '' END AS slug, CASE WHEN doc_id % 5 <> 0 THEN 's' || (doc_id % 6) END AS title, CASE WHEN doc_id % 4 <> 0 THEN 'p' || (doc_id % 4) END AS label, doc_id % 3 AS page FROM documents),
  p AS (SELECT n, coalesce(doc_id, CASE WHEN substr(coalesce(nullif(slug, ''), title), 2)::INT < 8 THEN 'd' || substr(coalesce(nullif(slug, ''), title), 2) END) AS doc, coalesce(label, nullif(page, 0)::VARCHAR) AS page FROM r)
  SELECT n, doc || '_' || page AS page_key FROM p"""
)
def result_page_keys(spark, d):
    """Without a doc_id the slug, or else the title, names the document; eight slugs are known."""
    k = F.col("doc_id")
    s = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    rows = _documents(spark, d).select(k.alias("n"), F.when(k % 2 == 0, s("d", 10)).alias("doc_id"), F.when(k % 3 != 0, s("s", 10)).otherwise("").alias("doc_slug"), F.when(k % 5 != 0, s("s", 6)).alias("title"), F.when(k % 4 != 0, s("p", 4)).alias("page_label"), (k % 3).alias("page_number"))
    slugs = spark.range(8).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("slug"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("slug_doc"))
    return evaluate.result_pages(rows, slugs).select("n", "page_key")


@plan(
    """WITH s AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT * FROM s WHERE v > 0.15),
  x AS (SELECT q.vec_id AS qid, p.vec_id AS id, round(sum(q.v * p.v), 10) AS score FROM p q JOIN p ON p.i = q.i WHERE q.vec_id % 25 = 0 GROUP BY 1, 2)
  SELECT qid, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10"""
)
def sparse_vector_topk(spark, d):
    """Stored sparse vectors: the components of an embedding above 0.15."""
    e = table(spark, d, "embeddings")
    at = F.filter(F.transform(F.col("embedding"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > F.lit(0.15))
    sparse = e.select(F.col("vec_id").alias("id"), F.struct(F.transform(at, lambda s: s["i"]).alias("indices"), F.transform(at, lambda s: s["x"]).alias("values")).alias("sparse"))
    queries = sparse.where("id % 25 = 0").withColumnRenamed("id", "qid")
    return retrieve.sparse_vector_top_k(sparse, queries, 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@plan("SELECT doc_id, len(list_distinct(w)) AS n_terms, len(w)::DOUBLE AS n_words FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)")
def sparse_encoded(spark, d):
    """The offline sparse encoder: an index per distinct term (but for chance collisions among 2^31), counts as values."""
    s = _documents(spark, d).select("doc_id", retrieve.sparse_encode(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s.indices").cast("long").alias("n_terms"), F.aggregate("s.values", F.lit(0.0), lambda a, x: a + x).alias("n_words"))


@plan(
    """WITH i AS (SELECT doc_id, n_chars % 9001 AS w, (7 * n_chars + doc_id) % 12007 AS h FROM documents)
  SELECT doc_id, w AS width, h AS height, CASE WHEN w * h = 0 THEN 'undecodable' WHEN w * h > 40000000 THEN 'too_many_pixels' END AS problem FROM i"""
)
def image_rules(spark, d):
    """PNG heads whose width and height follow a document's length."""
    w, h = F.col("n_chars") % 9001, (7 * F.col("n_chars") + F.col("doc_id")) % 12007
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0"), F.lit("0806000000")))
    size = assets.image_size(head)
    return table(spark, d, "documents").select("doc_id", size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height"), assets.image_problem(head).alias("problem"))


@plan("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '{"a": ' || doc_id || ', "b": [1, "}"]}' END AS json FROM documents""")
def first_json(spark, d):
    """The first whole JSON value between other brackets and text."""
    whole = F.concat(F.lit('See [1 and {"a": '), F.col("doc_id").cast("string"), F.lit(', "b": [1, "}"]} then {"c": 2}'))
    return _documents(spark, d).select("doc_id", captions.first_json(F.when(F.col("doc_id") % 4 == 0, F.lit("no [value {here")).otherwise(whole)).alias("json"))


@plan("SELECT asset_no, CASE WHEN asset_no % 4 = 0 THEN 3 WHEN asset_no % 5 = 0 THEN NULL ELSE 1 END::INT AS n FROM (SELECT vec_id AS asset_no FROM embeddings)")
def embeddings_filled(spark, d):
    """The whole manifest: kept vectors (length 3), new ones (1) where the file is there, none elsewhere."""
    n = F.col("vec_id")
    path = F.concat(F.lit("a/"), n.cast("string"), F.lit(".png"))
    manifest = table(spark, d, "embeddings").select(n.alias("asset_no"), n.cast("string").alias("asset_id"), path.alias("file_path"), F.when(n % 4 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).cast("array<float>")).alias("embedding"))
    files = manifest.where("asset_no % 5 <> 0").select("file_path")
    filled = assets.backfill(manifest, files, lambda p: F.array(F.length(p).cast("float")))
    return filled.select("asset_no", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n"))


@plan(f"SELECT vec_id AS qid, CASE WHEN vec_id % 3 = 0 THEN {C.NO_ANSWER!r} ELSE 'Panel ' || vec_id || ' of the unit. [S1]' END AS answer FROM embeddings".replace('"' + C.NO_ANSWER + '"', "'" + C.NO_ANSWER.replace("'", "''") + "'"))
def image_answers(spark, d):
    """Answers from one image hit a query; every third hit has no caption."""
    n = F.col("vec_id")
    caption = F.when(n % 3 != 0, F.concat(F.lit("Panel "), n.cast("string"), F.lit(" of the unit. Its rest.")))
    hits = table(spark, d, "embeddings").select(n.alias("qid"), F.lit(1).alias("rank"), F.concat(F.lit("asset_"), n.cast("string")).alias("asset_id"), caption.alias("caption"), F.lit("Manual").alias("title"), F.lit("manual").alias("doc_slug"), F.lit("4").alias("page_label"), F.lit(0.5).alias("score"))
    return rag.answer_images(hits, hits.select("qid", F.lit("").alias("query")), providers.extractive_answer).select("qid", "answer")
