"""Plans for retrieval, fusion, reranking, context, gates and metrics.

Passages of the benchmark table are the queries; a document is relevant when it holds the passage.
The vector of a document is the one with its number, and so is a query's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import evaluate, rag, retrieve, sparse_index
from brindle.plans.corpus import corpus_index, kept
from brindle.plans.registry import plan
from brindle.sources.readers import table

K_VALUES = [1, 3, 5, 10]

DENSE = """
  qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
  dv AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
  dsc AS (SELECT qid, id, round(list_cosine_similarity(q, v), 10) AS score FROM qv, dv),
  dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dsc) WHERE rank <= 50)"""
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
SPARSE = f"""
  qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
  dt AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2),
  idf AS (SELECT term, floor(ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) * 1000 + 1000)::BIGINT AS idf FROM dt GROUP BY 1),
  ssc AS (SELECT qid, id, sum(qtf * tf * idf)::BIGINT AS score FROM qt JOIN dt USING (term) JOIN idf USING (term) GROUP BY 1, 2),
  sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ssc) WHERE rank <= 50)"""
FUSED = f"""{DENSE}, {SPARSE},
  both_ AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.rank AS dr, b.rank AS sr, a.score AS dense_score, b.score::DOUBLE AS sparse_score,
    coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS rrf_score FROM dense a FULL JOIN sparse b ON a.qid = b.qid AND a.id = b.id),
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM both_) WHERE rank <= 50)"""
QTOK = "list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"
DTOK = "list_filter(regexp_split_to_array(lower(d.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
RERANKED = f"""{FUSED},
  rsc AS (SELECT f.qid, f.id, f.rrf_score, f.dense_score, f.rank AS old_rank, b.text AS query, d.text AS content, d.lang, round(len(list_intersect({QTOK}, {DTOK}))::DOUBLE / len({QTOK}), 6) AS rerank_score
    FROM fused f JOIN benchmark b ON b.item_id = f.qid JOIN documents d ON d.doc_id = f.id),
  reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, old_rank) AS rank FROM rsc) WHERE rank <= 5)"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _query_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = _queries(spark, d)
    return q.join(e, q["qid"] == e["vec_id"]).select("qid", "vec")


def _corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _sparse(spark, d):
    """The best by shared terms, from the stored index of the documents."""
    store = corpus_index(spark, d)
    asked = retrieve.term_counts(_queries(spark, d), "qid").withColumnRenamed("id", "qid")
    return sparse_index.top_k(store, sparse_index.weighted(store, asked)).withColumn("score", F.col("score").cast("long"))


def _fused(spark, d):
    return retrieve.fuse(retrieve.dense_top_k(_vectors(spark, d), _query_vectors(spark, d)), _sparse(spark, d))


def _reranked(spark, d):
    """Candidates meet their stored terms; no text is read."""
    terms = corpus_index(spark, d).read("vectors").select("id", "terms")
    # the candidates, few beside the corpus, are written first: they are sent to the stored terms, which stay where they lie
    found = kept(_fused(spark, d), "fused").join(terms, "id").join(_queries(spark, d).withColumnRenamed("text", "query"), "qid")
    return retrieve.rerank(found, 5, retrieve.overlap_of_terms(F.col("query"), F.col("terms")))


@plan(f"WITH {DENSE} SELECT qid, id, rank, round(score, 6) AS score FROM dense")
def dense_topk(spark, d):
    return retrieve.dense_top_k(_vectors(spark, d), _query_vectors(spark, d)).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@plan(f"WITH {SPARSE} SELECT qid, id, rank, score FROM sparse")
def sparse_topk(spark, d):
    return _sparse(spark, d).select("qid", "id", "rank", "score")


@plan(f"WITH {FUSED} SELECT qid, id, rank, round(rrf_score, 9) AS rrf_score, round(dense_score, 6) AS dense_score, round(coalesce(dense_score, sparse_score), 6) AS compat_dense_score FROM fused")
def hybrid_rrf(spark, d):
    """Flagship: dense and sparse branches, fused by reciprocal rank."""
    return _fused(spark, d).select("qid", "id", "rank", *[F.round(c, 9 if c == "rrf_score" else 6).alias(c) for c in ("rrf_score", "dense_score", "compat_dense_score")])


@plan(f"WITH {RERANKED} SELECT qid, id, rank, rerank_score, round(rrf_score, 9) AS rrf_score FROM reranked")
def rerank_topn(spark, d):
    return _reranked(spark, d).select("qid", "id", "rank", "rerank_score", F.round("rrf_score", 9).alias("rrf_score"))


@plan(f"WITH {FUSED} SELECT qid, id, rank, round(rrf_score, 9) AS rrf_score FROM fused WHERE rank <= 5")
def rerank_inactive(spark, d):
    fused = _fused(spark, d).withColumns({"query": F.lit(""), "content": F.lit("")})
    return retrieve.rerank(fused, 5).select("qid", "id", "rank", F.round("rrf_score", 9).alias("rrf_score"))


@plan(f"WITH {DENSE} SELECT qid, id, rank, round(score, 6) AS score FROM dense WHERE rank <= 8 AND score >= 0.2")
def image_search_min_score(spark, d):
    found = retrieve.image_search(_vectors(spark, d), _query_vectors(spark, d), 8, 0.2)
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


GOLD = """gold AS (SELECT b.item_id AS qid, list(d.doc_id ORDER BY d.doc_id) FILTER (d.doc_id IS NOT NULL) AS e FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"""


def metric_sql(expected: str, retrieved: str) -> str:
    """expected and retrieved: queries of (qid, e) and (qid, r), lists of text."""
    return f"""
  ex AS ({expected}), re AS ({retrieved}), k(k) AS (VALUES (1), (3), (5), (10)),
  rows_ AS (SELECT ex.qid, k.k, ex.e, coalesce(re.r, [])[1:k.k] AS c FROM ex LEFT JOIN re USING (qid), k WHERE len(coalesce(ex.e, [])) > 0),
  per AS (SELECT k, len(list_intersect(e, c))::DOUBLE / len(e) AS recall, len(list_intersect(e, c))::DOUBLE / greatest(len(c), 1) AS prec,
    coalesce(1.0::DOUBLE / list_min(list_filter(range(1, len(c) + 1), lambda i: list_contains(e, c[i]))), 0) AS mrr FROM rows_)"""


METRICS = "SELECT k, round(avg(recall), 6) AS recall, round(avg(prec), 6) AS precision, round(avg(mrr), 6) AS mrr, count(*) AS queries FROM per GROUP BY 1"


def _gold(spark, d):
    passages = _queries(spark, d).withColumnRenamed("text", "passage")
    return retrieve.holding(_corpus(spark, d), passages).select("qid", F.col("id").cast("string").alias("v"))


def _lists(rows, name, order=None):
    """rows (qid, v, rank): arrays per query, in order of rank where there is one."""
    if order is None:
        return rows.groupBy("qid").agg(F.array_sort(F.collect_set("v")).alias(name))
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "v"))), lambda s: s["v"]).alias(name))


def _results(spark, d, expected, retrieved):
    every = _queries(spark, d).select("qid")
    return every.join(_lists(expected, "expected"), "qid", "left").join(_lists(retrieved, "retrieved", "rank"), "qid", "left")


def _rounded(m):
    return m.select("k", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("k", "queries")], "queries")


def _ranked(spark, d, v):
    return _fused(spark, d).where(F.col("rank") <= max(K_VALUES)).select("qid", "rank", v.alias("v"))


@plan(f"WITH {FUSED}, {GOLD}, {metric_sql('SELECT qid, list_transform(e, lambda x: x::VARCHAR) AS e FROM gold', 'SELECT qid, list(id::VARCHAR ORDER BY rank) AS r FROM fused WHERE rank <= 10 GROUP BY 1')} {METRICS}")
def metrics_strict(spark, d):
    r = _results(spark, d, _gold(spark, d), _ranked(spark, d, F.col("id").cast("string")))
    return _rounded(evaluate.averages(evaluate.per_query(r, K_VALUES)))


ELEMENT = "CASE WHEN id % 5 = 4 THEN id::VARCHAR ELSE 'e' || (id // 3) END"


@plan(
    f"""WITH {FUSED}, {GOLD}, {metric_sql(f"SELECT qid, list_distinct(list_transform(e, lambda id: {ELEMENT})) AS e FROM gold", f"SELECT qid, list({ELEMENT} ORDER BY rank) AS r FROM fused WHERE rank <= 10 GROUP BY 1")} {METRICS}"""
)
def metrics_relaxed(spark, d):
    """Three documents make an element; every fifth belongs to none."""
    r = _results(spark, d, _gold(spark, d), _ranked(spark, d, F.col("id").cast("string")))
    elements = table(spark, d, "documents").where("doc_id % 5 <> 4").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("e"), F.floor(F.col("doc_id") / 3).cast("string")).alias("element_id"))
    return _rounded(evaluate.averages(evaluate.per_query(evaluate.relax(r, elements), K_VALUES)))


PAGE = "(id % 100) || '_' || (id // 100)"


@plan(f"""WITH {FUSED}, {GOLD}, {metric_sql(f"SELECT qid, list_distinct(list_transform(e, lambda id: {PAGE})) AS e FROM gold", f"SELECT qid, list({PAGE} ORDER BY rank) AS r FROM fused WHERE rank <= 10 GROUP BY 1")} {METRICS}""")
def metrics_pages(spark, d):
    def key(c):
        n = F.col(c).cast("long")
        return F.concat_ws("_", (n % 100).cast("string"), F.floor(n / 100).cast("string"))

    r = _results(spark, d, _gold(spark, d).select("qid", key("v").alias("v")), _ranked(spark, d, key("id")))
    return _rounded(evaluate.averages(evaluate.per_query(r, K_VALUES)))


@plan(
    f"""WITH {DENSE}, {metric_sql("SELECT qid, list(id::VARCHAR) AS e FROM (SELECT q.item_id AS qid, dv.id FROM benchmark q JOIN embeddings s ON s.vec_id = q.item_id JOIN dv ON dv.label = s.label AND dv.id <> s.vec_id) GROUP BY 1", "SELECT qid, list(id::VARCHAR ORDER BY rank) AS r FROM dense WHERE rank <= 10 GROUP BY 1")}
  SELECT k, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_rate, count(*) AS queries FROM per GROUP BY 1"""
)
def metrics_assets(spark, d):
    """Assets with a query's label are expected of the image branch."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = _queries(spark, d).join(e.withColumnRenamed("vec_id", "qid"), "qid").select("qid", "label")
    expected = q.join(e, "label").where("qid <> vec_id").select("qid", F.col("vec_id").cast("string").alias("v"))
    got = retrieve.dense_top_k(_vectors(spark, d), _query_vectors(spark, d), 10).select("qid", "rank", F.col("id").cast("string").alias("v"))
    return _rounded(evaluate.hit_rate(_results(spark, d, expected, got), K_VALUES))


@plan(
    f"""WITH {FUSED}, {GOLD}, rp AS (SELECT qid, {PAGE} AS page_key, rank FROM fused WHERE rank <= 10), pa AS (SELECT (vec_id % 100) || '_' || (vec_id // 100) AS page_key, vec_id % 13 AS asset FROM embeddings),
  k(k) AS (VALUES (1), (3), (5), (10)), g AS (SELECT qid, list_distinct(list_transform(e, lambda x: x % 13)) AS e FROM gold WHERE len(e) > 0)
  SELECT k.k, round(avg(CASE WHEN h.n > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_rate, count(*) AS queries
  FROM g CROSS JOIN k LEFT JOIN (SELECT rp.qid, k.k, count(*) AS n FROM rp JOIN k ON rp.rank <= k.k JOIN pa USING (page_key) JOIN g ON g.qid = rp.qid AND list_contains(g.e, pa.asset) GROUP BY 1, 2) h ON h.qid = g.qid AND h.k = k.k GROUP BY 1"""
)
def metrics_page_assets(spark, d):
    """Assets on the retrieved pages against the expected ones."""
    n = F.col("vec_id")
    pages = table(spark, d, "embeddings").select(F.concat_ws("_", (n % 100).cast("string"), F.floor(n / 100).cast("string")).alias("page_key"), (n % 13).alias("asset"))
    i = F.col("id")
    got = _fused(spark, d).where(F.col("rank") <= 10).select("qid", "rank", F.concat_ws("_", (i % 100).cast("string"), F.floor(i / 100).cast("string")).alias("page_key")).join(pages, "page_key")
    want = _gold(spark, d).select("qid", (F.col("v").cast("long") % 13).alias("asset")).distinct()
    ks = F.explode(F.lit(K_VALUES)).alias("k")
    hits = got.join(want, ["qid", "asset"], "left_semi").select("qid", "rank", ks).where(F.col("rank") <= F.col("k")).select("qid", "k").distinct().withColumn("hit", F.lit(1.0))
    return want.select("qid").distinct().select("qid", ks).join(hits, ["qid", "k"], "left").groupBy("k").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"), F.count("*").alias("queries"))


CONTEXT_DOCS = f"""{RERANKED}, cd AS (SELECT qid, id, rank, rerank_score, rrf_score, dense_score, content, CASE WHEN id % 4 = 0 THEN '' ELSE 'Manual ' || id END AS title, 'doc' || id AS doc_slug,
    CASE WHEN id % 3 = 0 THEN NULL ELSE (id % 7)::VARCHAR END AS page_label, id % 9 AS page_number, CASE WHEN id % 5 = 0 THEN 'asset_' || id END AS linked_asset_id FROM reranked),
  entries AS (SELECT *, chr(10) || '--- Source [S' || rank || ']: ' || coalesce(nullif(title, ''), doc_slug) || ' (Page ' || coalesce(nullif(page_label, ''), nullif(page_number, 0)::VARCHAR, '?') || ') ---' || chr(10)
    || coalesce('[Contains visual aid: ' || linked_asset_id || ']' || chr(10), '') || content || chr(10) AS entry FROM cd),
  kept AS (SELECT * FROM (SELECT *, sum(length(entry)) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM entries) WHERE upto <= 6000)"""


def _context_docs(spark, d):
    """The reranked rows with their texts, retrieved once whatever uses them, however often."""
    i = F.col("id")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return kept(_reranked(spark, d).join(texts, "id"), "context").select(
        "qid", "id", "rank", "rerank_score", "rrf_score", F.lit(None).cast("double").alias("score"), "content", i.cast("string").alias("chunk_id"), F.lit("text").alias("type"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Manual "), i.cast("string"))).alias("title"), F.concat(F.lit("doc"), i.cast("string")).alias("doc_slug"),
        F.when(i % 3 != 0, (i % 7).cast("string")).alias("page_label"), (i % 9).alias("page_number"), F.when(i % 5 == 0, F.concat(F.lit("asset_"), i.cast("string"))).alias("linked_asset_id"),
    )


@plan(f"WITH {CONTEXT_DOCS} SELECT q.qid, coalesce(c.context_md5, md5('')) AS context_md5, coalesce(c.chars, 0)::BIGINT AS chars, coalesce(c.labels, '') AS labels FROM (SELECT DISTINCT qid FROM cd) q LEFT JOIN (SELECT qid, md5(string_agg(entry, '' ORDER BY rank)) AS context_md5, max(upto) AS chars, string_agg('S' || rank, ',' ORDER BY rank) AS labels FROM kept GROUP BY 1) c USING (qid)")
def context_budget(spark, d):
    return rag.context(_context_docs(spark, d)).select("qid", F.md5("context").alias("context_md5"), "chars", F.array_join("allowed", ",").alias("labels"))


@plan(f"WITH {CONTEXT_DOCS} SELECT qid, rank, id::VARCHAR AS chunk_id, doc_slug, coalesce(page_label, '?') AS page_label, substr(content, 1, 100) || CASE WHEN length(content) >= 100 THEN '...' ELSE '' END AS content_preview, round(coalesce(nullif(rerank_score, 0), nullif(rrf_score, 0), 0), 6) AS score FROM cd")
def sources_preview(spark, d):
    return rag.sources(_context_docs(spark, d)).select("qid", "rank", "chunk_id", "doc_slug", "page_label", "content_preview", F.round("score", 6).alias("score"))


@plan(f"WITH {CONTEXT_DOCS} SELECT qid, rank, substr(content, 1, 100) || '...' AS content_preview, round(coalesce(rerank_score, rrf_score, 0), 6) AS score FROM cd")
def sources_preview_chain(spark, d):
    return rag.sources(_context_docs(spark, d), falsy=False).select("qid", "rank", "content_preview", F.round("score", 6).alias("score"))


@plan(f"WITH {CONTEXT_DOCS} SELECT qid, coalesce(nullif(rerank_score, 0), nullif(rrf_score, 0), 0) >= 0.75 AS passes FROM cd WHERE rank = 1")
def score_gate(spark, d):
    return rag.passes_score(_context_docs(spark, d), 0.75)


@plan(
    """WITH a AS (SELECT conv_id, turn, content || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' see [S1]' WHEN 2 THEN ' see [S1][S9]' ELSE ' see [S2] and [S1]' END AS answer FROM (SELECT conv_id, turn, text AS content FROM conversations)),
  c AS (SELECT *, list_distinct(regexp_extract_all(answer, '\\[(S\\d+)\\]', 1)) AS c FROM a)
  SELECT conv_id, turn, len(c) AS n_cited, len(c) > 0 AND len(list_filter(c, lambda x: x NOT IN ('S1', 'S2'))) = 0 AS holds FROM c"""
)
def citation_gate(spark, d):
    m = F.col("turn") % 4
    tail = F.when(m == 0, "").when(m == 1, " see [S1]").when(m == 2, " see [S1][S9]").otherwise(" see [S2] and [S1]")
    a = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("answer"))
    return a.select("conv_id", "turn", F.size(T.cited(F.col("answer"))).cast("long").alias("n_cited"), T.citations_hold(F.col("answer"), F.array(F.lit("S1"), F.lit("S2"))).alias("holds"))


@plan(f"WITH {SPARSE}, g AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM dt GROUP BY 1) SELECT term, df, tf, idf FROM g JOIN idf USING (term)")
def term_statistics(spark, d):
    """The inverted index by term."""
    return retrieve.term_statistics(retrieve.term_counts(_corpus(spark, d)), _corpus(spark, d))


@plan()
def answer_batch(spark, d):
    """The answering plan with the offline generator; text of prompts is free, so there is no SQL."""
    from brindle import providers

    q = _queries(spark, d).withColumnRenamed("text", "query")
    return rag.answer(_context_docs(spark, d), q, providers.extractive_answer).select("qid", "answer", "chars", "passes")


@plan(
    "WITH r AS (SELECT doc_id, 1 + doc_id % 5 AS rating, CASE doc_id % 4 WHEN 0 THEN 'faithfulness' WHEN 1 THEN 'completeness' WHEN 2 THEN 'citations' ELSE 'grounding' END AS dimension FROM documents) SELECT dimension, round(avg(rating), 6) AS mean, count(*) AS n FROM r GROUP BY 1"
)
def rubric_means(spark, d):
    """Manual ratings by dimension."""
    m = F.col("doc_id") % 4
    r = table(spark, d, "documents").select((1 + F.col("doc_id") % 5).alias("rating"), F.when(m == 0, "faithfulness").when(m == 1, "completeness").when(m == 2, "citations").otherwise("grounding").alias("dimension"))
    return r.groupBy("dimension").agg(F.round(F.avg("rating"), 6).alias("mean"), F.count("*").alias("n"))


