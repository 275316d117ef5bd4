"""Plans for manifests, asset resolution and index maintenance.

The embeddings table stands in for an asset manifest: vector n belongs to element e(n % 400) of
document n % 100, page n % 7.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import ids
from brindle.operators import assets, evaluate, index
from brindle.operators.report import check_files
from brindle.plans.registry import plan
from brindle.sources.readers import table

MANIFEST = """manifest AS (SELECT vec_id AS pos, 'asset_' || substr(md5('e' || vec_id), 1, 12) AS asset_id, 'e' || (vec_id % 400) AS element_id, 'd' || (vec_id % 100) AS doc_id, (vec_id % 7)::VARCHAR AS page_label,
    CASE WHEN vec_id % 3 = 0 THEN 'table_asset' ELSE 'image_asset' END AS type, 'assets/' || vec_id || CASE WHEN vec_id % 3 = 0 THEN '.html' ELSE '.png' END AS file_path FROM embeddings)"""
RETRIEVED = """docs AS (SELECT doc_id // 5 AS qid, (doc_id % 5 + 1)::INT AS rank, CASE WHEN doc_id % 4 = 0 THEN 'asset_' || substr(md5('e' || (doc_id % 600)), 1, 12) END AS linked, CASE WHEN doc_id % 4 = 1 THEN 'e' || (doc_id % 700) ELSE 'none' END AS elem,
    'd' || (doc_id % 120) AS doc, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 9)::VARCHAR END AS pl, doc_id % 8 AS pn FROM documents)"""
RESOLVED = f"""{MANIFEST}, {RETRIEVED},
  by_asset AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY pos DESC) = 1),
  by_element AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY pos DESC) = 1),
  direct AS (SELECT d.*, coalesce(a.pos, e.pos) AS mpos FROM docs d LEFT JOIN by_asset a ON a.asset_id = d.linked LEFT JOIN by_element e ON e.element_id = d.elem),
  hits AS (SELECT qid, rank, 0 AS ofs, mpos AS pos FROM direct WHERE mpos IS NOT NULL
    UNION ALL SELECT d.qid, d.rank, m.pos, m.pos FROM direct d JOIN manifest m ON m.doc_id = d.doc AND m.page_label = coalesce(nullif(d.pl, ''), d.pn::VARCHAR) WHERE d.mpos IS NULL),
  seen AS (SELECT h.qid, h.rank, h.ofs, m.* FROM hits h JOIN manifest m USING (pos) QUALIFY row_number() OVER (PARTITION BY h.qid, m.asset_id ORDER BY h.rank, h.ofs) = 1),
  resolved AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, ofs)::INT AS place FROM seen)"""


def _manifest(spark, d):
    v = F.col("vec_id")
    s = v.cast("string")
    return table(spark, d, "embeddings").select(
        v.alias("pos"), ids.asset_id(F.concat(F.lit("e"), s)).alias("asset_id"), F.concat(F.lit("e"), (v % 400).cast("string")).alias("element_id"), F.concat(F.lit("d"), (v % 100).cast("string")).alias("doc_id"), (v % 7).cast("string").alias("page_label"),
        F.when(v % 3 == 0, "table_asset").otherwise("image_asset").alias("type"), F.concat(F.lit("assets/"), s, F.when(v % 3 == 0, ".html").otherwise(".png")).alias("file_path"), "embedding",
    )


def _retrieved(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.floor(i / 5).alias("qid"), (i % 5 + 1).cast("int").alias("rank"), F.when(i % 4 == 0, ids.asset_id(F.concat(F.lit("e"), (i % 600).cast("string")))).alias("linked_asset_id"), F.when(i % 4 == 1, F.concat(F.lit("e"), (i % 700).cast("string"))).otherwise("none").alias("element_id"),
        F.when(i % 3 == 0, "").otherwise((i % 9).cast("string")).alias("page_label"), (i % 8).alias("page_number"), F.concat(F.lit("d"), (i % 120).cast("string")).alias("doc_id"), F.concat(F.lit("slug"), (i % 120).cast("string")).alias("doc_slug"),
    )


@plan(f"WITH {RESOLVED} SELECT qid, place AS pos, asset_id, type, file_path, page_label, element_id FROM resolved")
def asset_resolve(spark, d):
    return assets.resolve(_retrieved(spark, d), _manifest(spark, d))


HITS = """clip AS (SELECT doc_id // 5 AS qid, (doc_id % 5 + 1)::INT AS rank, 'asset_' || substr(md5('e' || (doc_id * 7 % 500)), 1, 12) AS asset_id, 'd' || (doc_id * 7 % 100) AS doc_id, (doc_id * 7 % 7)::VARCHAR AS page_label, 'assets/' || (doc_id * 7 % 500) AS file_path FROM documents)"""


@plan(
    f"""WITH {RESOLVED}, {HITS},
  a AS (SELECT qid, 0 AS grp, place AS ofs, asset_id, doc_id, file_path, page_label FROM resolved WHERE place <= 6),
  b AS (SELECT c.qid, 1, c.rank, c.asset_id, c.doc_id, c.file_path, c.page_label FROM clip c WHERE EXISTS (SELECT 1 FROM docs d WHERE d.qid = c.qid AND d.doc = c.doc_id)),
  u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t QUALIFY row_number() OVER (PARTITION BY qid, asset_id ORDER BY grp, ofs) = 1),
  cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grp, ofs)::INT AS pos FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY grp, ofs) <= 6)
  SELECT qid, pos, asset_id, doc_id, file_path, page_label, '/assets/' || asset_id AS url FROM cut WHERE EXISTS (SELECT 1 FROM docs d WHERE d.qid = cut.qid AND (d.linked = cut.asset_id OR coalesce(nullif(d.pl, ''), nullif(d.pn, 0)::VARCHAR) = cut.page_label))"""
)
def attachments_filter(spark, d):
    i = F.col("doc_id")
    n = i * 7
    hits = table(spark, d, "documents").select(F.floor(i / 5).alias("qid"), (i % 5 + 1).cast("int").alias("rank"), ids.asset_id(F.concat(F.lit("e"), (n % 500).cast("string"))).alias("asset_id"), F.concat(F.lit("d"), (n % 100).cast("string")).alias("doc_id"), F.lit(None).cast("string").alias("doc_slug"), (n % 7).cast("string").alias("page_label"), F.concat(F.lit("assets/"), (n % 500).cast("string")).alias("file_path"), F.lit("image_asset").alias("type"))
    docs, m = _retrieved(spark, d), _manifest(spark, d)
    return assets.attachments(assets.resolve(docs, m, 6), hits, docs, m, 6).select("qid", "pos", "asset_id", "doc_id", "file_path", "page_label", "url")


CAPTIONED = """reg AS (SELECT doc_id AS pos, 'd' || (doc_id % 90) AS doc_id, source AS doc_slug, lang AS title FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 90 ORDER BY doc_id DESC) = 1),
  cap AS (SELECT 'e' || (doc_id % 300) AS element_id, substr(text, 1, 40) AS caption FROM documents WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) = 1)"""


@plan(f"WITH {MANIFEST}, {CAPTIONED} SELECT asset_id, m.element_id, m.doc_id, doc_slug, title, type, page_label, caption FROM manifest m LEFT JOIN reg USING (doc_id) LEFT JOIN cap ON cap.element_id = m.element_id")
def asset_index_join(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents")
    reg = t.select(i.alias("pos"), F.col("source").alias("doc_slug"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("source_uri"), F.concat(F.lit("d"), (i % 90).cast("string")).alias("doc_id"))
    chunks = t.select(i.alias("pos"), F.concat(F.lit("e"), (i % 300).cast("string")).alias("element_id"), F.when(i % 2 == 0, "image_caption").otherwise("text").alias("type"), F.substring("text", 1, 40).alias("content"))
    return assets.asset_points(_manifest(spark, d), reg, chunks).select("asset_id", "element_id", "doc_id", "doc_slug", "title", "type", "page_label", "caption")


@plan("WITH h AS (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('asset:' || vec_id)) AS h, vec_id FROM embeddings) SELECT vec_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h")
def point_ids(spark, d):
    return table(spark, d, "embeddings").select("vec_id", ids.point_id(F.concat(F.lit("asset:"), F.col("vec_id").cast("string"))).alias("point_id"))


@plan(f"WITH {MANIFEST} SELECT doc_id || '_' || page_label AS page_key, string_agg(asset_id, ',' ORDER BY pos) AS asset_ids FROM manifest GROUP BY 1")
def page_to_assets(spark, d):
    return index.page_assets(_manifest(spark, d)).select("page_key", F.array_join("asset_ids", ",").alias("asset_ids"))


@plan("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS payload FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0")
def index_upsert(spark, d):
    """The table holds what five doesn't divide; what three divides is written again, with another payload."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("payload"))
    old, new = t.where("id % 5 <> 0"), t.where("id % 3 = 0").withColumn("payload", F.upper("payload"))
    return index.upsert(old, new, ["id"])


@plan("WITH c AS (SELECT 'd' || (doc_id % 40) AS doc_id, 'c' || doc_id AS chunk_id, doc_id AS n FROM documents) SELECT doc_id, chunk_id FROM c WHERE n % 7 <> 0 OR n % 40 >= 30")
def index_prune(spark, d):
    """Chunks with a number that seven divides are gone; documents from 30 on have no chunks left and are out of scope."""
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(F.concat(F.lit("d"), (i % 40).cast("string")).alias("doc_id"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), i.alias("n"))
    return index.prune(c.select("doc_id", "chunk_id"), c.where("n % 7 <> 0 AND n % 40 < 30").select("doc_id", "chunk_id"))


@plan("SELECT count(*) AS indexed, count(*) FILTER (doc_id % 4 <> 0) AS wanted, 0::BIGINT AS missing FROM documents")
def index_validate(spark, d):
    c = table(spark, d, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 40).cast("string")).alias("doc_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("n"))
    return index.validate(c, c.where("n % 4 <> 0").select("doc_id", "chunk_id"))


@plan("WITH f AS (SELECT md5(text) AS doc_id, doc_id AS path FROM documents), r AS (SELECT DISTINCT md5(text) AS doc_id FROM documents WHERE doc_id % 10 = 0) SELECT doc_id, min(path) AS path FROM f WHERE doc_id NOT IN (SELECT doc_id FROM r) GROUP BY 1")
def ingest_skip(spark, d):
    t = table(spark, d, "documents")
    files = t.select(F.md5(F.col("text").cast("binary")).alias("doc_id"), F.col("doc_id").alias("path"))
    return index.not_ingested(files, files.where("path % 10 = 0"))


@plan("SELECT doc_id // 20 AS k, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS title FROM documents GROUP BY 1")
def registry_backfill(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(i.alias("pos"), F.col("lang").alias("title"), F.lit("u").alias("source_uri"), i.cast("string").alias("doc_slug"), F.floor(i / 20).alias("doc_id"))
    return index.registry_from_chunks(c).select(F.col("doc_id").alias("k"), F.col("doc_slug").cast("long").alias("first_doc"), "title")


@plan("SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN 'new' || doc_id ELSE 'old' || doc_id END AS v FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def map_merge(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("k"))
    old, new = t.where("k % 3 = 0").withColumn("v", F.concat(F.lit("old"), F.col("k").cast("string"))), t.where("k % 2 = 0").withColumn("v", F.concat(F.lit("new"), F.col("k").cast("string")))
    return index.merge_maps(old, new, "k", "v")


@plan("WITH x AS (SELECT doc_id AS pos, 'c' || (doc_id // 2) AS chunk_id, 'e' || (doc_id % 50) AS element_id FROM documents) SELECT chunk_id, arg_min(element_id, pos) AS element_id FROM x GROUP BY 1")
def chunk_to_element(spark, d):
    i = F.col("doc_id")
    m = table(spark, d, "documents").select(i.alias("pos"), F.concat(F.lit("e"), (i % 50).cast("string")).alias("element_id"), F.array(F.concat(F.lit("c"), F.floor(i / 2).cast("string")), F.lit("")).alias("chunk_ids"))
    return index.chunk_elements(m)


@plan(
    """WITH s AS (SELECT source AS doc_slug, min(doc_id) AS doc_id FROM documents GROUP BY 1), x AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'src' || (item_id % 20) || '#p' || item_id WHEN 1 THEN 'nowhere#p3' WHEN 2 THEN 'src1' ELSE 'src2#p' || item_id || '#p9' END AS page FROM benchmark)
  SELECT qid, page, CASE WHEN qid % 4 IN (0, 3) THEN s.doc_id || '_' || substr(page, instr(page, '#p') + 2) END AS page_key, CASE WHEN qid % 4 = 2 THEN 'malformed' WHEN qid % 4 = 1 THEN 'unknown_slug' END AS warning FROM x LEFT JOIN s ON s.doc_slug = split_part(page, '#p', 1) AND instr(page, '#p') > 0"""
)
def gold_page_keys(spark, d):
    q = F.col("item_id")
    s = q.cast("string")
    page = F.when(q % 4 == 0, F.concat(F.lit("src"), (q % 20).cast("string"), F.lit("#p"), s)).when(q % 4 == 1, "nowhere#p3").when(q % 4 == 2, "src1").otherwise(F.concat(F.lit("src2#p"), s, F.lit("#p9")))
    docs = table(spark, d, "documents")
    cite = F.array(F.struct(F.col("source").alias("doc_slug"), F.col("doc_id").cast("string").alias("doc_id")))
    gold = docs.select(F.col("doc_id").alias("pos"), cite.alias("citations"), F.lit("").alias("doc_slug"), F.lit("").alias("doc_id"))
    return evaluate.page_keys(table(spark, d, "benchmark").select(q.alias("qid"), page.alias("page")), evaluate.slug_docs(gold))


@plan("SELECT 'c' || doc_id AS chunk_id FROM documents WHERE doc_id % 9 = 0 AND doc_id % 2 = 1")
def gold_integrity(spark, d):
    c = table(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("n"))
    return evaluate.unknown_references(c.where("n % 9 = 0").select("chunk_id"), c.where("n % 2 = 0"), "chunk_id")


@plan(f"WITH {MANIFEST} SELECT asset_id, file_path FROM manifest WHERE type = 'image_asset' AND pos % 4 <> 0 AND pos % 5 = 0")
def embedding_backfill(spark, d):
    """Images whose file is there (four doesn't divide) and which have no vector yet (five divides)."""
    m = _manifest(spark, d).withColumn("embedding", F.when(F.col("pos") % 5 != 0, F.col("embedding")))
    return assets.to_embed(m, m.where("pos % 4 <> 0")).select("asset_id", "file_path")


@plan("SELECT 0::BIGINT AS missing_artifacts, count(*) FILTER (pos % 6 = 0) AS missing_files, CASE WHEN count(*) FILTER (pos % 6 = 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT vec_id AS pos FROM embeddings ORDER BY vec_id LIMIT 20)")
def artifact_check(spark, d):
    """The first 20 assets; the files of every sixth are missing."""
    m = _manifest(spark, d)
    artifacts = spark.createDataFrame([("chunks", True), ("assets", True), ("elements", True), ("pages", True)], "name string, present boolean")
    return check_files(artifacts, m, m.where("pos % 6 <> 0"))


@plan("SELECT max(len(embedding))::INT AS dim FROM embeddings")
def vector_dimension(spark, d):
    return index.dimension(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@plan("SELECT 'd' || (doc_id % 40) AS doc_id, count(*) AS n_chunks FROM documents GROUP BY 1")
def desired_state(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(F.concat(F.lit("d"), (i % 40).cast("string")).alias("doc_id"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"))
    return index.desired(c.unionAll(c)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@plan("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'p' || (doc_id % 5) END AS page_label, doc_id % 5 AS page_number, 'body' AS section, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_values FROM documents")
def index_points(spark, d):
    """Payload fields flattened, and the stored sparse vector unless it is empty."""
    i = F.col("doc_id")
    meta = F.struct(F.when(i % 2 == 0, F.concat(F.lit("p"), (i % 5).cast("string"))).alias("page_label"), (i % 5).alias("page_number"), F.lit("body").alias("section"), F.lit(None).cast("string").alias("linked_asset_id"))
    own = F.when(i % 3 == 0, F.struct(F.array(F.lit(1)).alias("indices"), F.array(F.lit(0.5)).alias("values"))).otherwise(F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values")))
    other = F.struct(F.array(F.lit(1), F.lit(2)).alias("indices"), F.array(F.lit(0.1), F.lit(0.2)).alias("values"))
    p = index.points(table(spark, d, "documents").select(i.alias("chunk_id"), meta.alias("metadata"), own.alias("sparse_vector")))
    return p.select("chunk_id", "page_label", "page_number", "section", F.size(index.choose_sparse(F.col("sparse_vector"), other)["values"]).alias("n_values"))


@plan("SELECT asset_no, CASE asset_no % 3 WHEN 0 THEN '/data/a.png' WHEN 1 THEN 'root/x/a' || asset_no || '.png' END AS path, asset_no % 3 = 1 AS servable FROM (SELECT vec_id AS asset_no FROM embeddings)")
def asset_paths(spark, d):
    v = F.col("vec_id")
    path = F.when(v % 3 == 0, "/data/a.png").when(v % 3 == 1, F.concat(F.lit("x/a"), v.cast("string"), F.lit(".png"))).otherwise("")
    name = F.when(v % 3 == 1, F.concat(F.md5(v.cast("string")), F.lit(".png"))).otherwise("../x.png")
    return table(spark, d, "embeddings").select(v.alias("asset_no"), assets.local_path(path, "root/").alias("path"), assets.upload_name(name).alias("servable"))


@plan("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a1,i1,t1' ELSE 'a1,i1' END AS expected FROM documents")
def expected_assets(spark, d):
    i = F.col("doc_id")
    one = lambda x: F.array(F.lit(x), F.lit(" a1 "), F.lit(""))
    e = F.struct(F.array(F.lit("a1")).alias("asset_ids"), one("i1").alias("image_ids"), F.when(i % 2 == 0, F.array(F.lit("t1"))).alias("table_ids"))
    return table(spark, d, "documents").select("doc_id", F.array_join(evaluate.expected_assets(e), ",").alias("expected"))


@plan("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'type' WHEN 2 THEN 'empty' ELSE NULL END AS problem FROM documents")
def upload_check(spark, d):
    m = F.col("doc_id") % 4
    content = F.when(m == 0, F.unhex(F.lit("FFD8FFE000104A464946"))).when(m == 1, F.col("text").cast("binary")).when(m == 2, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("524946460000000057454250")))
    return table(spark, d, "documents").select("doc_id", assets.upload_problem(content).alias("problem"))
