"""Plans over document texts: normalising, scoring, packing, chunking, reports, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle import config as C
from brindle.functions import ids, text as T
from brindle.operators import captions, chunking, index, layout, report
from brindle.plans.registry import plan
from brindle.sources.readers import html_items, table

# SQL fragments that several oracles share
W = "[\\p{L}\\p{N}_]"
NORM = f"trim(regexp_replace(regexp_replace(replace({{t}}, chr(173), ''), '({W}+)-\\s*\\n\\s*({W}+)', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"
N_WORDS = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
N_TERMS = """(
  len(regexp_extract_all({t}, '\\b\\d{3}-\\d{4}\\b')) + len(regexp_extract_all({t}, '\\b[A-Z]{1,4}-\\d+\\b'))
  + len(regexp_extract_all({t}, '\\bTB\\s*-?\\s*\\d+\\b')) + len(regexp_extract_all({t}, '\\b\\d{2,}[A-Z]\\d{1,}\\b'))
  + len(regexp_extract_all({t}, '\\b[JKP]\\d{1,3}\\b'))
  + coalesce(list_sum(list_transform(list_filter(string_split({t}, chr(10)), lambda l: regexp_matches(l, '[A-Z0-9]{5}')),
      lambda l: len(list_filter(range(1, len(regexp_extract_all(l, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')) + 1),
        lambda i: regexp_full_match(regexp_extract_all(l, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')[i], '[A-Z0-9]{5,}')
          AND regexp_matches(array_to_string(regexp_extract_all(l, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')[i:], ''), '[A-Z]')
          AND regexp_matches(array_to_string(regexp_extract_all(l, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')[i:], ''), '\\d'))))), 0)
)"""
DENSITY = "length(regexp_replace({t}, '[^\\p{L}\\p{N}]', '', 'g')) / greatest(1, length({t}))::DOUBLE"
ILLEGIBLE = "(contains(lower({t}), 'not legible') OR contains(lower({t}), 'unreadable') OR contains(lower({t}), 'blur') OR contains(lower({t}), 'unknown'))"


def scored_cte(source: str) -> str:
    """CTEs that add terms, words, density, murky and score to rows (doc_id, text, ...) of source."""
    t = "text"
    return f"""
  m AS (SELECT *, {N_TERMS.replace('{t}', t)} AS terms, {N_WORDS.replace('{t}', t)} AS words, {DENSITY.replace('{t}', t)} AS density, {ILLEGIBLE.replace('{t}', t)} AS murky FROM {source}),
  scored AS (SELECT *, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN terms > 0 THEN least(terms * 0.1, 0.4) ELSE 0 END - CASE WHEN words < 10 THEN 0.2 ELSE 0 END
    - CASE WHEN density < 0.4 THEN 0.2 ELSE 0 END - CASE WHEN murky THEN 0.4 ELSE 0 END)), 2)::DOUBLE AS score FROM m)"""


@plan(f"SELECT doc_id, {NORM.replace('{t}', 'text')} AS content, sha256({NORM.replace('{t}', 'text')}) AS content_hash FROM documents")
def normalize_text(spark, d):
    n = T.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("content"), F.sha2(n, 256).alias("content_hash"))


KEEP = f"""trim(regexp_replace(array_to_string(list_transform(string_split(replace(replace(regexp_replace(replace({{t}}, chr(173), ''), '({W}+)-\\s*\\n\\s*({W}+)', '\\1\\2', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
  lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


@plan(f"SELECT doc_id, {KEEP.replace('{t}', 'text')} AS content FROM documents")
def normalize_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_paragraphs(F.col("text")).alias("content"))


@plan(f"SELECT sha256({NORM.replace('{t}', 'text')}) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash_dups(spark, d):
    return table(spark, d, "documents").groupBy(ids.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@plan(f"SELECT doc_id, {N_TERMS.replace('{t}', 'text')}::BIGINT AS n_terms FROM documents")
def tech_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tech_terms(F.col("text")).cast("long").alias("n_terms"))


@plan(
    """SELECT p_partkey, 'P' || (p_partkey % 999 + 1) || ' to TB-' || (p_partkey % 30) || ', wire ' || (100 + p_partkey % 50) || 'A' || (p_partkey % 20) AS note,
  3 + CASE WHEN length((100 + p_partkey % 50) || 'A' || (p_partkey % 20)) >= 5 THEN 1 ELSE 0 END + 1 AS n_terms FROM part"""
)
def tech_terms_by_kind(spark, d):
    """A note per part that holds a connector, a terminal block (which counts as a pin too), a wire and, at five characters, a code."""
    k = F.col("p_partkey")
    note = F.concat(F.lit("P"), (k % 999 + 1).cast("string"), F.lit(" to TB-"), (k % 30).cast("string"), F.lit(", wire "), (100 + k % 50).cast("string"), F.lit("A"), (k % 20).cast("string"))
    return table(spark, d, "part").select("p_partkey", note.alias("note")).withColumn("n_terms", T.tech_terms(F.col("note")))


@plan(f"WITH {scored_cte('documents')} SELECT doc_id, score, words::BIGINT AS words, round(density, 6) AS density FROM scored")
def quality_score(spark, d):
    q = table(spark, d, "documents").select("doc_id", T.quality(F.col("text"), F.lit("text")).alias("q"))
    return q.select("doc_id", "q.score", F.col("q.words").cast("long").alias("words"), F.round("q.density", 6).alias("density"))


@plan(
    f"""WITH {scored_cte('documents')} SELECT doc_id, array_to_string(list_filter([
    CASE WHEN terms > 0 THEN 'tech_terms_found (+0.' || least(terms, 4) || ')' END, CASE WHEN words < 10 THEN 'low_word_count (' || words || ')' END,
    CASE WHEN density < 0.4 THEN 'low_text_density' END, CASE WHEN murky THEN 'illegible_content' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM scored"""
)
def quality_reasons(spark, d):
    q = table(spark, d, "documents").select("doc_id", T.quality(F.col("text"), F.lit("text")).alias("q"))
    # the density's digits round differently between engines at ties; the reason alone is compared
    named = F.transform("q.reasons", lambda r: F.when(r.startswith("low_text_density"), "low_text_density").otherwise(r))
    return q.select("doc_id", F.array_join(named, ", ").alias("reasons"))


@plan(f"WITH {scored_cte('documents')} SELECT doc_id, lang, score FROM scored WHERE score >= 0.5")
def quality_gate(spark, d):
    q = table(spark, d, "documents").select("doc_id", "lang", T.quality(F.col("text"), F.lit("text"))["score"].alias("score"))
    return q.where("score >= 0.5")


@plan(
    f"""WITH {scored_cte('documents')}, b(bucket, no) AS (VALUES ('0.0-0.3', 0), ('0.3-0.5', 1), ('0.5-0.7', 2), ('0.7-0.9', 3), ('0.9-1.0', 4))
  SELECT b.bucket, count(s.doc_id) AS n FROM b LEFT JOIN scored s ON b.no = CASE WHEN s.score < 0.3 THEN 0 WHEN s.score < 0.5 THEN 1 WHEN s.score < 0.7 THEN 2 WHEN s.score < 0.9 THEN 3 ELSE 4 END GROUP BY 1"""
)
def score_histogram(spark, d):
    return report.score_histogram(table(spark, d, "documents").select(T.quality(F.col("text"), F.lit("text"))["score"].alias("score")))


@plan(
    """WITH k(type) AS (VALUES ('text'), ('table_md'), ('image_caption'), ('ocr_text')), c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table_md' ELSE 'note' END AS type FROM documents)
  SELECT coalesce(k.type, c.type) AS type, count(c.type) AS n FROM k FULL JOIN c ON k.type = c.type GROUP BY 1"""
)
def type_histogram(spark, d):
    m = F.col("doc_id") % 3
    return report.type_histogram(table(spark, d, "documents").select(F.when(m == 0, "text").when(m == 1, "table_md").otherwise("note").alias("type")))


@plan(
    f"""WITH {scored_cte('documents')}, k AS (SELECT doc_id % 50 AS doc, doc_id // 50 + 1 AS page, score FROM scored WHERE score >= 0.3)
  SELECT count(DISTINCT doc) AS documents, count(*) AS chunks, round(avg(score), 6) AS mean_score, count(*) FILTER (score < 0.5) AS low,
    (SELECT sum(p) FROM (SELECT max(page) AS p FROM k GROUP BY doc))::BIGINT AS max_kept_pages, (SELECT count(*) FROM embeddings) AS assets FROM k"""
)
def run_report(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("doc_id"), (F.floor(F.col("doc_id") / 50) + 1).alias("page_number"), T.quality(F.col("text"), F.lit("text"))["score"].alias("score"))
    return report.summary(docs.where(F.col("score") >= C.Quality().min_score), table(spark, d, "embeddings"), low=0.5)


# lines stand in for paragraphs: the documents hold no blank lines
PACK = """
  src AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
  walk(doc_id, ps, i, chunks, buf, w) AS (
    SELECT doc_id, ps, 0::BIGINT, []::VARCHAR[], '', 0::BIGINT FROM src
    UNION ALL
    SELECT doc_id, ps, i + 1,
      CASE WHEN length(p) > 1500 THEN list_append(CASE WHEN buf = '' THEN chunks ELSE list_append(chunks, buf) END, p) WHEN f THEN list_append(chunks, nb) ELSE chunks END,
      CASE WHEN length(p) > 1500 OR f THEN '' ELSE nb END, CASE WHEN length(p) > 1500 OR f THEN 0 ELSE nw END
    FROM (SELECT *, nw >= 30 OR length(nb) >= 1500 AS f FROM (
      SELECT *, CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END AS nb, w + len(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')) AS nw
      FROM (SELECT *, ps[i + 1] AS p FROM walk WHERE i < len(ps))))),
  packed AS (SELECT doc_id, CASE WHEN buf = '' THEN chunks ELSE list_append(chunks, buf) END AS chunks FROM walk WHERE i = len(ps)),
  parts AS (SELECT doc_id, unnest(range(len(chunks))) AS chunk_index, unnest(chunks) AS content FROM packed)"""


def _packed(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunking.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("chunk_index", "content"))


@plan(f"WITH RECURSIVE {PACK} SELECT doc_id, chunk_index::INT AS chunk_index, content FROM parts")
def paragraph_pack(spark, d):
    return _packed(spark, d)


CHUNK_IDS = f"""{PACK}, ided AS (SELECT doc_id, chunk_index, 'd' || doc_id || '_p0_01_text' AS element_id, sha256({NORM.replace('{t}', 'content')}) AS content_hash FROM parts),
  chunks AS (SELECT *, md5(element_id || '_' || chunk_index || '_' || content_hash) AS chunk_id FROM ided)"""


def _identified(spark, d):
    element = ids.element_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit(0), F.lit(1), F.lit("text"))
    p = _packed(spark, d).withColumn("element_id", element).withColumn("content_hash", ids.content_hash(F.col("content")))
    return p.withColumn("chunk_id", ids.chunk_id(F.col("element_id"), F.col("chunk_index"), F.col("content_hash")))


@plan(f"WITH RECURSIVE {CHUNK_IDS} SELECT doc_id, chunk_index::INT AS chunk_index, element_id, content_hash, chunk_id FROM chunks")
def chunk_ids(spark, d):
    return _identified(spark, d).select("doc_id", "chunk_index", "element_id", "content_hash", "chunk_id")


@plan(f"WITH RECURSIVE {CHUNK_IDS} SELECT element_id, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids FROM chunks GROUP BY 1")
def element_to_chunks(spark, d):
    return index.element_chunks(_identified(spark, d)).select("element_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@plan()
def chunk_records(spark, d):
    """Whole chunk records with splitting; the splitter has no SQL form."""
    docs = table(spark, d, "documents")
    elements = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("element_id"), "doc_id", F.lit("text").alias("type"), T.normalize_paragraphs(F.col("text")).alias("content"), F.lit(1).alias("page_number"))
    return chunking.chunk_records(elements)


@plan()
def recursive_split(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunking.recursive_split(F.col("text"))).alias("piece", "content"))


LAYOUT = """
  lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
  items AS (SELECT doc_id, ord, text, 20.0 * ord + 30.0 * (ord // 3) AS top, CASE WHEN ord % 7 = 6 THEN 'header' ELSE 'body' END AS sub FROM lines),
  runs AS (SELECT *, sum(CASE WHEN sub = 'body' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM items),
  marks AS (SELECT *, max(CASE WHEN sub = 'body' AND text <> '' THEN top + 15 END) OVER (PARTITION BY doc_id, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM runs),
  paras AS (SELECT *, sum(CASE WHEN sub = 'body' AND top - prev > 32 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY ord) AS para FROM marks),
  els AS (SELECT doc_id, min(ord) AS ord, trim(string_agg(text, chr(10) ORDER BY ord), ' ' || chr(10) || chr(9)) AS content, 'body' AS subtype, min(top) AS t, max(top) + 15 AS b FROM paras WHERE sub = 'body' AND text <> '' GROUP BY doc_id, run, para
    UNION ALL SELECT doc_id, ord, text, 'header', top, top + 15 FROM items WHERE sub = 'header')"""


@plan(
    f"""WITH {LAYOUT} SELECT 'd' || doc_id AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INT AS seq,
  'd' || doc_id || '_p0_' || CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY ord) < 10 THEN '0' ELSE '' END || row_number() OVER (PARTITION BY doc_id ORDER BY ord) || '_text' AS element_id, subtype, content, t::DOUBLE AS t, b::DOUBLE AS b FROM els WHERE content <> '' OR subtype = 'header'"""
)
def paragraph_sessions(spark, d):
    """Lines as layout items: 20 apart, a wider gap after every third, every seventh a header."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    top = F.col("ord") * 20.0 + F.floor(F.col("ord") / 3) * 30.0
    items = lines.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(1).alias("page_no"), F.col("ord").cast("long").alias("item_ord"), F.lit("text").alias("kind"), F.when(F.col("ord") % 7 == 6, "SECTION_HEADER").otherwise("TEXT").alias("label"), "text", F.array(F.lit(0.0), top, F.lit(100.0), top + 15).alias("bbox"))
    p = layout.paragraphs(items)
    return p.select("doc_id", "seq", "element_id", "subtype", "content", F.col("bbox")[1].alias("t"), F.col("bbox")[3].alias("b"))


@plan("SELECT source AS label, CASE WHEN contains(upper(source), 'FOOTER') THEN 'footer' WHEN contains(upper(source), 'HEADER') OR contains(upper(source), 'TITLE') THEN 'header' ELSE 'body' END AS subtype, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'page_footer' WHEN 1 THEN 'Section_Header' WHEN 2 THEN 'doc title' ELSE source END AS source FROM documents) GROUP BY 1, 2")
def label_subtypes(spark, d):
    m = F.col("doc_id") % 4
    label = F.when(m == 0, "page_footer").when(m == 1, "Section_Header").when(m == 2, "doc title").otherwise(F.col("source"))
    return table(spark, d, "documents").select(label.alias("label")).groupBy("label", layout.subtype(F.col("label")).alias("subtype")).agg(F.count("*").alias("n"))


@plan(
    """WITH e AS (SELECT doc_id % 50 AS doc_id, (doc_id // 50 % 5)::INT AS page_no, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'image' END AS type FROM documents),
  a AS (SELECT vec_id % 50 AS doc_id, (vec_id // 50 % 5)::INT AS page_no, count(*) AS n FROM embeddings GROUP BY 1, 2)
  SELECT e.doc_id, e.page_no, count(*) FILTER (type = 'text') AS n_text, count(*) FILTER (type = 'table') AS n_table, count(*) FILTER (type = 'image') AS n_image, count(*) AS n_elements, coalesce(max(a.n), 0) AS n_assets
  FROM e LEFT JOIN a USING (doc_id, page_no) GROUP BY 1, 2"""
)
def page_counts(spark, d):
    m = F.col("doc_id") % 3
    e = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("doc_id"), (F.floor(F.col("doc_id") / 50) % 5).cast("int").alias("page_no"), F.when(m == 0, "text").when(m == 1, "table").otherwise("image").alias("type"))
    a = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("doc_id"), (F.floor(F.col("vec_id") / 50) % 5).cast("int").alias("page_no"))
    return report.page_counts(e, a)


@plan("SELECT 'd' || (doc_id % 50) AS doc_id, count(DISTINCT doc_id // 50 % 5) AS pages FROM documents GROUP BY 1")
def page_turns(spark, d):
    e = table(spark, d, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")).alias("doc_id"), (F.floor(F.col("doc_id") / 50) % 5).alias("page_no"), F.col("doc_id").alias("seq"))
    return report.page_turns(e)


@plan(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 WHEN doc_id % 3 = 1 THEN doc_id % 5 ELSE 1 END::INT AS page_number, CASE WHEN doc_id % 4 = 0 THEN 4.0 WHEN doc_id % 4 = 1 THEN 9.0 ELSE NULL END::DOUBLE AS l FROM documents"""
)
def page_and_box(spark, d):
    """Page number and box from whichever of an item's fields is there."""
    i = F.col("doc_id")
    image = F.when(i % 4 == 0, F.array(*[F.lit(4.0)] * 4)).when(i % 4 == 1, F.array(F.lit(1.0)))
    prov = F.when(i % 4 == 1, F.array(*[F.lit(9.0)] * 4))
    return table(spark, d, "documents").select("doc_id", layout.page_number(F.when(i % 3 == 0, i % 7), F.when(i % 3 == 1, i % 5)).alias("page_number"), layout.bbox(image, prov, F.lit(None).cast("array<double>"))[0].alias("l"))


WRAP_HEAD = T.TABLE_STYLE.replace("'", "''")


@plan(
    f"""SELECT page_id, CASE WHEN html = '' OR contains(html, '{T.TABLE_MARK}') THEN html
  WHEN instr(lower(html), '</head>') > 0 THEN substr(html, 1, instr(lower(html), '</head>') - 1) || '{WRAP_HEAD}' || substr(html, instr(lower(html), '</head>'))
  WHEN instr(lower(html), '<body') > 0 AND instr(substr(lower(html), instr(lower(html), '<body')), '>') > 0
    THEN substr(html, 1, instr(lower(html), '<body') + instr(substr(lower(html), instr(lower(html), '<body')), '>') - 1) || '{WRAP_HEAD}' || substr(html, instr(lower(html), '<body') + instr(substr(lower(html), instr(lower(html), '<body')), '>'))
  WHEN contains(lower(html), '<html') THEN '{WRAP_HEAD}' || html
  ELSE '<!doctype html><html><head>' || '{WRAP_HEAD}' || '</head><body>' || html || '</body></html>' END AS html FROM pages"""
)
def table_html_wrap(spark, d):
    return table(spark, d, "pages").select("page_id", T.wrap_table(F.col("html")).alias("html"))


@plan()
def html_elements(spark, d):
    return layout.paragraphs(html_items(table(spark, d, "pages")))


@plan(
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'Diagram for ' || event_type || '.' || ' Part Numbers: J' || (user_id % 9) || ', TB-1.' || CASE WHEN user_id % 2 = 0 THEN ' Connects to: K' || (user_id % 5) || '.' ELSE '' END || ' Details: value' END AS caption FROM events"""
)
def caption_json(spark, d):
    """Fenced answers with a trailing comma, made from events; every third names a placeholder and nothing else."""
    u = F.col("user_id")
    parts = F.concat(F.lit('"J'), (u % 9).cast("string"), F.lit('", "TB-1",'))
    conns = F.when(u % 2 == 0, F.concat(F.lit('"K'), (u % 5).cast("string"), F.lit('"'))).otherwise("")
    good = F.concat(F.lit('```json\n{"component_name": "'), F.col("event_type"), F.lit('", "part_numbers": ['), parts, F.lit('], "connections": ['), conns, F.lit('], "technical_description": "value",}\n```'))
    bad = F.lit('Here it is: {"component_name": "Not visible here", "part_numbers": [], "connections": []}')
    e = table(spark, d, "events").select("event_id", captions.parse(F.when(u % 3 == 0, bad).otherwise(good)).alias("c"))
    return e.select("event_id", F.when(captions.useful(F.col("c")), captions.rendered(F.col("c"))).alias("caption"))


@plan("SELECT doc_id, regexp_replace(lang || ' manual (' || source || ')', '[^\\p{L}\\p{N}_-]', '_', 'g') AS doc_slug, trim(replace(regexp_replace(lang || ' manual (' || source || ')', '[^\\p{L}\\p{N}_-]', '_', 'g'), '_', ' ')) AS title, md5(text) AS file_id FROM documents")
def doc_identity(spark, d):
    stem = F.concat(F.col("lang"), F.lit(" manual ("), F.col("source"), F.lit(")"))
    docs = table(spark, d, "documents").withColumn("doc_slug", T.slug(stem))
    return docs.select("doc_id", "doc_slug", T.title_of(F.col("doc_slug")).alias("title"), ids.doc_id(F.col("text").cast("binary")).alias("file_id"))
