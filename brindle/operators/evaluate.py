"""Retrieval metrics at k: strict chunks, elements, pages, assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import nonzero, present

from brindle.operators.assets import first_by


def ks(values: list[int]) -> list[int]:
    found = sorted({int(k) for k in values if int(k) > 0})
    if not found:
        raise ValueError("no positive k")
    return found


def clean(values: Column) -> Column:
    """Distinct stripped strings, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))


def per_query(results: DataFrame, k_values: list[int]) -> DataFrame:
    """results (qid, expected array, retrieved array in rank order, repeats kept): a row per query and k with recall, precision, mrr.

    Precision divides by the length of the cut list, so fewer than k results make it larger; repeats
    count there. Without an expectation all three are null.
    """
    rows = results.select("qid", clean(F.col("expected")).alias("e"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("r"), F.explode(F.lit(ks(k_values))).alias("k"))
    cut = rows.withColumn("c", F.slice("r", F.lit(1), F.col("k")))
    hit = F.size(F.array_intersect("e", "c"))
    first = F.array_min(F.transform(F.filter(F.transform("c", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda s: F.array_contains("e", s["x"])), lambda s: s["i"]))
    some = F.size("e") > 0
    return cut.select(
        "qid",
        "k",
        F.when(some, hit / F.size("e")).alias("recall"),
        F.when(some, hit / F.greatest(F.size("c"), F.lit(1))).alias("precision"),
        F.when(some, F.coalesce(1.0 / first, F.lit(0.0))).alias("mrr"),
    )


def averages(rows: DataFrame) -> DataFrame:
    """Per k: means over the queries with an expectation, and their number."""
    return rows.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "mrr")], F.count("recall").alias("queries"))


def hit_rate(results: DataFrame, k_values: list[int]) -> DataFrame:
    """results (qid, expected, retrieved): per k the share of queries with any expected one among the first k."""
    rows = per_query(results, k_values)
    return rows.groupBy("k").agg(F.avg(F.when(F.col("recall") > 0, 1.0).when(F.col("recall").isNotNull(), 0.0)).alias("hit_rate"), F.count("recall").alias("queries"))


def relax(results: DataFrame, elements: DataFrame) -> DataFrame:
    """Chunk ids replaced by element ids on both sides; a chunk without an element stands for itself."""

    def mapped(col: str) -> DataFrame:
        rows = results.select("qid", F.posexplode(col).alias("at", "chunk_id")).join(elements, "chunk_id", "left")
        pairs = F.array_sort(F.collect_list(F.struct("at", F.coalesce("element_id", "chunk_id").alias("v"))))
        return rows.groupBy("qid").agg(F.transform(pairs, lambda s: s["v"]).alias(col))

    return reduce(lambda a, b: a.join(b, "qid", "left"), [results.select("qid"), mapped("expected"), mapped("retrieved")])


def slug_docs(gold: DataFrame) -> DataFrame:
    """gold (pos, doc_slug, doc_id, citations array<struct<doc_slug, doc_id>>): slug to doc_id, citations before the query's own, the first wins."""
    cited = gold.select("pos", F.posexplode("citations").alias("at", "c")).select("pos", F.col("at").cast("int").alias("at"), "c.doc_slug", "c.doc_id")
    own = gold.select("pos", F.lit(2**31 - 1).alias("at"), "doc_slug", "doc_id")
    rows = cited.unionByName(own).where((F.coalesce("doc_slug", F.lit("")) != "") & (F.coalesce("doc_id", F.lit("")) != ""))
    return first_by(rows, ["doc_slug"], "pos", "at").select("doc_slug", "doc_id")


def page_keys(expected: DataFrame, slugs: DataFrame) -> DataFrame:
    """expected (qid, page such as slug#p3): page_key, or the reason why there is none (malformed, unknown_slug). The first #p splits."""
    slug = F.regexp_extract("page", "^(.*?)#p", 1)
    number = F.regexp_extract("page", "^.*?#p(.*)$", 1)
    parts = expected.withColumn("slug_", slug).withColumn("no_", number)
    joined = parts.join(slugs.withColumnRenamed("doc_slug", "slug_"), "slug_", "left")
    bad = (F.instr("page", "#p") == 0) | (F.col("slug_") == "") | (F.col("no_") == "")
    return joined.select("qid", "page", F.when(~bad & F.col("doc_id").isNotNull(), F.concat_ws("_", F.col("doc_id").cast("string"), "no_")).alias("page_key"), F.when(bad, "malformed").when(F.col("doc_id").isNull(), "unknown_slug").alias("warning"))


def expected_assets(expected: Column) -> Column:
    """Assets, images and tables that a gold query expects, each once."""
    return F.array_union(F.array_union(clean(expected["asset_ids"]), clean(expected["image_ids"])), clean(expected["table_ids"]))


def unknown_references(expected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Expected ids that the artifacts don't hold; must be empty for a sound gold set."""
    return expected.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")


#: Keys that each gold record must have.
GOLD_KEYS = ("id", "query", "intent", "requires_image", "difficulty", "tags", "expected_pages", "expected_retrieval", "gold_answer", "gold_citations")


def missing_keys(record: Column, required: tuple[str, ...] = GOLD_KEYS) -> Column:
    """Sorted keys that a JSON record lacks; all of them where it is no object."""
    held = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), held))


def result_pages(docs: DataFrame, slugs: DataFrame) -> DataFrame:
    """docs (doc_id, doc_slug, title, page_label, page_number, ...) with page_key, in the form of page maps; without a doc_id the slug (or else the title) is looked up in slugs (slug, slug_doc). Null where either half is missing."""
    name = F.coalesce(present(F.col("doc_slug")), present(F.col("title")))
    found = docs.withColumn("_name", name).join(slugs, F.col("_name") == slugs["slug"], "left")
    doc, page = F.coalesce("doc_id", "slug_doc"), F.coalesce(present(F.col("page_label")), nonzero(F.col("page_number")).cast("string"))
    return found.withColumn("page_key", F.when(doc.isNotNull() & page.isNotNull(), F.concat_ws("_", doc, page))).select(*docs.columns, "page_key")
