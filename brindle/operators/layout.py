"""From layout items of a page to paragraphs and elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import ids
from brindle.functions.text import strip


def subtype(label: Column) -> Column:
    up = F.upper(F.coalesce(label, F.lit("")))
    return F.when(up.contains("FOOTER"), "footer").when(up.contains("HEADER") | up.contains("TITLE"), "header").otherwise("body")


def page_number(*candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit(1)).cast("int")


def bbox(image_rect: Column, prov: Column, item: Column) -> Column:
    """The image's rectangle if it has four edges, else the provenance box, else the item's own."""
    return F.when(F.size(image_rect) == 4, image_rect).otherwise(F.coalesce(prov, item))


def edges(box: Column) -> Column:
    """struct<l, t, r, b> as an array; a missing edge is 0, a missing box null."""
    return F.when(box.isNotNull(), F.array(*[F.coalesce(box[e], F.lit(0)).cast("double") for e in "ltrb"]))


def item_counts(items: DataFrame) -> DataFrame:
    """Per document: n_text, n_table, n_image, the items that a parser found."""
    return items.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("text", "table", "image")])


def paragraphs(items: DataFrame, gap: float = 32.0) -> DataFrame:
    """items (doc_id, page_no, item_ord, kind, label, text, bbox): one row per element, numbered within its page.

    Body texts form a paragraph until the next one starts more than gap below the last box, or until a
    header, footer, table or image stands between. The gap is measured before a text is found to be
    empty, so an empty text can end a paragraph; it neither joins one nor moves the last box. Headers
    and footers stand alone, even when empty. Paragraphs that are empty after trimming get no number.
    """
    page = ["doc_id", "page_no"]
    order = Window.partitionBy(*page).orderBy(F.coalesce(F.col("bbox")[1], F.lit(0.0)), F.coalesce(F.col("bbox")[0], F.lit(0.0)), "item_ord")
    it = items.withColumn("pos", F.row_number().over(order)).withColumn("sub", subtype(F.col("label")))
    it = it.withColumn("body", (F.col("kind") == "text") & (F.col("sub") == "body"))
    run_order = Window.partitionBy(*page).orderBy("pos")
    it = it.withColumn("run", F.sum(F.when(F.col("body"), 0).otherwise(1)).over(run_order))
    run = [*page, "run"]
    boxed = F.size("bbox") == 4
    # the box before: of the last body text of the run that had text and a box, unless a gap ended the paragraph since
    before = F.last(F.when(F.col("body") & boxed & (F.coalesce("text", F.lit("")) != ""), F.col("bbox")[3]), ignorenulls=True).over(Window.partitionBy(*run).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    it = it.withColumn("jump", F.coalesce(F.col("body") & boxed & (F.col("bbox")[1] - before > gap), F.lit(False)))
    # an empty text that ends a paragraph clears the last box: until a text with one follows, nothing jumps again
    cleared = F.last(F.when(F.col("body") & boxed & (F.coalesce("text", F.lit("")) != ""), F.lit(False)).when(F.col("jump") & (F.coalesce("text", F.lit("")) == ""), F.lit(True)), ignorenulls=True).over(Window.partitionBy(*run).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    it = it.withColumn("jump", F.col("jump") & ~F.coalesce(cleared, F.lit(False)))
    it = it.withColumn("para", F.sum(F.col("jump").cast("int")).over(Window.partitionBy(*run).orderBy("pos")))
    texts = it.where(F.col("body") & (F.coalesce("text", F.lit("")) != "")).groupBy(*run, "para").agg(
        F.min("pos").alias("pos"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")).alias("content"),
        F.min(F.when(boxed, F.col("bbox")[0])).alias("l"),
        F.min(F.when(boxed, F.col("bbox")[1])).alias("t"),
        F.max(F.when(boxed, F.col("bbox")[2])).alias("r"),
        F.max(F.when(boxed, F.col("bbox")[3])).alias("b"),
    )
    texts = texts.where(F.col("content") != "").select(*page, "pos", F.lit("text").alias("type"), F.lit("body").alias("subtype"), "content", F.when(F.col("l").isNotNull(), F.array("l", "t", "r", "b")).alias("bbox"))
    alone = it.where(~F.col("body")).select(*page, "pos", F.col("kind").alias("type"), F.when(F.col("kind") == "text", F.col("sub")).otherwise("body").alias("subtype"), F.coalesce("text", F.lit("")).alias("content"), "bbox")
    every = texts.unionByName(alone)
    numbered = every.withColumn("seq", F.row_number().over(Window.partitionBy(*page).orderBy("pos")).cast("int"))
    return numbered.select("doc_id", "page_no", "seq", ids.element_id(F.col("doc_id"), F.col("page_no") - 1, F.col("seq"), F.col("type")).alias("element_id"), "type", "subtype", "content", "bbox")


def placements(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, images array<struct<xref, rects array<array<double>>>>): one row per image rectangle."""
    images = pages.select("doc_id", "page_no", F.explode("images").alias("i"))
    return images.select("doc_id", "page_no", F.col("i.xref").alias("xref"), F.posexplode("i.rects").alias("rect_no", "bbox"))
