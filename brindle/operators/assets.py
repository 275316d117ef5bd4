"""Asset manifests: joins, resolution for retrieved documents, attachments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle import config as C
from brindle.functions.ids import point_id
from brindle.functions.text import nonzero, present


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_by(df, keys, F.desc(order))


def captions(chunks: DataFrame) -> DataFrame:
    """element_id, caption: the first image caption of each element, in order of pos."""
    some = chunks.where((F.col("type") == "image_caption") & (F.coalesce("element_id", F.lit("")) != ""))
    return first_by(some, ["element_id"], "pos").select("element_id", F.col("content").alias("caption"))


def asset_points(assets: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows for the asset index: assets with an id and a vector, their document's names (the last record of a doc_id counts) and first caption."""
    named = last_by(docs, ["doc_id"], "pos").select("doc_id", "doc_slug", "title", "source_uri")
    fit = assets.where((F.coalesce("asset_id", F.lit("")) != "") & (F.coalesce(F.size("embedding"), F.lit(0)) > 0))
    joined = fit.join(named, "doc_id", "left").join(captions(chunks), "element_id", "left")
    return joined.select(point_id(F.concat(F.lit("asset:"), F.col("asset_id"))).alias("point_id"), "asset_id", "element_id", "doc_id", "doc_slug", "title", "source_uri", "type", "page_label", "file_path", "caption", F.transform("embedding", lambda x: x.cast("float")).alias("vector"))


#: Groups of queries that meet a page's assets apart, and tasks of that join for each shuffle partition: its output is far larger than what it reads.
SALTS, TASKS = 16, 4


def resolve(docs: DataFrame, manifest: DataFrame, most: int | None = None) -> DataFrame:
    """docs (qid, rank, linked_asset_id, element_id, doc_id, page_label, page_number), manifest (pos, asset_id, element_id, doc_id, page_label, type, file_path): the assets of each query in order of first sight.

    By linked asset, else by element, else all assets of the document's page; of manifest rows that
    repeat a key the last one counts. With most, only each query's first ones are found: of a page, no
    more of its assets can be among them.
    """
    tasks = TASKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct("asset_id", "type", "file_path", "page_label", F.col("element_id").alias("element"), "pos")
    by_asset = last_by(manifest.where(F.coalesce("asset_id", F.lit("")) != ""), ["asset_id"], "pos").select(F.col("asset_id").alias("k1"), item.alias("m1"))
    by_element = last_by(manifest.where(F.coalesce("element_id", F.lit("")) != ""), ["element_id"], "pos").select(F.col("element_id").alias("k2"), item.alias("m2"))
    paged = manifest.where(F.col("doc_id").isNotNull() & F.col("page_label").isNotNull() & (F.coalesce("asset_id", F.lit("")) != ""))
    if most is not None:
        paged = first_by(paged, ["doc_id", "page_label", "asset_id"], "pos")
        paged = paged.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "page_label").orderBy("pos"))).where(F.col("_nth") <= most).drop("_nth")
    by_page = paged.select(F.col("doc_id").alias("k3"), F.col("page_label").alias("k4"), item.alias("m3"))
    d = docs.withColumn("page", F.coalesce(present(F.col("page_label")), F.col("page_number").cast("string"))).select("qid", "rank", F.col("linked_asset_id").alias("linked"), F.col("element_id").alias("elem"), F.col("doc_id").alias("doc"), "page")
    direct = d.join(by_asset, d["linked"] == F.col("k1"), "left").join(by_element, d["elem"] == F.col("k2"), "left").withColumn("m", F.coalesce("m1", "m2"))
    one = direct.where(F.col("m").isNotNull()).select("qid", "rank", F.lit(0).alias("at"), "m")
    # a query meets a page once, at its first rank
    rest = direct.where(F.col("m").isNull()).groupBy("qid", "doc", "page").agg(F.min("rank").alias("rank"))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("qid"), F.lit(SALTS)).cast("int")).repartition(tasks, "doc", "page", "salt")
    by_page = by_page.withColumn("k5", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(tasks, "k3", "k4", "k5")
    many = rest.join(by_page, (rest["doc"] == F.col("k3")) & (rest["page"] == F.col("k4")) & (rest["salt"] == F.col("k5"))).select("qid", "rank", F.col("m3.pos").alias("at"), F.col("m3").alias("m"))
    found = one.unionByName(many.withColumn("at", F.col("at").cast("int"))).where(F.coalesce(F.col("m.asset_id"), F.lit("")) != "")
    # one shuffle, by query, does for both windows
    found = found.repartition(tasks, "qid")
    seen = first_by(found.select("qid", "rank", "at", "m.asset_id", "m.type", "m.file_path", F.coalesce("m.page_label", F.lit("?")).alias("page_label"), F.col("m.element").alias("element_id")), ["qid", "asset_id"], "rank", "at")
    order = Window.partitionBy("qid").orderBy("rank", "at")
    placed = seen.withColumn("pos", F.row_number().over(order))
    return (placed if most is None else placed.where(F.col("pos") <= most)).select("qid", "pos", "asset_id", "type", "file_path", "page_label", "element_id")


def attachments(linked: DataFrame, hits: DataFrame, docs: DataFrame, manifest: DataFrame, most: int = 6) -> DataFrame:
    """Linked assets, then image hits whose doc_id or doc_slug was retrieved; cut to most, each asset once, and only then kept by page or link.

    linked (qid, pos, asset_id, page_label, file_path, type), hits (qid, rank, asset_id, doc_id, doc_slug,
    page_label, file_path, type), docs as in resolve() with doc_slug. Pages are compared without their document.
    """
    m = last_by(manifest, ["asset_id"], "pos").select("asset_id", F.col("doc_id").alias("m_doc"), F.col("file_path").alias("m_path"), F.col("page_label").alias("m_page"))
    cols = ["qid", "grp", "at", "asset_id", "doc_id", "type", "file_path", "page_label"]
    a = linked.where(F.col("pos") <= most).join(m, "asset_id", "left").select("qid", F.lit(0).alias("grp"), F.col("pos").cast("int").alias("at"), "asset_id", F.col("m_doc").alias("doc_id"), "type", F.coalesce(present(F.col("m_path")), "file_path").alias("file_path"), F.coalesce("m_page", "page_label").alias("page_label"))
    seen = docs.groupBy("qid").agg(F.collect_set("doc_id").alias("ids"), F.collect_set("doc_slug").alias("slugs"))
    h = hits.where(F.coalesce("asset_id", F.lit("")) != "").join(seen, "qid", "left")
    known = (F.coalesce(F.size("ids"), F.lit(0)) > 0) | (F.coalesce(F.size("slugs"), F.lit(0)) > 0)
    inside = F.coalesce(F.array_contains("ids", F.col("doc_id")), F.lit(False)) | F.coalesce(F.array_contains("slugs", F.col("doc_slug")), F.lit(False))
    b = h.where(~known | inside).select("qid", F.lit(1).alias("grp"), F.col("rank").cast("int").alias("at"), "asset_id", "doc_id", "type", "file_path", "page_label")
    merged = first_by(a.select(cols).unionByName(b.select(cols)), ["qid", "asset_id"], "grp", "at")
    cut = merged.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("grp", "at"))).where(F.col("pos") <= most)
    ok_ids = docs.where(F.coalesce("linked_asset_id", F.lit("")) != "").select("qid", F.col("linked_asset_id").alias("asset_id")).distinct()
    ok_pages = docs.select("qid", F.coalesce(present(F.col("page_label")), nonzero(F.col("page_number")).cast("string")).alias("page_label")).where("page_label is not null").distinct()
    by_id = cut.join(ok_ids, ["qid", "asset_id"], "left_semi")
    by_page = cut.join(ok_ids, ["qid", "asset_id"], "left_anti").join(ok_pages, ["qid", "page_label"], "left_semi")
    return by_id.unionByName(by_page).select("qid", "pos", "asset_id", "doc_id", "type", "file_path", "page_label", F.concat(F.lit("/assets/"), F.col("asset_id")).alias("url"))


def to_embed(manifest: DataFrame, files: DataFrame, overwrite: bool = False) -> DataFrame:
    """Manifest rows whose image still needs a vector and whose file exists."""
    some = manifest.where(F.col("file_path").rlike(C.IMAGE_SUFFIX))
    if not overwrite:
        some = some.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0)
    return some.join(files.select("file_path").distinct(), "file_path", "left_semi")


def local_path(file_path: Column, root: str) -> Column:
    """An asset's file: absolute paths and URIs as they are, others below root."""
    return F.when(F.coalesce(file_path, F.lit("")) == "", None).when(file_path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), file_path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), file_path))


def upload_name(name: Column) -> Column:
    """Whether a stored upload may be served under this name."""
    return F.coalesce(name.rlike(C.UPLOAD_NAME), F.lit(False))


def upload_problem(content, mime=None):
    """Why an uploaded file is refused: empty, too large or of another kind than JPEG, PNG, WebP; null if it isn't."""
    magic = F.hex(F.substring(content, 1, 12))
    known = magic.startswith("FFD8FF") | magic.startswith("89504E470D0A1A0A") | (magic.startswith("52494646") & magic.endswith("57454250"))
    return F.when(F.octet_length(content) == 0, "empty").when(F.octet_length(content) > C.MOST_UPLOAD_BYTES, "too_large").when(~known, "type")


def image_size(content: Column) -> Column:
    """struct<width, height> from the head of a PNG, JPEG or WebP file; null where it can't be read."""

    @F.pandas_udf("struct<width:int,height:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_image_size(bytes(x)) if x is not None else (None, None) for x in s], columns=["width", "height"]).astype("Int32")

    return run(content)


def _image_size(b: bytes) -> tuple[int | None, int | None]:
    def big(at: int, n: int) -> int:
        return int.from_bytes(b[at : at + n], "big")

    def little(at: int, n: int) -> int:
        return int.from_bytes(b[at : at + n], "little")

    if b.startswith(b"\x89PNG\r\n\x1a\n") and b[12:16] == b"IHDR" and len(b) >= 24:
        return big(16, 4), big(20, 4)
    if b.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 <= len(b) and b[at] == 0xFF:
            mark = b[at + 1]
            # frame headers, but for the tables among their numbers
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return big(at + 7, 2), big(at + 5, 2)
            at += 2 if mark in (0x01, 0xFF) or 0xD0 <= mark <= 0xD8 else 2 + big(at + 2, 2)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        kind = b[12:16]
        if kind == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
        if kind == b"VP8L":
            bits = little(21, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 ":
            return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    return None, None


def image_problem(content: Column) -> Column:
    """Why an uploaded image is refused: what upload_problem says, then undecodable or too_many_pixels; null if it isn't."""
    size = image_size(content)
    pixels = size["width"].cast("long") * size["height"]
    return F.coalesce(upload_problem(content), F.when(F.coalesce(pixels, F.lit(0)) <= 0, "undecodable").when(pixels > C.MOST_PIXELS, "too_many_pixels"))


def backfill(manifest: DataFrame, files: DataFrame, encode, overwrite: bool = False) -> DataFrame:
    """The whole manifest, with embeddings by encode(file_path) where to_embed asks for them."""
    todo = to_embed(manifest, files, overwrite).select("asset_id").distinct().withColumn("_todo", F.lit(True))
    joined = manifest.join(todo, "asset_id", "left")
    return joined.withColumn("embedding", F.when(F.col("_todo"), encode(F.col("file_path"))).otherwise(F.col("embedding"))).drop("_todo")
