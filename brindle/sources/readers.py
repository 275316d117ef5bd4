"""Readers of raw files and of artifacts at rest."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from brindle import schemas as S
from brindle.functions import ids, text as T
from brindle.sources import files as own
from brindle.sources.scratch import kept


#: A table of fewer bytes than SPREAD per core may stand in a single row group, which one task reads; under LEAST it isn't worth a shuffle.
SPREAD, LEAST = 16 * 2**20, 4 * 2**20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows; a small one is dealt to all cores (SPREAD bytes a core are shuffled at most), a large one is read as it lies."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if LEAST <= size < SPREAD * cores else rows


def raw_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """One row per file below a folder: path, content, doc_id, slug, title, created_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return _titled(files, "content", "length", ids.doc_id(F.col("content")).alias("doc_id"))


def _titled(files: DataFrame, *columns) -> DataFrame:
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    out = files.select("path", *columns, T.slug(stem).alias("doc_slug"), ids.iso_seconds(F.col("modificationTime")).alias("created_at"))
    return out.withColumn("title", T.title_of(F.col("doc_slug")))


class Place(NamedTuple):
    """Where files lie: a folder as Spark's readers name it, and how many tasks their contents are dealt to."""

    root: str
    tasks: int

    @staticmethod
    def opened(root: str):
        """The folder's file system and its path there; fails where pyarrow doesn't know the store."""
        from pyarrow import fs

        if root.startswith("file:"):
            return fs.LocalFileSystem(), root.removeprefix("file:")
        scheme, _, rest = root.partition("://")
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")

    def contents(self):
        """A function that opens a file by its path."""
        store, base = self.opened(self.root)
        return lambda path: store.open_input_file(base + path.removeprefix(self.root))


#: Bytes and files that one task reads.
TASK_BYTES, TASK_FILES = 32 * 2**20, 2000


def located_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> tuple[DataFrame, Place | None]:
    """raw_files without their contents, and the place from which parse_files reads those.

    Tasks list the folder and read the files for their doc_id, so the driver holds no row per file, as the
    index of Spark's readers does. A store that pyarrow can't open, or a folder with wildcards, is left to
    raw_files, with contents and without a place.
    """
    at, store = own.at(spark, folder)
    root = store.makeQualified(at).toString().rstrip("/")
    try:
        Place.opened(root)
    except Exception:  # noqa: BLE001  Spark's readers may know the store
        return raw_files(spark, folder, pattern), None
    if re.search(r"[*?\[\]{}]", folder):
        return raw_files(spark, folder, pattern), None
    listed = kept(_listed(spark, root, pattern), "listed")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    place = Place(root, max(1, min(n, cores), -(-n // TASK_FILES), -(-size // TASK_BYTES)))

    def digests(batches):
        import pyarrow as pa

        opened = place.contents()
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    found.append(hashlib.file_digest(f, "md5").hexdigest())
            yield batch.append_column("doc_id", pa.array(found, pa.string()))

    dealt = listed.repartition(place.tasks, "path").mapInArrow(digests, f"{LISTED}, doc_id string")
    at = dealt.withColumn("modificationTime", F.timestamp_micros("modified"))
    return kept(_titled(at, "length", "doc_id"), "files"), place


LISTED = "path string, length long, modified long"


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, length, modified (microseconds) of the files below a folder that Spark's binary reader would give: one task lists the folder itself, others what lies in its folders."""
    schema = f"{LISTED}, folder boolean"
    # the pattern as Spark's readers understand it
    wanted = re.compile(spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern(), re.DOTALL)

    def batches_of(rows: Iterator[tuple]):
        import pyarrow as pa
        from itertools import islice

        while some := list(islice(rows, 10000)):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=["path", "length", "modified", "folder"])

    def named(rows: Iterator[tuple], base: str):
        return ((root + path.removeprefix(base), *rest) for path, *rest in rows)

    def first(batches):
        store, base = Place.opened(root)
        for _ in batches:
            yield from batches_of(named(_entries(store, base, wanted), base))

    def below(batches):
        store, base = Place.opened(root)
        for batch in batches:
            folders = [base + path.removeprefix(root) for path in batch.column("path").to_pylist()]
            yield from batches_of(named(_walk(store, folders, wanted), base))

    top = kept(spark.range(1, numPartitions=1).mapInArrow(first, schema), "top")
    inner = top.where("folder").repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(below, schema)
    return top.where("not folder").unionByName(inner).where("length > 0").drop("folder")


def _walk(store, folders: list[str], wanted: re.Pattern) -> Iterator[tuple]:
    while folders:
        for entry in _entries(store, folders.pop(), wanted):
            if entry[3]:
                folders.append(entry[0])
            else:
                yield entry


def _entries(store, folder: str, wanted: re.Pattern) -> Iterator[tuple]:
    """(path, length, modified, whether it is a folder) of what a folder (or a file's own path) holds, but for hidden names and files of unwanted ones. A local folder is gone through entry by entry, others come whole."""
    from pyarrow import fs

    def seen(name: str, is_folder: bool) -> bool:
        hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
        return not hidden and (is_folder or wanted.fullmatch(name) is not None)

    if isinstance(store, fs.LocalFileSystem) and os.path.isdir(folder):
        with os.scandir(folder) as found:
            for x in found:
                if seen(x.name, x.is_dir()):
                    try:
                        s = x.stat()
                    except FileNotFoundError:
                        continue  # gone since, or a link to nothing
                    yield x.path, s.st_size, s.st_mtime_ns // 1000, x.is_dir()
        return
    itself = store.get_file_info(folder)
    for x in [itself] if itself.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder)):
        if seen(x.base_name, x.type == fs.FileType.Directory):
            yield x.path, x.size or 0, (x.mtime_ns or 0) // 1000, x.type == fs.FileType.Directory


def resolve_raw(name: str, folder: str) -> str:
    """A raw file's path: absolute paths and URIs as they are, others below folder."""
    return name if re.match("^(/|[A-Za-z][A-Za-z0-9+.-]*:)", name) else f"{folder.rstrip('/')}/{name}"


def in_order(files: DataFrame) -> DataFrame:
    """The paths of files and their places (from 0) in order of path; contents are not moved."""
    return files.select("path").distinct().withColumn("place", F.row_number().over(Window.orderBy("path")) - 1)


PARSED = f"path string, error string, {S.LAYOUT_ITEM}"


#: Rows of parsed files that a task gathers before they go on.
FRAME_ROWS = 2000


def parse_files(files: DataFrame, parser, place: Place | None = None) -> DataFrame:
    """Layout items from files by a provider: parser(path, content) yields (page_no, item_ord, kind, label, text, bbox). A file that fails gives one row with its error, and none of what it gave before; a file without items one row without a kind.

    With a place, the tasks that parse read the contents from there, one file at a time; a file that is not what its doc_id was made of has failed.
    """

    def given(pdf):
        return zip(pdf["path"], map(bytes, pdf["content"]), pdf["doc_id"], strict=True)

    def read(pdf):
        opened = place.contents()
        for path, doc in zip(pdf["path"], pdf["doc_id"], strict=True):
            with opened(path) as f:
                yield path, f.read(), doc

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in PARSED.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_no": "Int32", "item_ord": "Int64"})
        for pdf in batches:
            held: list = []  # the rows of several small files go out together: a frame costs more than a file
            for path, content, doc in given(pdf) if place is None else read(pdf):
                try:
                    if place is not None and hashlib.md5(content).hexdigest() != doc:
                        raise ValueError("the file was changed since it was listed")
                    rows = [(path, None, doc, *r) for r in parser(path, content)] or [(path, None, doc, None, None, None, None, None, None)]
                except Exception as x:  # noqa: BLE001  a broken file must not stop the others
                    rows = [(path, f"{type(x).__name__}: {x}", doc, None, None, None, None, None, None)]
                held += rows
                if len(held) >= FRAME_ROWS:
                    yield frame(held)
                    held = []
            if held:
                yield frame(held)

    if place is not None:
        return files.select("path", "doc_id").repartition(place.tasks, "path").mapInPandas(run, PARSED)
    return files.select("path", "content", "doc_id").mapInPandas(run, PARSED)


def parsed(files: DataFrame, parser) -> DataFrame:
    """The layout items of files that a parser reads."""
    return items_of(parse_files(files, parser))


def items_of(tried: DataFrame) -> DataFrame:
    return tried.where("error is null and kind is not null").drop("path", "error")


def failures_of(tried: DataFrame) -> DataFrame:
    """path, doc_id, error of the files that could not be read."""
    return tried.where("error is not null").select("path", "doc_id", "error")


def plain_parser(path: str, content: bytes):
    """Items of text, Markdown and HTML files; other kinds need a parser of their own and are an error here."""
    kind = path.rpartition(".")[2].lower()
    if kind not in ("txt", "md", "html", "htm"):
        raise ValueError(f"no parser for .{kind} files")
    text = content.decode("utf-8", "replace")
    if kind in ("html", "htm"):
        parts = [(tag, body) for tag, body in html_parts(text)]
    else:
        blocks = [x.strip() for x in re.split(r"\n\s*\n", text.replace("\r\n", "\n"))]
        parts = [("h1" if kind == "md" and x.startswith("#") else "table" if kind == "md" and x.startswith("|") else "p", x.lstrip("# ") if kind == "md" and x.startswith("#") else x) for x in blocks if x]
    for i, (tag, body) in enumerate(parts):
        what = "table" if tag == "table" else "image" if tag == "img" else "text"
        label = "SECTION_HEADER" if re.match("h[1-6]$|header", tag) else "PAGE_FOOTER" if tag == "footer" else "TEXT"
        yield 1, i, what, label, " ".join(body.split()) if what == "text" else body, [0.0, 20.0 * i, 100.0, 20.0 * i + 15]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0 within its file), value; however the files are split, by offset of the split and order within it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", before.alias("before"))
    return raw.join(starts, (raw["file"] == starts["f"]) & (raw["block"] == starts["b"])).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, skip: int = 0) -> DataFrame:
    """Records of JSON lines with file and line; the first skip lines of each file and blank lines are passed over, a broken line is an error."""
    lines = numbered_lines(spark, path).where((F.col("line") >= skip) & (F.trim("value") != ""))
    return lines.select("file", "line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*", "file", "line")


def chunks(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Chunk records, after the first skip lines of each file; a broken line is an error."""
    if skip:
        return json_lines(spark, path, S.CHUNK, skip).drop("file", "line")
    return spark.read.schema(S.CHUNK).option("mode", "FAILFAST").json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Document records; broken lines are skipped."""
    return spark.read.schema(S.DOCUMENT).option("mode", "DROPMALFORMED").json(path).where("doc_id is not null")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Assets of a JSON array in one file, which one task reads, numbered by place in it."""
    rows = spark.read.schema(S.ASSET).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def array_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object of arrays as rows (pos, key, value array); other values are dropped."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select("pos", F.col("e.key").alias(key), F.col("e.value").alias(value)).where(F.col(value).isNotNull())


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold queries from JSON lines, a list, or an object with queries or items."""
    if path.endswith(".jsonl"):
        rows = json_lines(spark, path, S.GOLD)
        return rows.withColumn("pos", F.row_number().over(Window.orderBy("file", "line")) - 1).drop("file", "line")
    raw = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    kind = raw.select(F.substring("v", 1, 1).alias("c"), F.get_json_object("v", "$.queries").alias("q"), F.get_json_object("v", "$.items").alias("i")).first()
    if kind is None or (kind["c"] != "[" and kind["q"] is None and kind["i"] is None):
        raise ValueError("gold queries: a list, or an object with queries or items")
    body = F.col("v") if kind["c"] == "[" else F.get_json_object("v", "$.queries" if kind["q"] is not None else "$.items")
    rows = raw.select(F.posexplode(F.from_json(body, ArrayType(StructType.fromDDL(S.GOLD)))).alias("pos", "g"))
    return rows.select("g.*", "pos")


_CLOSED = {f"h{i}" for i in range(1, 7)} | {"p", "figcaption"}  # end at any block tag
_HOLDING = {"table", "header", "footer"}  # hold whatever stands inside
_BLOCKS = _CLOSED | _HOLDING | set("html body head main article section aside nav div ul ol dl dt dd li figure blockquote pre form fieldset address hr center details summary tr td th thead tbody tfoot caption title".split())
_SILENT = {"head", "title", "script", "style", "template", "noscript"}
_AMP = "\ufdd0"  # stands for & while a page is parsed, so that entities stay as they are


def html_parts(html: str) -> list[tuple[str, str]]:
    """(tag, text) of a page's items in order; the tag is empty for text outside known tags, img for images (their alt text).

    An item ends at its own end tag or at that of an element around it; headings, paragraphs and loose
    text also at any block tag, list items at the next one and at a list inside.
    """
    from html.parser import HTMLParser

    out: list[list] = []

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.stack: list[str] = []
            self.item, self.depth = None, 0  # the open item, and how many elements are open around it

        def begin(self, tag):
            self.item, self.depth = [tag, ""], len(self.stack)
            out.append(self.item)

        def handle_starttag(self, tag, attrs):
            if self.item is not None:
                self.item[1] += " "
            if tag == "img":
                out.append(["img", dict(attrs).get("alt") or ""])
            if tag not in _BLOCKS and tag not in _SILENT:
                return
            if tag == "body" or (tag in _BLOCKS - {"title"} and "head" in self.stack and tag != "head"):
                self.stack = [x for x in self.stack if x not in _SILENT]  # a head without an end tag
            kind = self.item[0] if self.item is not None else None
            if kind is not None and tag in _BLOCKS and ((kind in _CLOSED or not kind) or (kind == "li" and tag in ("li", "ul", "ol"))):
                del self.stack[self.depth :]
                self.item = None
            silent = any(x in _SILENT for x in self.stack)
            if self.item is None and not silent and (tag in _CLOSED or tag in _HOLDING or tag == "li"):
                self.begin(tag)
            if tag != "hr":
                self.stack.append(tag)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)  # a slash doesn't close an element in HTML

        def handle_endtag(self, tag):
            if self.item is not None:
                self.item[1] += " "
                if tag in _BLOCKS and not self.item[0]:
                    self.item = None
            if tag in self.stack:
                del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]
                if self.item is not None and len(self.stack) <= self.depth and (self.item[0] or len(self.stack) < self.depth):
                    self.item = None

        def handle_data(self, data):
            if any(x in _SILENT for x in self.stack):
                return
            if self.item is None:
                if not data.strip():
                    return
                self.begin("")
            self.item[1] += data

    parser = Parser()
    parser.feed(html.replace("&", _AMP))
    parser.close()
    return [(tag, text.replace(_AMP, "&")) for tag, text in out]


def html_items(pages: DataFrame) -> DataFrame:
    """Layout items of web pages (page_id, html): one per heading, paragraph, list item, table, image or text outside these, in order; boxes by place."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = html_parts(html) if html else []
                if parts:
                    tags, texts = zip(*parts, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(tags, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "item_ord", "tag", "raw"])

    rows = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "doc_id string, item_ord long, tag string, raw string")
    t = F.col("tag")
    top = F.col("item_ord").cast("double") * 20
    kind = F.when(t == "table", "table").when(t == "img", "image").otherwise("text")
    label = F.when(t.rlike("^h[1-6]$|header"), "SECTION_HEADER").when(t == "footer", "PAGE_FOOTER").otherwise("TEXT")
    return rows.select("doc_id", F.lit(1).alias("page_no"), "item_ord", kind.alias("kind"), label.alias("label"), T.normalize(F.col("raw")).alias("text"), F.array(F.lit(0.0), top, F.lit(100.0), top + 15).alias("bbox"))
