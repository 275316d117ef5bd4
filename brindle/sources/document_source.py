"""A data source of parsed documents: spark.read.format("documents").

Options: path (a folder or URI that executors see), pattern (of file names), parser ("module:function",
as in readers.parse_files; plain_parser if none is given) and bytes (of files that one task reads, 128 MB
if none are given). The files below path are listed once and dealt into ranges of that size; a task opens
one file at a time. A file that can't be opened or parsed gives one row with its error, and none of what it
gave before. Rows are those of readers.parse_files; doc_id is the MD5 of a file's bytes.
"""

from __future__ import annotations

import fnmatch
import hashlib
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.sources.readers import PARSED

NAME = "documents"


class Files(InputPartition):
    """Some files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PARSED

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.pattern = options.get("pattern", "*")
        self.parser = options.get("parser", "brindle.sources.readers:plain_parser")
        self.bytes = int(options.get("bytes", 128 * 2**20))

    def _files(self):
        from pyarrow import fs

        root = self.root if ":" in self.root else f"file://{self.root}"
        return fs.FileSystem.from_uri(root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, base = self._files()
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        held = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern) and not x.base_name.startswith((".", "_")))
        ranges, size = [[]], 0
        for path, n in held:
            if ranges[-1] and size + n > self.bytes:
                ranges.append([])
                size = 0
            ranges[-1].append(path)
            size += n
        return [Files(r) for r in ranges]

    def read(self, partition: Files):
        files, _ = self._files()
        module, _, function = self.parser.partition(":")
        parse = getattr(importlib.import_module(module), function)
        for path in partition.paths:
            doc = None
            try:
                with files.open_input_file(path) as f:
                    content = f.read()
                doc = hashlib.md5(content).hexdigest()
                rows = [(path, None, doc, *r) for r in parse(path, content)] or [(path, None, doc, *[None] * 6)]
            except Exception as x:  # noqa: BLE001  a broken file must not stop the others
                rows = [(path, f"{type(x).__name__}: {x}", doc, *[None] * 6)]
            yield from rows


def documents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of the source, registered with the session."""
    spark.dataSource.register(Documents)
    return spark.read.format(NAME).options(path=path, **options).load()
