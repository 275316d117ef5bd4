"""Files that tasks list and read: the driver holds no row per file."""

import os

from brindle.plans import jobs
from brindle.sources import readers


def make(folder):
    files = {"a b.pdf": b"one", "sub/x=1/c.pdf": b"three", "sub/%41.md": b"# Four", "sub/ü.md": b"five", "other.html": b"<p>six", "empty.pdf": b"", ".hidden.pdf": b"no", "_blobs/d.pdf": b"no", ".staged/e.pdf": b"no", "_f.pdf": b"no", "_g=1.pdf": b"seven"}
    for name, body in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(body)
    os.utime(folder / "a b.pdf", (1.7e9, 1.7e9))
    (folder / "to nothing.pdf").symlink_to(folder / "missing.pdf")


def test_same_files_as_sparks_reader(spark, tmp_path):
    make(tmp_path)
    for folder in (str(tmp_path), f"file://{tmp_path}/", str(tmp_path / "sub"), str(tmp_path / "a b.pdf")):
        for pattern in ("*", "*.pdf", "*.{pdf,md}", "[^a]*", "?.pdf"):
            wanted = readers.raw_files(spark, folder, pattern).drop("content")
            files, place = readers.located_files(spark, folder, pattern)
            assert place is not None and sorted(files.select(wanted.columns).collect()) == sorted(wanted.collect()), (folder, pattern)
    assert readers.located_files(spark, str(tmp_path), "*")[0].count() == 6


def test_wildcard_folders_are_left_to_sparks_reader(spark, tmp_path):
    make(tmp_path)
    files, place = readers.located_files(spark, f"{tmp_path}/s*", "*")
    assert place is None and files.count() == 3


def test_parsed_where_they_lie(spark, tmp_path):
    """The same rows as from contents; a file that was changed since it was listed has failed."""
    make(tmp_path)
    files, place = readers.located_files(spark, str(tmp_path), "*")
    key = lambda df: sorted((r.path, r.doc_id, r.error or "", r.text or "") for r in df.collect())
    assert key(readers.parse_files(files, readers.plain_parser, place)) == key(readers.parse_files(readers.raw_files(spark, str(tmp_path), "*"), readers.plain_parser))
    (tmp_path / "other.html").write_bytes(b"<p>else")
    failed = readers.failures_of(readers.parse_files(files, readers.plain_parser, place)).where("path like '%.html'").collect()
    assert [r.error for r in failed] == ["ValueError: the file was changed since it was listed"]


def test_ingest_holds_no_file_list(spark, tmp_path, monkeypatch):
    """Of many files the driver's own index, which names what a scan reads, holds none: it names the parts of a table instead."""
    raw = tmp_path / "raw"
    raw.mkdir()
    for n in range(200):
        (raw / f"page-{n}.html").write_text(f"<p>Text of page {n}</p>")
    (raw / "page-x.pdf").write_bytes(b"%PDF")
    seen, parse = [], readers.parse_files
    monkeypatch.setattr(readers, "parse_files", lambda files, *rest: (seen.append(files.inputFiles()), parse(files, *rest))[1])
    for known in (0, 200):
        jobs.ingest(spark, str(raw), str(tmp_path / "out"), readers.plain_parser, pattern="page-*")
        assert not any("page-" in name for name in seen[-1]) and len(seen[-1]) < 100, known
    store = jobs.Store(spark, str(tmp_path / "out"))
    assert store.read("documents").count() == 200
    assert [(r.path.rpartition("/")[2], r.tries) for r in store.read("failures").collect()] == [("page-x.pdf", 2)]
