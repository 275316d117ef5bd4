"""The pipeline's stages, one after the other, on the smallest tables."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from brindle.llm.common import read_table, stored  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, FOLDER), f"test-{i}")
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3]
    assert docs.agg({"length": "max"}).first()[0] <= 2048
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns)


def test_empty(spark):
    docs = read_table(spark, FOLDER, "documents").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, FOLDER), f"empty-{i}")
    assert docs.count() == 0


def test_run_keeps_only_what_is_read(spark):
    from brindle.llm.common import written

    with written() as paths:
        packed = corpus_pipeline.run(spark, FOLDER)
    left = [os.path.basename(p).rsplit("-", 1)[0] for p in paths if os.path.exists(p.removeprefix("file://"))]
    last = len(corpus_pipeline.STAGES) - 2
    assert f"stage-{last}" in left and not {f"stage-{i}" for i in range(last)} & set(left)
    assert packed.agg({"length": "sum"}).first()[0] > 0
