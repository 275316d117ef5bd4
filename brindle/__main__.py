"""python -m brindle index|search|evaluate: runs over artifacts at rest. Ingestion needs a parser and is called from Python (plans.jobs.ingest)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="brindle")
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("index", help="index chunk records")
    i.add_argument("--chunks", required=True)
    i.add_argument("--root", required=True)
    i.add_argument("--no-prune", action="store_true")
    s = sub.add_parser("search", help="search an index")
    s.add_argument("--root", required=True)
    s.add_argument("--query", action="append", required=True)
    s.add_argument("--top", type=int, default=5)
    e = sub.add_parser("evaluate", help="metrics of a gold set")
    e.add_argument("--root", required=True)
    e.add_argument("--gold", required=True)
    e.add_argument("--k", default="1,3,5,10")
    e.add_argument("--out")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    from brindle.config import Retrieval, csv
    from brindle.plans import jobs
    from brindle.session import local_session, ship
    from brindle.sources import readers, sinks

    a = arguments(argv)
    spark = ship(local_session())
    if a.what == "index":
        jobs.build_index(spark, readers.chunks(spark, a.chunks), a.root, prune=not a.no_prune).show(truncate=False)
    elif a.what == "search":
        q = spark.createDataFrame(list(enumerate(a.query)), "qid long, query string")
        jobs.search(spark, a.root, q, conf=Retrieval(rerank_n=a.top)).select("qid", "rank", "chunk_id", "rerank_score", F.substring("content", 1, 100).alias("preview")).orderBy("qid", "rank").show(100, truncate=False)
    else:
        ks = [int(k) for k in csv(a.k)]
        gold = readers.gold(spark, a.gold)
        q = gold.select(F.col("pos").alias("qid"), "query")
        found = jobs.search(spark, a.root, q, conf=Retrieval(rerank_n=max(ks)))
        named = found.join(gold.select(F.col("pos").alias("qid"), "id"), "qid").select(F.col("id").alias("qid"), "rank", "chunk_id")
        elements = sinks.current(spark, a.root).select("chunk_id", "element_id")
        m = jobs.evaluate_run(gold, named, ks, elements)
        m.orderBy("kind", "k").show(100, truncate=False)
        if a.out:
            sinks.report(m, a.out)


if __name__ == "__main__":
    main()
