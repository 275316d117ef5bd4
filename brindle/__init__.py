"""Document-retrieval analytics on Spark: ingest, index, retrieve, answer, evaluate."""

__version__ = "0.1.0"
