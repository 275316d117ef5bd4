"""Context, sources, prompts, gates and answers for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle import config as C
from brindle.functions.text import citations_hold, nonzero, present, strip


def _title() -> Column:
    return F.coalesce(present(F.col("title")), F.coalesce(F.col("doc_slug"), F.lit("Doc")))


def _page() -> Column:
    return F.coalesce(present(F.col("page_label")), nonzero(F.col("page_number")).cast("string"), F.lit("?"))


def entries(docs: DataFrame, labelled: bool = True) -> DataFrame:
    """docs (qid, rank, content, title, doc_slug, page_label, page_number, linked_asset_id): adds sid and entry.

    labelled writes [S1] and keeps the content as it is; otherwise there is no label and the content is trimmed.
    """
    sid = F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("string"))
    head = F.concat(F.lit("\n--- Source [") if labelled else F.lit("\n--- Source"), F.concat(F.col("sid"), F.lit("]")) if labelled else F.lit(""), F.lit(": "), _title(), F.lit(" (Page "), _page(), F.lit(") ---\n"))
    aid = F.when(F.coalesce(F.col("linked_asset_id"), F.lit("")) != "", F.concat(F.lit("[Contains visual aid: "), F.col("linked_asset_id"), F.lit("]\n"))).otherwise("")
    content = F.coalesce(F.col("content"), F.lit(""))
    return docs.withColumn("sid", sid).withColumn("entry", F.concat(head, aid, content if labelled else strip(content), F.lit("\n")))


def within_budget(listed: DataFrame, limit: int = 6000) -> DataFrame:
    """Entries up to the first one that would pass the limit; a later short one stays out too."""
    upto = F.sum(F.length("entry")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return listed.withColumn("upto", upto).where(F.col("upto") <= limit)


def context(docs: DataFrame, limit: int = 6000, labelled: bool = True) -> DataFrame:
    """One row per query: context, labels of its sources, characters, and the map of sources."""
    kept = within_budget(entries(docs, labelled), limit)
    gathered = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "entry", "sid", "chunk_id", "doc_slug", "title", _page().alias("page_label")))).alias("e"), F.max("upto").alias("chars"))
    parts = gathered.select("qid", F.array_join(F.transform("e", lambda s: s["entry"]), "").alias("context"), F.transform("e", lambda s: s["sid"]).alias("allowed"), "chars", F.transform("e", lambda s: s.dropFields("rank", "entry")).alias("source_map"))
    every = docs.select("qid").distinct().join(parts, "qid", "left")
    return every.select("qid", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), "source_map")


def sources(docs: DataFrame, preview: int = 100, falsy: bool = True) -> DataFrame:
    """docs as display rows. falsy: a score of zero gives way to the next one, and dots follow only a full preview; else null alone does, and dots always follow."""
    text = F.substring(F.coalesce(F.col("content"), F.lit("")), 1, preview)
    if falsy:
        score = F.coalesce(nonzero(F.col("rerank_score")), nonzero(F.col("rrf_score")), nonzero(F.col("score")), F.lit(0.0))
        shown = F.concat(text, F.when(F.length(text) >= preview, "...").otherwise(""))
    else:
        score = F.coalesce("rerank_score", "rrf_score", F.lit(0.0))
        shown = F.concat(text, F.lit("..."))
    return docs.select("qid", "rank", F.coalesce("chunk_id", F.lit("na")).alias("chunk_id"), F.coalesce("doc_slug", F.lit("Unknown")).alias("doc_slug"), "title", F.coalesce("page_label", F.lit("?")).alias("page_label"), shown.alias("content_preview"), score.alias("score"), F.coalesce("type", F.lit("text")).alias("type"))


def history(messages: DataFrame, limit: int = 8, by: str = "chat_id", order: str = "turn") -> DataFrame:
    """The last turns of each chat as lines; empty ones are dropped after the cut."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    last = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= limit).withColumn("content", strip(F.coalesce("content", F.lit(""))))
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("content"))
    lines = F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct(F.col(order).alias("o"), line.alias("l")))))
    return last.groupBy(by).agg(F.array_join(F.transform(lines, lambda s: s["l"]), "\n").alias("history"))


RULES = (
    "Answer only from the context below.\n"
    "1. Cite sources as [S#], with the labels of the context.\n"
    f'2. If the context does not hold the answer, say "{C.NO_ANSWER}"\n'
    "3. Mention visual aids that a source names.\n"
    "4. Be brief and exact.\n"
)


def prompt(query: Column, context_: Column, history_: Column | None = None, rules: str = RULES) -> Column:
    past = F.lit("") if history_ is None else F.when(history_ != "", F.concat(F.lit("\nHISTORY:\n"), history_, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(rules), past, F.lit("\nCONTEXT:\n"), context_, F.lit("\n\nQUERY:\n"), query, F.lit("\n"))


CHAIN_RULES = (
    "Use the context below and nothing else.\n"
    f'If it does not answer the question, say "{C.NO_ANSWER}"\n'
    "Name the visual aids that the context mentions.\n"
)
IMAGE_RULES = (
    "The context holds captions of images that resemble the query's image.\n"
    "1. Describe what the captions support, and cite them as [S#].\n"
    f'2. If no caption fits, say "{C.NO_ANSWER}"\n'
)


def chain_prompt(query: Column, context_: Column) -> Column:
    """For one question without a history, over unlabelled sources."""
    return prompt(query, context_, None, CHAIN_RULES)


def image_prompt(query: Column, context_: Column) -> Column:
    """For answers from image hits; an empty query asks what the image shows."""
    return prompt(F.coalesce(present(strip(query)), F.lit("What does the image show?")), context_, None, IMAGE_RULES)


def answer_images(hits: DataFrame, queries: DataFrame, generate, conf: C.Retrieval = C.Retrieval()) -> DataFrame:
    """Answers from image hits (see image_docs) by their captions: context, prompt, generate, gates. Queries without a captioned hit get the refusal."""
    docs = image_docs(hits)
    q = queries.join(context(docs, conf.context_chars), "qid", "left")
    asked = q.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("prompt", image_prompt(F.col("query"), F.col("context")))
    said = asked.withColumn("answer", generate(F.col("prompt"), F.col("context")))
    return gate(said.join(passes_score(docs, conf.min_top_score), "qid", "left"), conf)


def image_docs(hits: DataFrame) -> DataFrame:
    """Image hits (qid, rank, asset_id, caption, title, doc_slug, page_label, score) as documents for context(), captions as content; hits without one are left out."""
    some = hits.where(F.coalesce("caption", F.lit("")) != "")
    none = F.lit(None)
    return some.select("qid", "rank", F.col("caption").alias("content"), "title", "doc_slug", "page_label", none.cast("int").alias("page_number"), F.col("asset_id").alias("linked_asset_id"), F.col("asset_id").alias("chunk_id"), none.cast("double").alias("rerank_score"), none.cast("double").alias("rrf_score"), "score")


def passes_score(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """qid, passes: whether the first document's score (zero gives way to the next kind) reaches least."""
    first = docs.where(F.col("rank") == 1)
    score = F.coalesce(nonzero(F.col("rerank_score")), nonzero(F.col("rrf_score")), nonzero(F.col("score")), F.lit(0.0))
    return first.select("qid", (score >= least).alias("passes"))


def gate(answers: DataFrame, conf: C.Retrieval = C.Retrieval()) -> DataFrame:
    """answers (qid, answer, allowed, passes): what doesn't cite allowed sources, or rests on too low a score, becomes the fixed refusal."""
    cites = citations_hold(F.col("answer"), F.col("allowed")) if conf.enforce_citations else F.lit(True)
    good = cites & F.coalesce("passes", F.lit(False))
    return answers.withColumn("answer", F.when(good, F.col("answer")).otherwise(C.NO_ANSWER))


def answer(docs: DataFrame, queries: DataFrame, generate, conf: C.Retrieval = C.Retrieval(), history_: DataFrame | None = None) -> DataFrame:
    """The whole answering plan: context, prompt, generate(prompt column, context column), gates.

    docs as in entries(), with rerank_score, rrf_score and score; queries (qid, query).
    """
    ctx = context(docs, conf.context_chars)
    q = queries.join(ctx, "qid", "left")
    if history_ is not None:
        q = q.join(history_, "qid", "left")
    past = F.coalesce("history", F.lit("")) if history_ is not None else None
    asked = q.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("prompt", prompt(F.col("query"), F.col("context"), past))
    said = asked.withColumn("answer", generate(F.col("prompt"), F.col("context")))
    return gate(said.join(passes_score(docs, conf.min_top_score), "qid", "left"), conf)
