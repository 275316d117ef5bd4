"""Dense, sparse and hybrid retrieval for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import let

#: Queries that meet the corpus at once; a block of them is one row of the join.
QUERY_BLOCK = 256
#: Terms of a block of sparse queries that are multiplied at once.
TERMS = 4096
#: Words in a row by which a text and a passage inside it are brought together.
ANCHOR = 3
#: Passages without an anchor that are compared with every text by broadcast.
SHORT_PASSAGES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def unit(v: Column) -> Column:
    """In double precision; zero vectors stay as they are."""
    return let(v.cast("array<double>"), lambda d: let(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda x: x / F.when(n > 0, n).otherwise(1.0))))


def top(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query, ranked from 1; equal scores in order of tie."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def packed(df: DataFrame, key: str, rows: int = 4 * QUERY_BLOCK, by: str | None = None) -> DataFrame:
    """df (key, vec array<double>): rows of up to so many vectors of one length (and one value of by, a whole number): dim, ids (an array), m (their bytes), and by."""
    kind = df.schema[key].dataType.simpleString()
    names = ["dim", "ids", "m", *([by] if by else [])]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(at, held):
            x = np.array([v for _, v in held], np.float64)
            cols = [pa.array([at[0]], pa.int32()), pa.array([[i for i, _ in held]], pa.list_(ids)), pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, *([pa.array([at[1]], pa.int32())] if by else [])], names=names)

        waiting: dict[tuple, list] = {}
        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            groups = batch.column(2).to_pylist() if by else [0] * batch.num_rows
            for i, v, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), groups, strict=True):
                at = len(v), g
                held = waiting.setdefault(at, [])
                held.append((i, v))
                if len(held) == rows:
                    yield block(at, waiting.pop(at))
        for at, held in waiting.items():
            yield block(at, held)

    columns = [key, "vec", *([F.col(by).cast("int")] if by else [])]
    return df.select(*columns).where("vec is not null").mapInArrow(run, f"dim int, ids array<{kind}>, m binary" + (f", {by} int" if by else ""))


def blocks_top_k(pairs: DataFrame, k: int) -> DataFrame:
    """pairs of a block of rows (dim, ids, m) and one of queries (qids, qm): qid, id, score of what can be among a query's k best. Scores are rounded to ten places."""
    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("qids", "ids")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            # one pair of blocks at a time, as they lie in the batch: Python holds no copy of them
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("dim", "ids", "m", "qids", "qm")}
            for r in range(batch.num_rows):
                dim, ids, qids = at["dim"][r].as_py(), at["ids"][r].values, at["qids"][r].values
                s = np.frombuffer(at["qm"][r].as_buffer()).reshape(-1, dim) @ np.frombuffer(at["m"][r].as_buffer()).reshape(-1, dim).T
                # ties are told apart after rounding: all that may round to the k-th best go on
                last = np.partition(s, s.shape[1] - k, axis=1)[:, -k] - 1e-9 if s.shape[1] > k else np.full(len(s), -np.inf)
                i, j = np.nonzero(s >= last[:, None])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[i, j])], names=["qid", "id", "score"])

    scored = pairs.select("dim", "ids", "m", "qids", "qm").mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, score double")
    return scored.withColumn("score", F.round("score", 10))


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """corpus (id, vec), queries (qid, vec), ids of any type: qid, id, score (cosine to ten places), rank.

    Both sides are packed into blocks; blocks of the corpus are dealt into as many groups as there are
    shuffle partitions, and the queries' blocks, the smaller side, are sent to each. A task multiplies
    two blocks at a time and keeps what can be among a query's k best, so no pair of a query and a row
    becomes a row of a table. Vectors of different length don't meet; norms are taken once per side.
    """
    groups = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = packed(corpus.select("id", unit(F.col("vec")).alias("vec")), "id").withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    q = packed(queries.select("qid", unit(F.col("vec")).alias("vec")), "qid", QUERY_BLOCK).toDF("dim", "qids", "qm")
    pairs = d.join(q.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))), ["g", "dim"])
    return top(blocks_top_k(pairs, k), k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The inverted index's rows: term, id, tf."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def inverse_frequency(postings: DataFrame, n_docs: int) -> DataFrame:
    """term, idf in thousandths: whole numbers keep sums equal in any order."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", F.floor(F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1)) * 1000 + 1000).cast("long").alias("idf"))


def term_statistics(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """postings (term, id, tf) of a corpus: term, df, tf, idf, all from one pass over the postings; the corpus is counted within the plan."""
    size = corpus.agg(F.count("*").alias("n_docs")).withColumn("one", F.lit(1))
    counts = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).withColumn("one", F.lit(1)).join(F.broadcast(size), "one")
    idf = F.floor(F.log((F.col("n_docs") + 1).cast("double") / (F.col("df") + 1)) * 1000 + 1000).cast("long")
    return counts.select("term", "df", "tf", idf.alias("idf"))


def sparse_encode(text: Column, terms: int = 2**31 - 1) -> Column:
    """The offline sparse encoder: struct<indices, values> of a text's terms (hashed into 0 .. terms - 1, sorted) and their counts; both arrays empty for an empty text."""
    at = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(terms)).cast("int"))
    return let(F.array_sort(at), _counted)


def _counted(run: Column) -> Column:
    """A sorted array's distinct items and their counts; a run of equal items ends where the next one begins."""
    last = F.filter(F.sequence(F.lit(1), F.size(run)), lambda i: (i == F.size(run)) | (F.get(run, i) != F.get(run, i - 1)))
    here = F.when(F.size(run) > 0, last).otherwise(F.array().cast("array<int>"))
    return let(here, lambda ends: F.struct(F.transform(ends, lambda i: F.get(run, i - 1)).alias("indices"), F.transform(ends, lambda i, n: (i - F.coalesce(F.get(ends, n - 1), F.lit(0))).cast("float")).alias("values")))


def term_vector(text: Column) -> Column:
    """struct<indices, values> of a text's terms themselves and their counts, for an index of words."""
    return let(F.array_sort(tokens(F.coalesce(text, F.lit("")))), _counted)


def term_vectors(docs: DataFrame, *columns: Column | str, text_col: str = "text") -> DataFrame:
    """columns of docs, terms and values of each text. A generator makes them, so that a text is cut once, however many of its columns are asked for."""
    return docs.select(*columns, F.inline(F.array(term_vector(F.col(text_col)))).alias("terms", "values"))


def sparse_postings(vectors: DataFrame, id_col: str = "id", col: str = "sparse") -> DataFrame:
    """Stored sparse vectors (id, struct<indices, values>) as the rows of an inverted index: term, id, value."""
    return vectors.select(F.col(id_col).alias("id"), F.explode(F.arrays_zip(F.col(f"{col}.indices").alias("term"), F.col(f"{col}.values").alias("value"))).alias("e")).select(F.col("e.term").alias("term"), "id", F.col("e.value").cast("double").alias("value"))


def sparse_packed(vectors: DataFrame, key: str, rows: int = 4 * QUERY_BLOCK) -> DataFrame:
    """vectors (key, sparse): rows of up to so many of them: ids (an array), n (how many entries each has), terms and values (of all, one after the other). Vectors that share a key count as one; entries without an index or a value don't count."""
    entries = F.filter(F.arrays_zip(F.col("sparse.indices").alias("term"), F.col("sparse.values").alias("value")), lambda e: e["term"].isNotNull() & e["value"].isNotNull())
    held = vectors.select(key, entries.alias("e")).where(F.size("e") > 0).groupBy(key).agg(F.flatten(F.collect_list("e")).alias("e"))
    cut = held.select(key, F.col("e.term").alias("terms"), F.col("e.value").cast("array<double>").alias("values"))
    kinds = cut.schema[key].dataType.simpleString(), cut.schema["terms"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, terms, values = batch.slice(at, rows).columns
                parts = ids, pc.list_value_length(terms), terms.flatten(), values.flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts], names=["ids", "n", "terms", "values"])

    return cut.mapInArrow(run, f"ids array<{kinds[0]}>, n array<int>, terms {kinds[1]}, values array<double>")


def sparse_blocks_top_k(pairs: DataFrame, k: int) -> DataFrame:
    """pairs of a block of sparse rows (ids, n, terms, values) and one of queries (qids, qn, qterms, qvalues): qid, id, score of what can be among a query's k best, of rows that share a term with it. Scores are rounded to ten places.

    The two blocks are multiplied as small matrices, TERMS terms at a time. What a task has seen of a block of queries is the least that its further rows must reach.
    """
    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("qids", "ids")]
    sides = ("qids", "qn", "qterms", "qvalues"), ("ids", "n", "terms", "values")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def product(left, right, rows, whole):
            """Scores, and which rows share a term; left and right: (row, term, value) of the entries of some terms."""
            width = rows[2]
            grid = lambda side, n, w=None: np.bincount(side[0] * width + side[1], w, n * width).reshape(n, width)
            a, b = grid(left, rows[0], left[2]), grid(right, rows[1], right[2])
            if whole:
                s = a @ b.T
                return s, s > 0
            in_a, in_b = grid(left, rows[0]) > 0, grid(right, rows[1]) > 0
            odd_a, odd_b = ~np.isfinite(a).all(1), ~np.isfinite(b).all(1)
            with np.errstate(invalid="ignore", over="ignore"):
                s = np.where(odd_a[:, None], 0, np.nan_to_num(a, posinf=0, neginf=0)) @ np.where(odd_b[:, None], 0, np.nan_to_num(b, posinf=0, neginf=0)).T
                # a value that isn't finite counts only where both sides have its term
                for j in np.flatnonzero(odd_b):
                    s[:, j] = np.where(in_a & in_b[j], a * b[j], 0).sum(1)
                for i in np.flatnonzero(odd_a):
                    s[i] = np.where(in_b & in_a[i], b * a[i], 0).sum(1)
            return s, in_a.astype(np.float32) @ in_b.T.astype(np.float32) > 0

        least: dict = {}
        for batch in batches:
            at = {name: batch.column(batch.schema.get_field_index(name)) for names in sides for name in names}
            for r in range(batch.num_rows):
                (qids, qn, qterms, qvalues), (ids, n, terms, values) = ([at[name][r].values for name in names] for names in sides)
                known = qterms.unique()
                found = pc.index_in(terms, value_set=known)
                some = found.is_valid().to_numpy(zero_copy_only=False)
                right = np.repeat(np.arange(len(ids)), n.to_numpy())[some], found.drop_null().to_numpy(), values.to_numpy()[some]
                left = np.repeat(np.arange(len(qids)), qn.to_numpy()), pc.index_in(qterms, value_set=known).to_numpy(), qvalues.to_numpy()
                # without zeros, signs and what isn't finite, a shared term shows in the score
                plain = all(len(x[2]) == 0 or (1e-100 < x[2].min() and x[2].max() < 1e100) for x in (left, right))
                score, met = np.zeros((len(qids), len(ids))), np.zeros((len(qids), len(ids)), bool)
                for lo in range(0, len(known), TERMS):
                    cut = [tuple(c[(x[1] >= lo) & (x[1] < lo + TERMS)] - (lo if i == 1 else 0) for i, c in enumerate(x)) for x in (left, right)]
                    s, m = product(*cut, (len(qids), len(ids), min(TERMS, len(known) - lo)), plain)
                    score += s
                    met |= m
                order = np.where(met, np.where(np.isnan(score), np.inf, score), -np.inf)
                # ties are told apart after rounding: all that may round to the k-th best go on
                last = np.partition(order, order.shape[1] - k, axis=1)[:, -k] - 1e-9 if order.shape[1] > k else np.full(len(order), -np.inf)
                block = qids[0].as_py()
                last = least[block] = np.maximum(last, least.get(block, -np.inf))
                i, j = np.nonzero(met & (order >= last[:, None]))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score[i, j])], names=["qid", "id", "score"])

    scored = pairs.select(*sides[0], *sides[1]).mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, score double")
    return scored.withColumn("score", F.round("score", 10))


def sparse_vector_top_k(corpus: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """corpus (id, sparse), queries (qid, sparse): qid, id, score (dot product to ten places), rank; rows that share no index never appear.

    As in dense_top_k, blocks of rows are dealt into groups and the queries' blocks are sent to each: no pair of a query and a row becomes a row of a table.
    """
    groups = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = sparse_packed(corpus.select("id", "sparse"), "id").withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    q = sparse_packed(queries.select("qid", "sparse"), "qid", QUERY_BLOCK).toDF("qids", "qn", "qterms", "qvalues")
    pairs = d.join(q.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))), "g")
    return top(sparse_blocks_top_k(pairs, k), k)


def _meet(postings: DataFrame, weighted: DataFrame, salts: int = 16) -> DataFrame:
    """Join on term; the postings of one term, a stop word's too, are dealt to several tasks, and the queries' rows, the smaller side, to each of them."""
    salted = postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return salted.join(weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["term", "salt"]).drop("salt")


def sparse_top_k(corpus: DataFrame, queries: DataFrame, k: int = 50, postings: DataFrame | None = None) -> DataFrame:
    """corpus (id, text), queries (qid, text): qid, id, score (sum of tf * tf * idf over shared terms), rank.

    postings (term, id, tf): the index of the corpus, if term_counts has been stored; else its texts are
    read, and only terms that a query holds leave the scan. Documents that share no term never appear.
    """
    asked = term_counts(queries.withColumnRenamed("qid", "id")).withColumnsRenamed({"id": "qid", "tf": "qtf"})
    vocabulary = asked.select("term").distinct()
    if postings is None:
        held = corpus.select("id", F.explode(tokens(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term", "id").agg(F.count("*").alias("tf"))
    else:
        held = postings.join(vocabulary, "term", "left_semi")
    # the corpus is counted within the plan: one row, sent to every task
    size = corpus.agg(F.count("*").alias("n_docs")).withColumn("one", F.lit(1))
    counted = held.groupBy("term").agg(F.count("*").alias("df")).withColumn("one", F.lit(1)).join(F.broadcast(size), "one")
    idf = F.floor(F.log((F.col("n_docs") + 1).cast("double") / (F.col("df") + 1)) * 1000 + 1000).cast("long")
    weighted = asked.join(counted.select("term", idf.alias("idf")), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    return top(_meet(held, weighted).groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("tf")).alias("score")), k)


def fuse(dense: DataFrame, sparse: DataFrame, rrf_k: int = 60, k: int = 50) -> DataFrame:
    """Reciprocal-rank fusion: qid, id, rrf_score, dense_score, compat_dense_score, rank.

    Ties keep the order of first sight: by dense rank, then by sparse rank. compat_dense_score is the
    score of the first branch that saw the row, dense_score null where the dense branch didn't.
    """
    d = dense.select("qid", "id", F.col("rank").alias("dr"), F.col("score").cast("double").alias("ds"), F.lit(None).cast("int").alias("sr"), F.lit(None).cast("double").alias("ss"))
    s = sparse.select("qid", "id", F.lit(None).cast("int").alias("dr"), F.lit(None).cast("double").alias("ds"), F.col("rank").alias("sr"), F.col("score").cast("double").alias("ss"))
    both = d.unionByName(s).groupBy("qid", "id").agg(*[F.max(c).alias(c) for c in ("dr", "ds", "sr", "ss")])
    part = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    fused = both.withColumn("rrf_score", part("dr") + part("sr"))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.col("dr").asc_nulls_last(), F.col("sr").asc_nulls_last())
    ranked = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("qid", "id", "rrf_score", F.col("ds").alias("dense_score"), F.coalesce("ds", "ss").alias("compat_dense_score"), "rank")


def hybrid(corpus: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 50, rrf_k: int = 60) -> DataFrame:
    return fuse(dense_top_k(vectors, query_vectors, k), sparse_top_k(corpus, queries, k), rrf_k, k)


def _runs(words: Column, body) -> Column:
    """body(i) for the first place i of each run of ANCHOR words."""
    return F.when(F.size(words) >= ANCHOR, F.transform(F.sequence(F.lit(0), F.size(words) - ANCHOR), body)).otherwise(F.transform(F.slice(F.array(F.lit(0)), 1, 0), body))


def _run_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + n) for n in range(ANCHOR)])


def holding(corpus: DataFrame, passages: DataFrame) -> DataFrame:
    """corpus (id, text), passages (qid, passage): each pair (qid, id) whose text holds the passage, letter for letter.

    All words of a passage but its first and last stand whole in any text that holds it. Its longest run
    of ANCHOR such words is its anchor; texts meet passages by the hashes of their own runs, and pairs
    that meet are compared in full. Passages of fewer inner words are compared with every text. Null
    texts and passages hold nothing; an empty passage stands in every text.
    """

    def anchored(w: Column) -> Column:
        longest = _runs(w, lambda i: F.struct(sum((F.length(F.get(w, i + n)) for n in range(1, ANCHOR)), F.length(F.get(w, i))).alias("chars"), _run_hash(w, i).alias("anchor")))
        return F.array_max(longest)["anchor"]

    def inner(w: Column) -> Column:
        return F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))

    asked = passages.select("qid", "passage", let(F.split("passage", "\\s+"), lambda w: let(inner(w), anchored)).alias("anchor")).where("passage is not null")
    runs = let(F.split("text", "\\s+"), lambda w: F.array_distinct(_runs(w, lambda i: _run_hash(w, i))))
    met = corpus.select("id", F.explode(runs).alias("anchor")).join(asked.where("anchor is not null"), "anchor").select("qid", "passage", "id").distinct()
    by_anchor = met.join(corpus.select("id", "text"), "id").where(F.contains("text", F.col("passage"))).select("qid", "id")
    short = asked.where("anchor is null").select("qid", "passage")
    short = F.broadcast(short) if short.limit(SHORT_PASSAGES + 1).count() <= SHORT_PASSAGES else short
    by_text = corpus.join(short, F.contains("text", F.col("passage"))).select("qid", "id")
    return by_anchor.unionByName(by_text).distinct()


def overlap_score(query: Column, text: Column) -> Column:
    """The offline reranker: share of the query's distinct terms that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def overlap_of_terms(query: Column, terms: Column) -> Column:
    """overlap_score of a query against a text's stored distinct terms."""
    return let(F.array_distinct(tokens(query)), lambda q: F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms)) / F.size(q)).otherwise(0.0))


def rerank(candidates: DataFrame, n: int = 5, score: Column | None = None) -> DataFrame:
    """candidates (qid, id, query, text, rank, ...): the n best by rerank_score, ties by earlier rank.

    Without a score the first n stay as they are and rerank_score is null.
    """
    if score is None:
        return candidates.where(F.col("rank") <= n).withColumn("rerank_score", F.lit(None).cast("double"))
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    scored = candidates.withColumn("rerank_score", F.round(score, 6))
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= n).drop("rank").withColumnRenamed("new_rank", "rank")


def image_search(assets: DataFrame, queries: DataFrame, k: int = 8, min_score: float | None = 0.0) -> DataFrame:
    """Cosine top-k over asset vectors; rows below min_score go (none of them, if it is None)."""
    found = dense_top_k(assets, queries, k)
    return found if min_score is None else found.where(F.col("score") >= min_score)


def search_images(assets: DataFrame, queries: DataFrame, encode, col: str, k: int = 8, min_score: float | None = 0.0) -> DataFrame:
    """queries (qid, col) by text or by image: encode(col) puts them into the assets' space; a query that can't be encoded finds nothing."""
    return image_search(assets, queries.select("qid", encode(F.col(col)).alias("vec")).where("vec is not null"), k, min_score)
