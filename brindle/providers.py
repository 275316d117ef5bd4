"""Model-dependent steps, with deterministic offline defaults. Each is a function of columns; models run in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle import config as C
from brindle.functions.text import let
from brindle.operators.retrieve import overlap_score, sparse_encode, tokens, unit

Embed = Callable[[Column], Column]


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Signed feature hashing of terms, unit length: the offline dense encoder."""
    terms = tokens(F.coalesce(text, F.lit("")))
    slots = F.transform(terms, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dim)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = let(slots, lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.aggregate(F.filter(held, lambda x: x["i"] == j), F.lit(0.0), lambda a, x: a + x["s"])))
    return F.transform(unit(raw), lambda x: x.cast("float"))


def encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Embed:
    """A dense encoder from a model: load() runs once per worker and gives encode(texts)."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in encode(s.fillna("").tolist())])

    return run


def captioner(ask: Callable[[bytes], str], tries: int = 3, wait_s: float = 5.0) -> Embed:
    """Captions of images by a model: tries again after wait_s, twice that, and so on; null if all fail."""
    def one(image: bytes) -> str | None:
        for attempt in range(tries):
            try:
                return ask(image)
            except Exception:  # noqa: BLE001  any failure of the service counts as a try
                if attempt + 1 < tries:
                    time.sleep(wait_s * 2**attempt)
        return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


def generator(*asks: Callable[[str], str], failed: str = "The answer service failed: {error}", none: str = "No answer service is configured.") -> Callable[[Column, Column], Column]:
    """Answers by the first of some services that answers; where all fail, a text with the last error; none where there is no service."""

    def one(prompt: str | None) -> str:
        said = none
        for ask in asks:
            try:
                return ask(prompt or "") or ""
            except Exception as x:  # noqa: BLE001  any failure of a service calls the next one
                said = failed.format(error=x)
        return said

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return lambda prompt, context: run(prompt)


def image_embedding(content: Column, dim: int = 64) -> Column:
    """The offline image encoder: signed hashing of a file's 16-byte pieces, unit length; null for null and empty files."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(content) - 1) / 16).cast("int")), lambda i: F.hex(F.substring(content, i * 16 + 1, F.lit(16))))
    return F.when(F.octet_length(content) > 0, hashed_embedding(F.array_join(pieces, " "), dim))


def image_encoder(load: Callable[[], Callable[[list[bytes]], list[list[float]]]]) -> Embed:
    """An image encoder from a model: load() runs once per worker and gives encode(files); an encoder of texts into the same space comes from encoder(). Null where a batch fails."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            there = [bytes(x) for x in s if x is not None]
            try:
                vectors = iter([list(map(float, v)) for v in encode(there)])
                out = pd.Series([None if x is None else next(vectors) for x in s], dtype=object)
            except Exception:  # noqa: BLE001  a query whose image can't be read finds nothing
                out = pd.Series([None] * len(s), dtype=object)
            yield out

    return run


def extractive_answer(prompt: Column, context: Column) -> Column:
    """The offline answer: the first source's first sentence, with its citation; the refusal without context."""
    body = F.regexp_extract(context, "(?s)---\\n(?:\\[Contains visual aid: [^\\]]*\\]\\n)?(.*?)(?:[.!?]|\\n|$)", 1)
    return F.when(F.coalesce(context, F.lit("")) == "", C.NO_ANSWER).otherwise(F.concat(F.trim(body), F.lit(". [S1]")))


rerank_score = overlap_score
