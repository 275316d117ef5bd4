"""Secret scan over a trigram inverted index, in DataFrame functions alone.

Each rule's regex gives a Boolean query over lower-cased trigrams that every match must contain:
literals give the AND of their trigrams, alternatives the OR of theirs, optional parts nothing. The
index has a posting (trigram, document) for each trigram that some query names; a rule's candidates
come from intersecting postings, and only they are scanned with that rule's regex. Rules without a
mandatory trigram are scanned in every text.

Spans are leftmost and not overlapping within a kind, in code points, end exclusive; a match whose
measured group is shorter than the rule asks for is dropped, and so is nothing else.

Cases: null and empty texts have no spans; rows that repeat a doc_id are scanned each by itself;
rows with a null doc_id share their candidates; an empty table gives no rows; further columns are
ignored; a text may hold any number of spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """kind, regex, the group whose length counts, its least length, and whether letters match in either case."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


#: Fixed patterns of the base kinds, in the order in which ties at one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Kinds that this method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)

#: Alternatives of a run of text that are followed one by one.
MOST_STRINGS = 16

#: A query is a trigram, ("and", parts), ("or", parts), or None where nothing is mandatory.
Query = str | tuple | None


def trigram_query(regex: str, any_case: bool = False) -> Query:
    """The Boolean query over lower-cased trigrams that each match of a regex fulfils."""
    from re import _parser as parser

    def grams(literal: str) -> list[str]:
        low = literal.lower() if literal.isascii() else ""
        return [low[i : i + 3] for i in range(len(low) - 2)]

    def both(parts: list) -> Query:
        flat_parts = [q for p in parts if p is not None for q in (p[1] if p[0] == "and" and not isinstance(p, str) else [p])]
        parts = list(dict.fromkeys(flat_parts))
        return parts[0] if len(parts) == 1 else ("and", tuple(parts)) if parts else None

    def literal(items) -> str | None:
        return "".join(chr(a) for op, a in items if str(op) == "LITERAL") if all(str(op) == "LITERAL" for op, _ in items) else None

    def settled(strings: list[str]) -> Query:
        """The query of a run of text that is one of some strings."""
        found = [both(grams(x)) for x in strings]
        return None if None in found else found[0] if len(found) == 1 else ("or", tuple(dict.fromkeys(found)))

    def flat(items):
        for op, arg in items:
            if str(op) == "SUBPATTERN":
                yield from flat(arg[-1])
            else:
                yield op, arg

    def walk(items) -> Query:
        parts: list = []
        run = [""]  # what the text just before here can be, as far as it is known
        for op, arg in flat(items):
            name, more = str(op), None
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                more = [chr(a) for _, a in arg]
            elif name == "BRANCH":
                more = [literal(x) for x in arg[1]]
            if more and None not in more and len(run) * len(more) <= MOST_STRINGS:
                run = [a + b for a in run for b in more]
                continue
            parts.append(settled(run))
            run = [""]
            if name == "BRANCH":
                found = [walk(x) for x in arg[1]]
                parts.append(None if None in found else ("or", tuple(found)))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                parts.append(walk(arg[2]))
        return both([*parts, settled(run)])

    return walk(parser.parse(regex))


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def holds(query: Query, grams: Column) -> Column:
    """Whether a set of trigrams fulfils a query."""
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [holds(q, grams) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index over a vocabulary: one row (gram, doc_id) per trigram that a document's text holds."""
    low = docs.select(docs["doc_id"].alias("doc_id"), F.lower(docs["text"]).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in vocabulary]))
    return low.select("doc_id", F.explode(present).alias("gram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Documents whose postings fulfil some rule's query: doc_id and kinds, the rules they are candidates for."""
    queries = {r.kind: trigram_query(r.regex, r.any_case) for r in rules}
    vocabulary = sorted(set().union(*map(trigrams_of, queries.values())))
    held = postings(docs, vocabulary).groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    kinds = F.array_compact(F.array(*[F.when(holds(q, F.col("grams")), F.lit(k)) for k, q in queries.items()]))
    return held.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, ord, kind, stop): places from the lengths of what lies between the matches."""
    pattern = F.lit(rule.java)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    between = F.transform(F.split(text, rule.java, -1), lambda x: F.length(x))
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("gap"), F.transform(hits, lambda x: F.length(x)).alias("len"), F.transform(measured, lambda x: F.length(x)).alias("measure"))
    one = "struct<start:int,ord:int,kind:string,stop:int>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        stop = start + s["len"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(s["measure"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, empty, step)["out"]


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")


def scan(docs: DataFrame, base: tuple = BASE, added: tuple = ADDED) -> DataFrame:
    """One row per document: doc_id, base and found (arrays of spans; found holds the base ones too)."""
    rules = [*base, *added]
    indexed = [r for r in rules if trigram_query(r.regex, r.any_case) is not None]
    # written first, so that the planner knows its size when it picks the join
    cand = stored(candidates(docs, indexed).withColumnRenamed("doc_id", "cand_id"), "secret-candidates") if indexed else None
    own = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    joined = own.join(cand, own["doc_id"].eqNullSafe(F.col("cand_id")), "left") if indexed else own.withColumn("kinds", F.array().cast("array<string>"))
    cols = []
    for i, r in enumerate(rules):
        if r in indexed:
            asked = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
        elif r.group == 0 and re.fullmatch(r"\[[^\]\\]*\]\+", r.regex):
            # a single class repeated: long enough runs, or none
            asked = F.col("text").rlike(f"{r.java[:-1]}{{{r.least}}}")
        else:
            asked = F.lit(True)
        cols.append(F.when(asked, spans(F.col("text"), r, i)).otherwise(no_spans()).alias(f"s{i}"))
    parts = joined.select("doc_id", *cols)
    return parts.select(
        "doc_id",
        F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(base))])).alias("base"),
        F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(rules))])).alias("found"),
    )


def listed(found: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
