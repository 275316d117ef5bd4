"""Text functions as Column builders; no Python runs per row.

Patterns spell out word and space classes, since Java's own differ from the ones meant here: a word
character is a letter, a number or an underscore; white space holds U+001C to U+001F too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle import config as C

WORD = "[\\p{L}\\p{N}_]"
SPACE = "[\\s\\x1c-\\x1f]"
_U = "(?dU)"


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row: the optimizer copies an expression to each of its uses, but not into a lambda."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"{_U}^{SPACE}+|{SPACE}+$(?![\\n])", "")


def _joined_words(text: Column) -> Column:
    """Without soft hyphens, and with words whole that a line break had cut at a hyphen."""
    # the search for words is dear: texts without a hyphen before a line break pass it by
    broken = f"{_U}-{SPACE}*\\n"
    joined = lambda t: F.when(~t.rlike(broken), t).otherwise(F.regexp_replace(t, f"{_U}({WORD}+)-{SPACE}*\\n{SPACE}*({WORD}+)", "$1$2"))
    return let(F.replace(text, F.lit("­"), F.lit("")), joined)


def normalize(text: Column) -> Column:
    """One line: hyphen breaks joined, white space runs as one space, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(_joined_words(F.coalesce(text, F.lit(""))), f"{_U}{SPACE}+", " "))


def normalize_paragraphs(text: Column) -> Column:
    """Like normalize, but lines stay and blank lines shrink to one."""
    t = F.regexp_replace(_joined_words(F.coalesce(text, F.lit(""))), "\\r\\n?", "\n")
    lines = F.transform(F.split(t, "\n"), lambda x: strip(F.regexp_replace(x, " [ \\t]+|\\t[ \\t]*", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_U}{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def density(text: Column) -> Column:
    """Share of letters and numbers among the characters."""
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")) / F.greatest(F.lit(1), F.length(text))


def _whole(body: str) -> str:
    return f"{_U}(?<!{WORD}){body}(?!{WORD})"


#: Fixed patterns of technical terms: part numbers, pins, terminal blocks, wires, connectors, codes.
TECH_TERMS = (
    _whole("\\d{3}-\\d{4}"),
    _whole("[A-Z]{1,4}-\\d+"),
    _whole(f"TB{SPACE}*-?{SPACE}*\\d+"),
    _whole("\\d{2,}[A-Z]\\d{1,}"),
    _whole("[JKP]\\d{1,3}"),
    _whole(f"(?=[A-Z0-9]{{5,}}(?!{WORD}))(?=.*[A-Z])(?=.*\\d)[A-Z0-9]+"),
)


def tech_terms(text: Column) -> Column:
    """Matches over all patterns; one place may count for several. Each of them asks for a digit, so a text without one has none."""
    return F.when(~text.rlike("(?U)\\d"), 0).otherwise(reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in TECH_TERMS]))


def illegible(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in C.ILLEGIBLE]))


def quality(text: Column, kind: Column, ocr: Column | None = None, q: C.Quality = C.Quality()) -> Column:
    """struct<score, reasons, terms, words, density>: the rule-based chunk score and why."""
    target = kind.isin(*C.TARGET_TYPES)
    bad_ocr = (kind == "ocr_text") & (F.coalesce(ocr, F.lit(1.0)) < q.min_ocr if ocr is not None else F.lit(False))

    def judged(m: Column) -> Column:
        terms, n, d, murky = m["terms"], m["words"], m["density"], m["murky"]
        boost = F.least(terms * q.per_term, F.lit(q.most_terms))
        few = (n < q.min_words) & target
        thin = (d < q.min_density) & target if q.min_density and q.min_density > 0 else F.lit(False)
        score = F.lit(q.base) + F.when(terms > 0, boost).otherwise(0.0) - F.when(few, q.few_words).otherwise(0.0) - F.when(bad_ocr, q.low_ocr).otherwise(0.0) - F.when(thin, q.low_density).otherwise(0.0) - F.when(murky, q.illegible).otherwise(0.0)
        reasons = F.array_compact(
            F.array(
                F.when(terms > 0, F.format_string("tech_terms_found (+%.1f)", boost)),
                F.when(few, F.format_string("low_word_count (%d)", n)),
                F.when(bad_ocr, F.lit("low_ocr_conf")),
                F.when(thin, F.format_string("low_text_density (%.2f)", d)),
                F.when(murky, F.lit("illegible_content")),
            )
        )
        return F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"), reasons.alias("reasons"), terms.alias("terms"), n.alias("words"), d.alias("density"))

    # the patterns run once, however often score and reasons ask for what they count
    return let(F.struct(tech_terms(text).alias("terms"), word_count(text).alias("words"), density(text).alias("density"), illegible(text).alias("murky")), judged)


def score_bucket(score: Column) -> Column:
    out = F.lit(C.LAST_BUCKET)
    for top, name in reversed(C.SCORE_BUCKETS):
        out = F.when(score < top, name).otherwise(out)
    return out


def slug(stem: Column) -> Column:
    return F.regexp_replace(stem, f"{_U}[^\\p{{L}}\\p{{N}}_\\-]", "_")


def title_of(slug_: Column) -> Column:
    t = strip(F.replace(slug_, F.lit("_"), F.lit(" ")))
    return F.when(t == "", slug_).otherwise(t)


def short_title(text: Column, most: int = 60) -> Column:
    """First line-free characters of a message as a chat title."""
    t = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def slices(text: Column, size: int = 60) -> Column:
    """Consecutive slices of a text; none of an empty one."""
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(cuts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def present(text: Column) -> Column:
    """Null for null and for the empty string."""
    return F.when(text != "", text)


def nonzero(x: Column) -> Column:
    """Null for null and for zero."""
    return F.when(x != 0, x)


def shorten_prompt(text: Column, most: int = 12000) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n\n...[truncated]")))


def safe_set(values: Column) -> Column:
    """Distinct trimmed texts of an array's members, whatever their type; nulls and empty ones go."""
    texts = F.transform(F.coalesce(values, F.array()), lambda x: strip(x.cast("string")))
    return F.array_distinct(F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != ""))


def events(answer_id: Column, answer: Column, size: int = 60) -> Column:
    """What a client of an answer's stream gets, in order: array of struct<type, content>, a start, its slices as tokens, and the whole as final."""
    one = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("content"))
    return F.concat(F.array(one("start", answer_id.cast("string"))), F.transform(slices(answer, size), lambda x: one("token", x)), F.array(one("final", answer)))


def wants_visuals(query: Column) -> Column:
    low = F.lower(query)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in C.VISUAL_WORDS])


def valid_query(query: Column, allow_empty: bool = False) -> Column:
    """struct<query, reason>: the stripped query, and why it is refused (null if it isn't)."""
    t = strip(F.coalesce(query, F.lit("")))
    empty = F.lit(False) if allow_empty else t == ""
    reason = F.when(empty, "empty").when(F.length(t) > C.MOST_QUERY_CHARS, "too_long").when(t.rlike("[\\x{0400}-\\x{04FF}]"), "language")
    return F.struct(t.alias("query"), reason.alias("reason"))


def cited(answer: Column) -> Column:
    """Distinct source labels such as S1 that an answer cites in brackets."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit("\\[(S\\d+)\\]"), F.lit(1)))


def citations_hold(answer: Column, allowed: Column) -> Column:
    """At least one citation, and none outside the allowed labels."""
    c = cited(answer)
    return (F.size(allowed) > 0) & (F.size(c) > 0) & (F.size(F.array_except(c, allowed)) == 0)


TABLE_MARK = "data-brindle-table"
TABLE_STYLE = f"<style {TABLE_MARK}>table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:4px 8px}}</style>"


def wrap_table(html: Column, style: str = TABLE_STYLE, mark: str = TABLE_MARK) -> Column:
    """A table page with the style put in: before </head>, else after <body ...>, else in front of a page, else around a fragment."""
    low = F.lower(html)
    head = F.instr(low, "</head>")
    body = F.instr(low, "<body")
    close = F.position(F.lit(">"), low, F.greatest(F.lit(1), body))
    s = F.lit(style)

    def cut(at: Column) -> Column:
        return F.concat(F.substring(html, F.lit(1), at), s, F.substring(html, at + 1, F.length(html)))

    return (
        F.when(F.coalesce(html, F.lit("")) == "", html)
        .when(html.contains(mark), html)
        .when(head > 0, cut(head - 1))
        .when((body > 0) & (close > 0), cut(close))
        .when(low.contains("<html"), F.concat(s, html))
        .otherwise(F.concat(F.lit("<!doctype html><html><head>"), s, F.lit("</head><body>"), html, F.lit("</body></html>")))
    )
