"""Captions from a model's JSON answer."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle import config as C

SCHEMA = "component_name string, visual_type string, part_numbers array<string>, connections array<string>, technical_description string"


def unfenced(answer: Column) -> Column:
    """Without a code fence, cut from the first brace on to the last one."""
    t = F.regexp_replace(F.trim(answer), "(?is)^```(?:json)?\\s*\\n?|\\n?\\s*```\\s*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(t, "(?s)(\\{.*\\})", 1), F.lit("")), F.trim(t))


def first_json(answer: Column) -> Column:
    """The first whole JSON object or array that stands in a text, as text; null where there is none. A decoder has to run from each opening bracket, so this is an Arrow function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        decode = json.JSONDecoder().raw_decode

        def one(t: str | None) -> str | None:
            for m in re.finditer(r"[\[{]", t or ""):
                try:
                    return t[m.start() : decode(t, m.start())[1]]
                except ValueError:
                    continue
            return None

        return s.map(one)

    return run(answer)


def parse_first(answer: Column) -> Column:
    """The caption struct of the first JSON object in an answer, whatever stands around it; where that is none, what parse finds."""
    return F.coalesce(F.from_json(first_json(answer), SCHEMA, {"mode": "PERMISSIVE"}), parse(answer))


def parse(answer: Column) -> Column:
    """The caption struct; a second try drops trailing commas and straightens quotes. Null if both fail."""
    s = unfenced(answer)
    mended = F.translate(F.regexp_replace(s, ",\\s*([}\\]])", "$1"), "“”’", "\"\"'")
    plain = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), F.from_json(x, SCHEMA))
    return F.coalesce(plain(s), plain(mended))


def useful(caption: Column) -> Column:
    """Not when the name is a placeholder and there are neither parts nor connections."""
    name = F.lower(F.trim(F.coalesce(caption["component_name"], F.lit(""))))
    placeholder = name.isin(*C.PLACEHOLDER_NAMES) | reduce(lambda a, b: a | b, [name.contains(p) for p in C.PLACEHOLDER_PARTS])
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    return caption.isNotNull() & ~(placeholder & none(caption["part_numbers"]) & none(caption["connections"]))


def rendered(caption: Column) -> Column:
    """One sentence per part that is there; keys that are missing get defaults."""
    listed = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), ", ")
    parts, conns = listed(caption["part_numbers"]), listed(caption["connections"])
    return F.concat(
        F.coalesce(caption["visual_type"], F.lit("Diagram")),
        F.lit(" for "),
        F.coalesce(caption["component_name"], F.lit("Unknown Component")),
        F.lit("."),
        F.when(parts != "", F.concat(F.lit(" Part Numbers: "), parts, F.lit("."))).otherwise(""),
        F.when(conns != "", F.concat(F.lit(" Connects to: "), conns, F.lit("."))).otherwise(""),
        F.when(caption["technical_description"].isNotNull(), F.concat(F.lit(" Details: "), caption["technical_description"])).otherwise(""),
    )
