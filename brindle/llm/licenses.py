"""License scan by exact set-similarity join, in DataFrame functions alone.

A block is a run of adjacent words of a text, however they are wrapped; comment leaders are no words.
Of a template of n words, repeats counted, a block has at most n / THRESHOLD of them, so words that
are scattered through a long line or text make no notice. Every block that contains at least
THRESHOLD of a template's distinct words is found, at each of its words that begins one.

Words are ordered by the number of documents that hold them, rarest first, over the whole table. A
block that has need = ceil(THRESHOLD * |template|) words of a template must hold one of the template's
first |template| - need + 1 words (prefix filter). Each place of such a word in a text is joined with
the templates that it leads; the words around it must hold need of the template's (length filter).
Only blocks of which this is the first prefix word are looked at there, so each is met once; from the
previous prefix word's place on, enough of the template's words must be left (positional filter). What
remains is counted exactly.

labels lists each template that is met. specific leaves one out where its words are all among another's
(the general notice of a family and its variants) and a block of the other covers it and is met at
least as fully.

Beside the join, phrases stand where their words follow one another, whatever lies between words.

Cases: null and empty texts have no words; rows that repeat a doc_id are scanned each by itself, and
share the labels that the join finds for that doc_id; rows with a null doc_id likewise; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import let, stored

THRESHOLD = 0.9
#: Words of a text that one row holds, beside those within reach; changes no result.
SLICE = 1024
#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices as their licenses word them, and the labels that a block containing them gets.
TEMPLATES = (
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("gpl-notice", "licensed under the GNU General Public License, version 3"),
    ("mit-notice", "Released under the MIT License"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("creative-commons", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-terms", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-disclaimer", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "mit-body",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "bsd-body",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    ("no-reuse", "All rights reserved. No part of this publication may be reproduced"),
)
#: Characters outside words, before lower-casing.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: str) -> list[str]:
    """Lower-case words, in order."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def tokens(text: str) -> list[str]:
    """Distinct lower-case words in order of appearance."""
    return list(dict.fromkeys(words_of(text)))


def width_of(text: str, threshold: float = THRESHOLD) -> int:
    """Words of a template's longest block."""
    return math.floor(len(words_of(text)) / threshold + 1e-9)


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Of each word of a fixed vocabulary, the documents that hold it (all of them are counted)."""
    held = F.array_intersect(F.split(F.lower(docs["text"]), GAP), F.lit(vocabulary))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # a row per vocabulary word at most
    found = {r["word"]: r["n"] for r in rows}
    return {w: found.get(w, 0) for w in vocabulary}


def prefixes(frequency: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Per template: its words in global order, how many a block needs, the longest block, the prefix, and the templates that have all its words and more."""
    order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    out = []
    for label, text in templates:
        words = sorted(tokens(text), key=order.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        out.append({"label": label, "words": words, "need": need, "width": width_of(text, threshold), "prefix": words[: len(words) - need + 1]})
    for p in out:
        # one whose blocks are shorter can't cover this one's
        p["wider"] = [(o["words"], o["need"], o["width"]) for o in out if set(p["words"]) < set(o["words"]) and o["width"] >= p["width"]]
        p["reach"] = max([p["width"], *(w for _, _, w in p["wider"])])
    return out


INDEX = "word string, label string, template array<string>, prefix array<string>, need int, width int, reach int, wider array<struct<template:array<string>,need:int,width:int>>"


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per place and template where a block begins that meets the threshold: doc_id, label, at (its first word's place), containment, specific."""
    vocabulary = sorted({w for _, t in templates for w in tokens(t)})
    plans = prefixes(word_frequencies(docs, vocabulary), templates, threshold)
    leads = sorted({w for p in plans for w in p["prefix"]})
    low = docs.select(docs["doc_id"].alias("doc_id"), F.lower(docs["text"]).alias("low"))
    # a text without any prefix word has no matching block
    edge = GAP[:-1]
    some = low.where(F.col("low").rlike(f"(?:^|{edge})(?:{'|'.join(map(re.escape, leads))})(?:$|{edge})"))
    # the inverted index over the templates' prefixes: its size is fixed by the templates
    index = docs.sparkSession.createDataFrame([(w, p["label"], p["words"], p["prefix"], p["need"], p["width"], p["reach"], p["wider"]) for p in plans for w in p["prefix"]], INDEX)
    reach = max(p["reach"] for p in plans)

    def parts(words: Column) -> Column:
        # SLICE words and what lies within reach of them, so that a very long text never stands in many rows
        def part(k: Column) -> Column:
            from_ = F.greatest(k - reach, F.lit(0))
            return F.struct(from_.alias("from_"), (k - from_).alias("own"), F.slice(words, from_ + 1, k - from_ + SLICE + reach).alias("words"))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(SLICE)), part)

    def places(c: Column) -> Column:
        def around(i: Column) -> Column:
            low_ = F.greatest(i - reach + 1, F.lit(0))
            return F.struct((c["from_"] + low_).alias("from_"), (i - low_).alias("centre"), F.get(c["words"], i).alias("probe"), F.slice(c["words"], low_ + 1, i - low_ + reach).alias("around"))

        own = F.sequence(c["own"], F.least(c["own"] + SLICE, F.size(c["words"])) - 1)
        return F.transform(F.filter(own, lambda i: F.get(c["words"], i).isin(leads)), around)

    # outer, lest a filter on the arrays' sizes make them a second time; the join drops what is null
    sliced = some.select("doc_id", F.explode_outer(let(F.array_remove(F.split("low", GAP), ""), parts)).alias("c"))
    probe = sliced.select("doc_id", F.explode_outer(let(F.col("c"), places)).alias("p")).select("doc_id", "p.*")
    met = probe.join(F.broadcast(index), F.col("probe") == F.col("word"))
    skip = F.greatest(F.col("centre") - F.col("reach") + 1, F.lit(0))
    nearer = F.slice("around", skip + 1, F.col("centre") - skip + F.col("reach"))
    near = met.select("doc_id", "label", "template", "prefix", "need", "width", "wider", (F.col("from_") + skip).alias("from_"), (F.col("centre") - skip).alias("centre"), nearer.alias("around"))
    near = near.where(F.size(F.array_intersect("template", "around")) >= F.col("need"))
    # blocks that begin up to the previous prefix word's place have that one first
    lowest = F.greatest(F.col("centre") - F.col("width") + 1, F.lit(0))
    led = F.transform(F.slice("around", lowest + 1, F.col("centre") - lowest), lambda w, i: F.when(F.array_contains("prefix", w), i))
    near = near.withColumn("first", lowest + F.coalesce(F.array_max(led), F.lit(-1)) + 1)
    left = F.slice("around", F.col("first") + 1, F.col("centre") - F.col("first") + F.col("width"))
    near = near.where(F.size(F.array_intersect("template", left)) >= F.col("need"))

    def shared(template: Column, width: Column, at: Column) -> Column:
        return F.size(F.array_intersect(template, F.slice("around", at + 1, width)))

    starts = F.filter(F.sequence("first", "centre"), lambda j: F.array_contains("template", F.get("around", j)))
    counted = F.transform(starts, lambda j: F.struct(j.alias("j"), shared(F.col("template"), F.col("width"), j).alias("n")))
    blocks = near.withColumn("b", F.explode(F.filter(counted, lambda b: b["n"] >= F.col("need"))))

    def covers(o: Column, at: Column) -> Column:
        n = shared(o["template"], o["width"], at)
        return (n >= o["need"]) & (n * F.size("template") >= F.col("b.n") * F.size(o["template"]))

    covered = F.exists("wider", lambda o: F.exists(F.sequence(F.greatest(F.col("b.j") + F.col("width") - o["width"], F.lit(0)), F.col("b.j")), lambda k: covers(o, k)))
    return blocks.select("doc_id", "label", (F.col("from_") + F.col("b.j")).alias("at"), (F.col("b.n") / F.size("template")).alias("containment"), (~covered).alias("specific"))


def phrase_places(text: Column, phrases=PHRASES) -> Column:
    """Array of (start, label): the word places where a phrase's words follow one another."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), GAP, " ")), F.lit(" "))

    def starts(phrase: str, label: str) -> Column:
        # what lies before the k-th place, cut where the phrase begins; its spaces count the words
        pieces = F.split(flat, f"(?<= )(?={phrase} )", -1)
        gaps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))))
        run = F.aggregate(
            gaps,
            F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")),
        )["out"]
        return F.transform(run, lambda s: F.struct(s.alias("start"), F.lit(label).alias("label")))

    found = F.concat(*[starts(p, label) for p, label in phrases])
    return F.when(F.lower(text).contains("license"), found).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, specific for every document.

    score is the largest containment of a template in a block of the document, 1 where a phrase
    stands, else 0.
    """
    found = matches(docs, templates, threshold).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.collect_set(F.when(F.col("specific"), F.col("label"))).alias("narrow"), F.max("containment").alias("best"))
    found = stored(found.withColumnRenamed("doc_id", "match_id"), "license-matches")
    own = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    base = own.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), phrase_places(F.col("text")).alias("places"))
    joined = base.join(found, base["doc_id"].eqNullSafe(F.col("match_id")), "left")
    base_labels = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    n = F.size("places").cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.when(n > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("narrow", F.array().cast("array<string>")))), ",").alias("specific"),
    )
