r"""License scan: an exact set-similarity join of text blocks with license templates.

Only DataFrame functions. Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after
lower-casing A-Z. A template's text blocks are all runs of its length / ``threshold`` words of
the whole text, across line ends, wherever they begin (the whole text if it is shorter), so
notices are found as one line, wrapped, or behind comment signs. A block matches if it holds at
least ``threshold`` of the template's distinct words (containment).

1. One pass over the texts finds the base phrases and which template words each document holds, and keys each text by its digest; no text is kept.
2. Template words are ordered by their document frequency in the whole corpus, rarest first. A block that matches has one of the first
   ``|T| - need + 1`` (prefix filter): the prefix words that a text holds meet the templates by an equi-join on the word. Of these pairs
   only do the held words and the template's meet in full; ``need`` must be in common (length filter). So the number of templates doesn't matter
   for texts that hold none of their rare words.
3. Texts that hold a prefix word are read again, each once however many rows have it, and those of the pairs that are left go on. The places of prefix words meet their templates by word.
   Blocks around a place are counted at the rarest template word they hold, so from that word on
   in the global order both the template and the words around the place must have
   ``need`` in common (positional filter).
4. What is left is counted in full, block by block.

*Base* labels are the stated phrases, wherever their words stand consecutively.

Null and empty texts have no words, no labels and score 0. Repeated rows, those of one
doc_id or of none are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties "
        "or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must "
        "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def word_text(text: Column) -> Column:
    """The words with a space before and after each; one space if there are none."""
    return F.regexp_replace(F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), UPPER, LOWER), NO_WORD, " ")


def words_of(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " ", -1), "")


def count_words(spaced: Column) -> Column:
    """The spaces between words and at both ends, less one."""
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) - 1).cast("long")


def template_sets(templates, threshold: float) -> list[dict]:
    out = []
    for number, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()))
        out.append({"number": number, "label": label, "tokens": tokens, "need": math.ceil(threshold * len(tokens) - 1e-9), "width": math.floor(len(text.split()) / threshold + 1e-9)})
    return out


def _places(phrase: str) -> Column:
    """Word numbers where the phrase starts."""
    words = phrase.split()
    n = len(words)
    starts = F.sequence(F.lit(0), F.size("words") - n)
    here = lambda i: sum((F.when(F.get("words", i + k) == w, 0).otherwise(1) for k, w in enumerate(words)), F.lit(0)) == 0
    return F.when(F.contains("spaced", F.lit(f" {phrase} ")), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def surveyed(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(key, doc_id, n_words, n_base, first_word, last_word, base, held): the phrases' places and labels, and the template
    words that stand in the text."""
    sets = template_sets(templates, threshold)
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in sets for w in t["tokens"]})]).cast("array<string>")
    found = docs.select("doc_id", text_key(F.col("text")).alias("key"), word_text(F.col("text")).alias("spaced"))
    found = found.select("key", "doc_id", "spaced", count_words(F.col("spaced")).alias("n_words"), words_of(F.col("spaced")).alias("words"))
    some = F.lit(False)
    for phrase in PHRASES:
        some |= F.contains("spaced", F.lit(f" {phrase} "))
    found = found.select("key", "doc_id", "n_words", "spaced", F.array_intersect(vocabulary, "words").alias("held"), F.when(some, F.col("words")).alias("words"))
    places = F.array(*[_places(p) for p in PHRASES])
    found = found.select("key", "doc_id", "n_words", places.alias("places"), "held")
    labels = F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())])
    flat = F.flatten("places")
    found = found.select(
        "key", "doc_id", "n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"),
        F.array_max(flat).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"), "held",
    )
    return written(found, "surveyed")


def prefix_words(survey: DataFrame, sets: list[dict]) -> tuple[DataFrame, Column]:
    """The templates by prefix word (word, template, label, size, tokens, rest, need, width), rest being the
    template's words from that one on, and all prefix words."""
    counts = survey.select(F.explode("held").alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counts.collect()}  # a row a template word
    rows, prefixes = [], set()
    for t in sets:
        order = sorted(t["tokens"], key=lambda w: (df.get(w, 0), w))
        for at, w in enumerate(order[: len(order) - t["need"] + 1]):
            prefixes.add(w)
            rows.append((w, t["number"], t["label"], len(order), order, order[at:], t["need"], t["width"]))
    known = survey.sparkSession.createDataFrame(rows, "word string, template int, label string, size int, tokens array<string>, rest array<string>, need int, width int")
    return known, F.array(*[F.lit(w) for w in sorted(prefixes)]).cast("array<string>")


def hopeful(survey: DataFrame, known: DataFrame, asked: Column) -> DataFrame:
    """(key, template) of the texts that hold a prefix word of a template and enough of its words."""
    held = survey.filter(F.arrays_overlap("held", asked)).groupBy("key").agg(F.any_value("held").alias("held"))
    pairs = held.select("key", "held", F.explode(F.array_intersect("held", asked)).alias("word")).join(known.select("word", "template", "tokens", "need"), "word")
    return pairs.filter(F.size(F.array_intersect("held", "tokens")) >= F.col("need")).select("key", "template").distinct()


def license_blocks(docs: DataFrame, survey: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(key, template, label, start, containment): around each place of a prefix word, the
    first of the best blocks that match. ``docs`` are the surveyed texts."""
    sets = template_sets(templates, threshold)
    known, asked = prefix_words(survey, sets)
    reach = max([t["width"] for t in sets], default=1)
    pairs = written(hopeful(survey, known, asked), "hopeful")
    of = pairs.groupBy("key").agg(F.collect_set("template").alias("templates"))  # as many as there are templates at most
    # texts without a prefix word are left where they are: only the others meet the keys
    near = docs.select(text_key(F.col("text")).alias("key"), words_of(word_text(F.col("text"))).alias("w")).filter(F.arrays_overlap("w", asked))
    words = near.select("key", F.array_join("w", " ").alias("w")).groupBy("key").agg(F.any_value("w").alias("w")).join(of, "key").select("key", "templates", F.split("w", " ", -1).alias("w"))
    places = words.select("key", "templates", "w", F.posexplode("w").alias("p", "word")).filter(F.array_contains(asked, F.col("word")))
    low = F.greatest(F.col("p") - reach + 1, F.lit(0))
    around = places.select("key", "templates", "word", low.alias("low"), (F.col("p") - low).alias("p"), F.slice("w", low + 1, F.col("p") - low + reach).alias("w"))
    met = around.join(known.drop("tokens"), "word").filter(F.array_contains("templates", F.col("template")))
    first = F.greatest(F.col("p") - F.col("width") + 1, F.lit(0))
    met = met.withColumn("near", F.slice("w", first + 1, F.col("p") - first + F.col("width"))).withColumn("first", F.col("low") + first)
    met = met.filter(F.size(F.array_intersect("rest", "near")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("width") + 1, F.lit(1)))
    # the most words, then the first block: starts are negative so that the greatest pair is that
    block = lambda i: F.struct(F.size(F.array_intersect("rest", F.slice("near", i, F.col("width")))).alias("shared"), (-i).alias("at"))
    met = met.withColumn("best", F.array_max(F.transform(starts, block))).filter(F.col("best.shared") >= F.col("need"))
    return met.select("key", "template", "label", (F.col("first") - F.col("best.at") - 1).alias("start"), (F.col("best.shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 with a base label, else the best containment of a match, else 0)."""
    survey = surveyed(docs.select("doc_id", "text"), templates, threshold)
    met = license_blocks(docs, survey, templates, threshold).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    rows = survey.drop("held").join(written(met, "met"), "key", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
