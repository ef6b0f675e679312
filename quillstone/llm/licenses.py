"""License scans as an exact set-similarity join (operator 9), in DataFrame functions only.

Text blocks are windows of consecutive words over whole texts, line breaks or not, as long as a template may be
with ``1 - CONTAINMENT`` of other words in between; templates are a small fixed list of sentences and headers.  A
block matches every template of whose distinct words it holds at least ``CONTAINMENT``.  Words are put in the
order of their document frequency in the corpus, rarest first.  A template of m words of which t are needed has
its first m - t + 1 words as prefix: any matching block holds one of them (prefix filter; windows are looked at
around these words alone), has t distinct words (length filter), and t words of the template from the first common
one on (positional filter).  What passes is verified on the whole sets of all its windows, so nothing is lost.

Beside this, three base phrases are located by word.

Defined cases: null and empty texts have no words, no places and no labels; very long texts and lines are scanned
whole.  Rows with the same id and text share their (equal) result; rows with a null id are scanned too; an empty
table gives an empty table.  Of docs only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

CONTAINMENT = 0.8

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Template label and text.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("reserved", "all rights reserved no part may be reproduced without permission"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order, A-Z lower-cased; the Kelvin sign alone would turn into an ASCII letter, so it is set aside."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ſ")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def literal_words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def vocabulary_of(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def word_order(held: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first, from each text's own of them; as many rows reach the driver as the templates have words."""
    words = held.select(F.explode("held").alias("word"))
    counts = {r.word: r.n for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def may_hold(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text: a quick test that words_of then confirms."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    return text.rlike(rf"(?:\A|{gap})(?i:{'|'.join(words)})(?:\z|{gap})")


def width_of(template: str, containment: float = CONTAINMENT) -> int:
    """Words of a template's window."""
    return math.ceil(len(template.split()) / containment)


def template_matches(docs: DataFrame, *, key: list[str], order: list[str], text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """key columns, template number, label and containment of the best windows of every template that a text's windows match."""
    spark = docs.sparkSession
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for number, (label, text) in enumerate(templates):
        ordered = sorted(set(text.split()), key=place.__getitem__)
        need = math.ceil(containment * len(ordered) - 1e-9)
        rows += [(word, number, label, ordered, at, need, width_of(text, containment)) for at, word in enumerate(ordered[: len(ordered) - need + 1])]
    index = spark.createDataFrame(rows, "word string, template int, label string, template_words array<string>, at int, need int, width int")
    widest = max((r[-1] for r in rows), default=1)
    prefixes = sorted({r[0] for r in rows})
    held = docs.select(*key, F.col(text_col).alias("_text")).where(may_hold(F.col("_text"), prefixes)).select(*key, words_of(F.col("_text")).alias("words"))
    # Only the words around each prefix word leave a text, never the text once for each of them.
    marked = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda m: F.array_contains(literal_words(prefixes), m["word"]))
    before = lambda m: F.least(m["i"], F.lit(widest - 1))
    around = F.transform(marked, lambda m: F.struct(m["word"].alias("word"), before(m).alias("before"), F.slice(F.col("words"), m["i"] - before(m) + 1, before(m) + widest).alias("near")))
    # The index has as many rows as the templates have prefix words.
    probes = held.select(*key, F.inline(F.array_distinct(around))).join(F.broadcast(index), "word")
    ahead = F.least(F.col("before"), F.col("width") - 1)
    probes = probes.withColumn("near", F.slice("near", F.col("before") - ahead + 1, ahead + F.col("width")))
    rest = F.slice("template_words", F.col("at") + 1, F.size("template_words") - F.col("at"))
    probes = probes.where((F.size("near") >= F.col("need")) & (F.size(F.array_intersect(rest, "near")) >= F.col("need")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("width") + 1, F.lit(1)))
    most = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.col("template_words"), F.slice(F.col("near"), k, F.col("width"))))))
    verified = probes.withColumn("most", most).where(F.col("most") >= F.col("need"))
    return verified.groupBy(*key, "template", "label").agg(F.max(F.col("most") / F.size("template_words")).alias("containment"))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """array<struct<label, start>> of the places where the words of a phrase stand consecutively."""

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def here(i: Column) -> Column:
            test = F.get(words, i) == parts[0]
            for k, w in enumerate(parts[1:], 1):
                test = test & (F.get(words, i + k) == w)
            return F.coalesce(test, F.lit(False))

        found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        held = F.array_contains(words, parts[0])
        for w in parts[1:]:
            held = held & F.array_contains(words, w)
        starts = F.when(held, found).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    return F.concat(*[places(p, v) for p, v in phrases.items()])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """id, n_words, places (label and start of each base phrase), matched (labels of all templates that its blocks match) and score.

    The score is 1 where a base phrase stands, else the largest containment among the matching blocks, else 0.
    """
    keyed = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(id_col, text_col).alias("_row"))
    vocabulary = vocabulary_of(TEMPLATES)
    worded = keyed.withColumn("_words", words_of(F.col(text_col)))
    # The one pass that cuts whole texts into words.
    base = materialize(worded.select(id_col, "_row", F.size("_words").cast("long").alias("n_words"), phrase_places(F.col("_words"), phrases).alias("places"), F.array_intersect("_words", literal_words(vocabulary)).alias("held")))
    blocks = template_matches(keyed, key=[id_col, "_row"], order=word_order(base, vocabulary), text_col=text_col)
    matched = blocks.groupBy(id_col, "_row").agg(F.collect_set("label").alias("matched"), F.max("containment").alias("containment")).select(F.col(id_col).alias("_id"), F.col("_row").alias("_other"), "matched", "containment")
    joined = base.join(matched, (F.col("_row") == F.col("_other")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return joined.select(
        id_col, "n_words", "places", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op9_licenses(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's places and labels."""
    found = scan(docs)
    starts = F.transform("places", lambda p: p["start"])
    labels = F.transform("places", lambda p: p["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.col("matched"))).alias("labels"), "score",
    )
