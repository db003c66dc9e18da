"""License scan: phrase places, and an exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows over the words of the whole text, whatever its
line ends: a template of up to 2^k words is sought in windows of 2^(k+1) words,
one of which holds any run of 2^k.  Blocks and templates are sets of words.  The
templates' words are ordered by how often documents hold them, the rarest
first.  A block that contains at least the threshold's share of a template
must hold a word of the template's prefix (its rarest words, as many as may be
missing plus one), must be large enough, and its words must stand early enough
in both orders; what passes is counted exactly.  A template's deciding word
must be there.  Every template that a block meets gives its label, but one whose
words there all belong to a longer template that the block meets as well.
DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import named, written

# The phrases every scan looks for, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wording of usual license notices, and their labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-text": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-text": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# The word of a short or shared wording without which it is another license.
DECIDING = {
    "apache-2.0": "apache", "apache-2.0-text": "apache", "cc-by-nc": "nc", "cc-by-nc-text": "noncommercial", "cc-by-sa": "sharealike", "gpl-notice": "gnu",
    "gpl-text": "program", "lgpl-text": "lesser", "mit": "mit", "mpl-2.0": "mozilla", "unlicense": "unencumbered",
}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with only A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def _loose_words(text: Column) -> Column:
    """As many words as :func:`words_of` has, in fast lower case: every ASCII word of it is among them."""
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def _places(words: Column, phrase: list[str]) -> Column:
    last = F.size(words) - len(phrase)
    hit = lambda i: _all([F.element_at(words, i + 1 + k) == w for k, w in enumerate(phrase)])
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), hit)).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def width_of(template: str) -> int:
    """The power of two that holds a template's words; it is sought in windows twice as wide."""
    return 1 << max(0, len(template.split()) - 1).bit_length()


def scan(
    df: DataFrame, *, text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
    deciding: dict[str, str] | None = None, threshold: float = 0.8,
) -> DataFrame:
    """The columns of ``df`` but the text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``n_base`` counts all places where a phrase's words stand consecutively,
    first_word and last_word are the smallest and largest of their starts
    (null if none).  A template's label is added where a block contains at
    least ``threshold`` of its different words, its deciding word among them,
    unless these words are all words of a longer template of its width that the
    block meets, too (of equally long ones the one with the larger share, then
    the first label, counts as longer).  ``score`` is 1 where a phrase stands, else the largest
    containment that met the threshold, else 0.
    Null texts count as empty: no words, no labels.  Rows are judged each on
    its own, so repeated rows and null ids stay; columns of the added names are
    replaced, all others pass unchanged.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    deciding = DECIDING if deciding is None else deciding
    spark = df.sparkSession
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [c for c in df.columns if c not in {*added, text}]
    body = F.coalesce(named(text), F.lit(""))

    # How many documents hold each template word: at most as many rows as the templates have words.
    sets = {label: sorted(set(t.split())) for label, t in templates.items()}
    vocabulary = sorted({w for t in sets.values() for w in t})
    held = df.select(F.explode(F.array_intersect(_loose_words(body), F.lit(vocabulary))).alias("w"))
    often = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    prefixes = []
    for label, t in sets.items():
        t.sort(key=order.__getitem__)
        least = max(1, math.ceil(threshold * len(t) - 1e-9))
        prefixes += [(label, width_of(templates[label]), w, i, len(t), least, t, deciding.get(label)) for i, w in enumerate(t[: len(t) - least + 1])]
    index = spark.createDataFrame(prefixes, "label string, width int, w string, i int, size int, least int, words array<string>, need string")
    rare = sorted({p[2] for p in prefixes})

    # One pass over the texts: counts, phrase places, and the blocks that hold a prefix word.
    loose = _loose_words(body)
    # The kept columns travel as one, so that their names clash with none of these.
    kept = F.struct(*map(named, keep)) if keep else F.struct(F.lit(0).alias("none"))
    first = df.select(kept.alias("_row"), body.alias("_text"), loose.alias("_loose")).withColumns(
        {
            "_words": F.size("_loose").cast("long"),
            "_may": F.arrays_overlap("_loose", F.lit(sorted({p.split()[0] for p in phrases}))),
            "_rare": F.arrays_overlap("_loose", F.lit(rare)),
        }
    )
    exact = words_of(F.col("_text"))
    labelled = [_labelled(_places(F.col("_exact"), p.split()), label) for p, label in phrases.items()]
    blocks_of = lambda width: F.filter(
        F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size("_all") - width - 1) / width).cast("int")),
            lambda k: F.struct(F.lit(width).alias("width"), F.array_sort(F.array_intersect(F.array_distinct(F.slice("_all", k * width + 1, 2 * width)), F.lit(vocabulary))).alias("words")),
        ),
        lambda x: F.arrays_overlap(x["words"], F.lit(rare)),
    )
    lines = F.array_distinct(F.concat(*[blocks_of(w) for w in sorted({width_of(t) for t in templates.values()})]))
    row = written(
        first.withColumn("_all", F.when(F.col("_rare"), exact))
        .withColumn("_exact", F.when(F.col("_may"), exact))
        .withColumn("_found", F.when(F.col("_may"), F.sort_array(F.concat(*labelled))))
        .withColumn("_lines", F.when(F.col("_rare"), lines))
        .withColumn("_key", F.when(F.col("_rare"), F.struct(F.xxhash64("_text").alias("a"), F.md5("_text").alias("b"))))
        .drop("_text", "_loose", "_exact", "_all", "_may", "_rare")
    )

    # The join, over different blocks' word sets only.
    place = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    blocks = (
        row.filter(F.size("_lines") > 0)
        .select(F.explode("_lines").alias("block"))
        .distinct()
        .withColumn("ranked", F.array_sort(F.transform("block.words", lambda w: F.element_at(place, w))))
        .withColumn("n", F.size("block.words"))
    )
    names = F.lit(sorted(vocabulary, key=order.__getitem__))
    candidates = (
        blocks.select("block", "n", F.posexplode("ranked").alias("j", "r"))
        .withColumn("w", F.element_at(names, F.col("r") + 1))
        .join(F.broadcast(index), "w")  # as large as the templates' prefixes
        .filter(F.col("block.width") == F.col("width"))
        .filter((F.col("n") >= F.col("least")) & (F.col("j") <= F.col("n") - F.col("least")))
        .filter(F.col("need").isNull() | F.array_contains("block.words", F.col("need")))
        .groupBy("block", "n", "label", "size", "least", "words")
        .agg(F.min("i").alias("i"), F.min("j").alias("j"))
        .filter(1 + F.least(F.col("size") - F.col("i") - 1, F.col("n") - F.col("j") - 1) >= F.col("least"))
        .withColumn("met", F.array_intersect("block.words", "words"))
        .filter(F.size("met") >= F.col("least"))
        .select("block", F.struct("label", "size", (F.size("met") / F.col("size")).alias("part"), "met", "words").alias("x"))
    )
    longer = lambda x, y: (y["size"] > x["size"]) | ((y["size"] == x["size"]) & ((y["part"] > x["part"]) | ((y["part"] == x["part"]) & (y["label"] < x["label"]))))
    held = lambda x: F.exists("found", lambda y: longer(x, y) & (F.size(F.array_except(x["met"], y["words"])) == 0))
    # A block meets as many templates as there are, at most.
    per_block = candidates.groupBy("block").agg(F.collect_list("x").alias("found"))
    per_block = per_block.select("block", F.transform(F.filter("found", lambda x: ~held(x)), lambda x: x["label"]).alias("labels"), F.array_max(F.transform("found", lambda x: x["part"])).alias("part"))
    per_text = (
        row.filter(F.size("_lines") > 0)
        .select("_key", F.explode(F.array_distinct("_lines")).alias("block"))
        .join(per_block, "block")
        .groupBy("_key")
        .agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("_labels"), F.max("part").alias("_part"))
    )
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["label"]))), none)
    n_base = F.coalesce(F.size("_found"), F.lit(0))
    n_base = F.when(F.col("_found").isNull(), F.lit(0)).otherwise(n_base).cast("long")
    # Texts without a prefix word have no key: they stay out of the join, where they would be one hot key.
    plain = row.filter(F.col("_key").isNull()).withColumns({"_labels": F.lit(None).cast("array<string>"), "_part": F.lit(None).cast("double")})
    return (
        row.filter(F.col("_key").isNotNull())
        .join(per_text, "_key", "left")
        .unionByName(plain)
        .withColumns(
            {
                "n_words": F.col("_words"),
                "n_base": n_base,
                "first_word": F.array_min(F.transform("_found", lambda x: x["at"])),
                "last_word": F.array_max(F.transform("_found", lambda x: x["at"])),
                "base_labels": F.array_join(base, ","),
                "labels": F.array_join(F.array_sort(F.array_union(base, F.coalesce("_labels", none))), ","),
                "score": F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_part", F.lit(0.0))),
            }
        )
        .select(*[F.col("_row").getField(c).alias(c) for c in keep], *added)
    )
