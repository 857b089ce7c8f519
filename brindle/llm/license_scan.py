"""License scans (operator 3): an exact set-similarity join of text blocks with license templates, beside a phrase search.

A text block is any run of consecutive words, across sentences and line ends, of at most SPAN times as many words as the template has. A
block matches a template if it has at least THRESHOLD of the template's distinct words. Tokens are ordered by their frequency in the whole
corpus, rarest first. The words of a text are dealt to overlapping runs, so long that every block lies within one of them. A run can only
hold the overlap a = ceil(THRESHOLD * |T|) if it
- has at least a of the words that occur in any template (length filter; other words can't add to an overlap and are left out),
- shares a word among the first |T| - a + 1 of the template with its own first |B| - a + 1 (prefix filter), and
- has enough words left after the first shared one, as has the template (positional filter).
What passes is verified block by block. A text gets the labels of all templates that a block of it matches, but for a template that is
covered in all its blocks: another one matches there too, with all of its words and more, or with the same words and a larger share (CC
BY within CC BY-NC). All of it is DataFrame work; the templates are a fixed list, so their side of the join has a known size.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import cut

THRESHOLD = 0.8
#: Words that a block may have for each word of the template.
SPAN = 2
#: Words of a text after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are reported, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and wording of the notices that are looked for.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("agpl-3.0", "GNU Affero General Public License as published by the Free Software Foundation, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: F.Column) -> F.Column:
    """Words of a text that is in lower case. (lower() leaves what A-Z alone would give but for letters beyond ASCII, which are word characters before and after.)"""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _templates(templates) -> list[tuple[str, list[str], int]]:
    """Label, distinct words, and the most words of a block."""
    split = [(label, re.findall(WORD, text.lower())) for label, text in templates]
    return [(label, sorted(set(words)), SPAN * len(words)) for label, words in split]


def token_order(docs: DataFrame, tokens: list[str], text_col: str = "text") -> list[str]:
    """The tokens, rarest in the corpus first, ties by name: counted over all documents that have them. As many rows as templates have words."""
    found = F.array_distinct(F.filter(words_of(F.lower(F.col(text_col))), lambda w: w.isin(*tokens)))
    counted = docs.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    n = {r.token: r.n for r in counted}
    return sorted(tokens, key=lambda t: (n.get(t, 0), t))


def runs_of(words: F.Column, longest: int) -> F.Column:
    """Runs of 2 * longest words that begin at every longest-th word: each block of at most that many words lies within one."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / longest).cast("int") - 2, F.lit(0)))
    return F.transform(starts, lambda k: F.slice(words, k * longest + 1, F.lit(2 * longest)))


def matches(runs: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, label, containment) of the templates that a block of a run (row, run, words) matches and none covers."""
    spark, place = runs.sparkSession, {t: i for i, t in enumerate(order)}
    ordered = [(label, sorted(tokens, key=place.get), most) for label, tokens, most in _templates(templates)]
    need = [math.ceil(threshold * len(t) - 1e-9) for _, t, _ in ordered]
    entries = [F.struct(F.lit(t).alias("token"), F.lit(k).alias("template"), F.lit(i).alias("i")) for k, (_, tokens, _) in enumerate(ordered) for i, t in enumerate(tokens[: len(tokens) - need[k] + 1])]
    index = spark.range(1).select(F.inline(F.array(*entries)))
    whole = [F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, t)).alias("tokens"), F.lit(need[k]).alias("need"), F.lit(most).alias("most")) for k, (label, t, most) in enumerate(ordered)]
    whole = spark.range(1).select(F.inline(F.array(*whole)))
    own = runs.select("row", "run", F.array_intersect(F.array(*map(F.lit, order)), "words").alias("own")).filter(F.size("own") >= min(need))
    prefix = own.select("row", "run", "own", F.posexplode(F.slice("own", F.lit(1), F.size("own") - min(need) + 1)).alias("j", "token"))
    met = prefix.join(F.broadcast(index), "token").groupBy("row", "run", "template").agg(F.min(F.struct("j", "i", "own")).alias("at"))
    met = met.join(F.broadcast(whole), "template")
    reach = 1 + F.least(F.size("tokens") - F.col("at.i") - 1, F.size("at.own") - F.col("at.j") - 1)
    held = met.filter(reach >= F.col("need")).filter(F.size(F.array_intersect("at.own", "tokens")) >= F.col("need"))
    # At most as many templates as there are meet in one row.
    held = held.groupBy("row", "run").agg(F.collect_list(F.struct("label", "tokens", "need", "most")).alias("held"))
    checked = held.join(runs, ["row", "run"]).select("row", "held", "words", F.explode("held").alias("own"))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("own.tokens", F.get("words", i)))

    def block(i):
        found = F.slice("words", i + 1, F.col("own.most"))
        mine = F.array_intersect("own.tokens", found)

        def covers(other):
            theirs = F.array_intersect(other["tokens"], found)
            more = F.size(theirs) > F.size(mine)
            return (F.size(theirs) >= other["need"]) & (F.size(F.array_except(mine, theirs)) == 0) & (more | (F.size(other["tokens"]) < F.size("own.tokens")))

        covered = F.exists("held", covers)
        return F.when((F.size(mine) >= F.col("own.need")) & ~covered, F.size(mine) / F.size("own.tokens"))

    best = F.array_max(F.transform(starts, block))
    return checked.select("row", "own.label", best.alias("containment")).filter("containment is not null")


def _places(words: F.Column, phrase: str) -> F.Column:
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i):
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == part)
        return found

    return F.when(F.size(words) >= len(parts), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _labelled(starts: F.Column, label: str) -> F.Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of PHRASES, first_word and last_word are their smallest and largest start (null without any); labels are
    distinct, sorted and joined by commas ('' without any). score is the best containment of a template that is matched, 1 for a phrase,
    else 0. A null text is empty, a very long one is taken whole. Rows are taken one by one, so repeated rows give repeated results.
    Other columns play no part. Empty input gives no rows.
    """
    split = _templates(templates)
    tokens = sorted({t for _, own, _ in split for t in own})
    order = token_order(docs, tokens, text_col)
    place = {t: i for i, t in enumerate(order)}
    rare = sorted({t for _, own, _ in split for t in sorted(own, key=place.get)[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]})
    hint = "|".join(map(re.escape, rare))

    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"), F.monotonically_increasing_id().alias("row"))
    # Runs that hold a rare word of a template; the others can't pass the prefix filter.
    held = F.filter(runs_of(F.col("words"), max(most for *_, most in split)), lambda r: F.arrays_overlap(r, F.array(*map(F.lit, rare))))
    spoken = F.col("body").contains("reserved") | F.col("body").contains("general") | F.col("body").contains("cc")
    places = F.flatten(F.array(*[_labelled(_places(F.col("words"), phrase), label) for phrase, label in PHRASES]))
    found = base.withColumn("words", words_of(F.col("body")))
    slim = found.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(spoken, places).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("places"),
        F.when(F.col("body").rlike(hint), held).otherwise(F.array().cast("array<array<string>>")).alias("runs"),
    )
    slim = cut(slim)

    candidates = slim.filter(F.size("runs") > 0).select("row", F.posexplode("runs").alias("run", "words"))
    by_row = matches(candidates, order, templates, threshold).groupBy("row").agg(F.max("containment").alias("best"), F.collect_set("label").alias("more"))
    n = F.size("places")
    starts = F.transform("places", lambda x: x["at"])
    own = F.array_distinct(F.transform("places", lambda x: x["label"]))
    both = F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    out = slim.drop("runs").join(by_row, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(both).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
