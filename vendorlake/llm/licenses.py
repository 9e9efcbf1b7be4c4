"""License scans by an exact set-similarity join, in DataFrame functions alone.

Text blocks are joined with license templates: all pairs in which a block holds at least part / whole of a template's
distinct words, and the word that tells it from its like. A template's blocks are the runs of as many words as it has,
from every word of the text on, so that line ends and comment marks between words don't matter. Words are put in one
global order, rarest in the corpus first, by counts over all documents. A block that reaches the threshold must hold one
of a template's first n - need + 1 words (prefix filter); of the places of template words in a text, need must lie
within a block's length from its first one on (length and positional filter: a block may as well begin at the first
template word it holds). What is left is verified by the exact overlap. Templates are few and fixed, so they travel as
literals, and a text meets them all in its own row; blocks are never paired with each other. The base scan finds fixed
phrases by consecutive words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices and the openings of public license texts, and the labels that they give.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-terms": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software licensed under the terms of the gnu lesser general public license",
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: The word that a block must hold for a template that others come close to.
TELLING = {
    "mit-notice": "mit", "apache-2.0": "apache", "gpl-3.0": "general", "lgpl": "lesser", "agpl-3.0": "affero", "cc-by-nc-4.0": "nc", "cc-by-sa-4.0": "sa", "mpl-2.0": "mozilla",
}
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Letters beyond ASCII whose lower case holds an ASCII letter.
_ODD = "\u212a\u0130"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, all: the text's words in lower case, a space between. lower() also changes letters beyond ASCII, but for two into others beyond ASCII; those two stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    odd = F.contains(text, F.lit(_ODD[0])) | F.contains(text, F.lit(_ODD[1]))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
    return docs.select(F.col(id_col).alias("id"), F.trim(F.regexp_replace(low, _BETWEEN, " ")).alias("all"))


def _count(text, what: str):
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / F.lit(len(what))).cast("long")


def _base(d: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word and base (labels) of every row."""
    n_words = F.when(F.col("all") == "", 0).otherwise(_count(F.col("all"), " ") + 1).cast("long")
    # Two spaces between words and one at either end, so that phrases side by side share none.
    wide = F.concat(F.lit(" "), F.replace("all", F.lit(" "), F.lit("  ")), F.lit(" "))
    d = d.withColumn("n_words", n_words)
    any_of = reduce(lambda a, b: a | b, [F.contains("all", F.lit(p)) for p in PHRASES])
    d = d.withColumn("wide", F.when(any_of, wide).otherwise(F.lit("")))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        key = " " + phrase.replace(" ", "  ") + " "
        spaces = lambda s: _count(s, " ") / 2
        held = F.contains("wide", F.lit(key))
        firsts.append(F.when(held, spaces(F.substring_index("wide", key, 1))))
        lasts.append(F.when(held, F.col("n_words") - len(phrase.split()) - spaces(F.substring_index("wide", key, -1))))
        counts.append(_count(F.col("wide"), key))
        labels.append(F.when(held, F.lit(label)))
    return d.select(
        "id", "all", "n_words", reduce(lambda a, b: a + b, counts).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    )


def template_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The templates' words, rarest in docs first (equal ones alphabetically); at most as many rows as the templates have words reach the driver."""
    vocabulary = sorted({w for t in TEMPLATES.values() for w in t.split()})
    words = _texts(docs, id_col, text_col).select(F.explode(F.split("all", " ")).alias("w")).where(F.col("w").isin(vocabulary))
    times = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (times.get(w, 0), w))


def _met(words: str, label: str, order: list[str], part: int, whole: int):
    """The greatest share of a template's distinct words in a block of the text; null below the threshold."""
    rank = {w: i for i, w in enumerate(order)}
    text = TEMPLATES[label].split()
    own = sorted(set(text), key=rank.__getitem__)
    need = -(-part * len(own) // whole)
    array = lambda xs: F.array(*map(F.lit, xs))
    telling = array([TELLING[label]] if label in TELLING else [])
    rare = array(own[: len(own) - need + 1])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(array(own), F.get(words, i)))
    block = lambda i: F.slice(words, i + 1, F.lit(len(text)))
    holds = lambda i: F.arrays_overlap(block(i), rare) & (F.arrays_overlap(block(i), telling) if label in TELLING else F.lit(True))

    def dense(p):
        last = F.slice(p, need, F.greatest(F.size(p) - need + 1, F.lit(0)))
        return F.filter(F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - need + 1, F.lit(0))), last, lambda a, b: F.when(b - a < len(text), a)), lambda a: a.isNotNull())

    begins = F.aggregate(F.array(places), F.array().cast("array<int>"), lambda _, p: dense(p))  # names the places once
    shares = F.transform(F.filter(begins, holds), lambda i: F.size(F.array_intersect(array(own), block(i))))
    best = F.array_max(shares)
    may = (F.size(F.array_intersect(array(own), words)) >= need) & (F.array_contains(words, TELLING[label]) if label in TELLING else F.lit(True))
    return F.when(may, F.when(best >= need, best / F.lit(len(own))))


def with_templates(d: DataFrame, order: list[str], part: int = 80, whole: int = 100) -> DataFrame:
    """d (with all) with column met: (label, share) of each template that a block of the text meets."""
    rank = {w: i for i, w in enumerate(order)}
    prefixes = set()
    for text in TEMPLATES.values():
        own = sorted(set(text.split()), key=rank.__getitem__)
        prefixes |= set(own[: len(own) + 1 - (-(-part * len(own) // whole))])
    d = d.withColumn("words", F.split("all", " "))
    d = d.withColumn("words", F.when(F.arrays_overlap("words", F.array(*map(F.lit, sorted(prefixes)))), F.col("words")))
    each = [F.struct(F.lit(label).alias("label"), _met("words", label, order, part, whole).alias("share")) for label in TEMPLATES]
    met = F.when(F.col("words").isNotNull(), F.filter(F.array(*each), lambda m: m["share"].isNotNull()))
    return d.withColumn("met", F.coalesce(met, F.array().cast("array<struct<label:string,share:double>>"))).drop("words")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words (long), n_base (long, places of all phrases), first_word, last_word (long:
    the smallest and the largest start, in words from 0; else null), base_labels, labels (strings: distinct, sorted,
    comma-joined; labels adds the templates'), score (double: 1 with a base phrase, else the greatest share of a template
    met, else 0), n_templates (long: templates met).

    Words: A-Z lower-cased runs of ASCII letters and digits and of anything beyond ASCII. A null or empty text has no word,
    empty labels and score 0. A row's result depends on its own text and the order of template words alone, so null ids
    and rows that share an id are as good as others, and repeated rows come out as often as they came in. Other columns
    are ignored, whatever their names.
    """
    d = with_templates(_base(_texts(docs, id_col, text_col)), template_order(docs, id_col, text_col))
    return d.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("met", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("met", lambda m: m["share"])), F.lit(0.0))).alias("score"),
        F.size("met").cast("long").alias("n_templates"),
    )
