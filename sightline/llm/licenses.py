"""License scans: phrases word for word, and an exact set-similarity join of text blocks with license templates.

A block meets a template when it contains at least CONTAINMENT of the template's different words. Words are ordered by how
many documents of the whole corpus hold them, rarest first. With a = ceil(CONTAINMENT * |template|) a qualifying pair shares
a word among the template's first |template| - a + 1 and the block's first |block| - a + 1 words, blocks of fewer than a
template words are out (length filter), and a first common word leaves at most the shorter rest to come (positional filter).
Survivors are verified by exact intersection. Everything is DataFrame functions; templates are a fixed, small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTAINMENT = 0.8

#: Phrases that stand for a label, word for word.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Labels and the license texts that stand for them, in their own words.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _size(template: str) -> int:
    """Words in a template's blocks are twice this power of two, at steps of it, so each stretch of that many words lies in one."""
    return 1 << (len(template.split()) - 1).bit_length()


def words(text: Column) -> Column:
    """Words after lower-casing A-Z. lower() may change other letters, which no word looked for has; only the Kelvin sign would turn ASCII."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(plain, _BREAK), "")


def _phrases(split: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (array of labels) to rows with the column words."""
    rare = F.array(*(F.lit(w) for w in ("mit", "apache", "nc")))
    # each word in spaces of its own, so that places beside each other don't share one
    joined = split.withColumn("joined", F.when(F.arrays_overlap("words", rare), F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise(F.lit("")))
    count, first, last, labels = F.lit(0).cast("long"), [], [], []
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2
    for phrase, label in PHRASES:
        parts = phrase.split()
        mark = " " + "  ".join(parts) + " "
        here = F.instr("joined", mark)
        n = ((F.length("joined") - F.length(F.replace("joined", F.lit(mark), F.lit("")))) / len(mark)).cast("long")
        count = count + n
        first.append(F.when(here > 0, spaces(F.substring(F.col("joined"), F.lit(1), here - 1)).cast("long")))
        last.append(F.when(here > 0, (F.size("words") - len(parts) - spaces(F.substring_index("joined", mark, -1))).cast("long")))
        labels.append(F.when(here > 0, F.lit(label)))
    return joined.select(
        *split.columns, F.size("words").cast("long").alias("n_words"), count.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_compact(F.array(*labels)).alias("base")
    )


def _vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def word_order(docs: DataFrame) -> list[str]:
    """The templates' words, rarest first by the number of documents that hold them; at most as many rows as templates have words."""
    held = docs.select(F.explode(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, _vocabulary())))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(_vocabulary(), key=lambda w: (counts.get(w, 0), w))


def matches(split: DataFrame, order: list[str], threshold: float = CONTAINMENT) -> DataFrame:
    """key, label, containment for every block of a row's words that meets a template. split: key, words."""
    spark = split.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    sets = [(i, label, _size(t), sorted({rank[w] for w in t.split()})) for i, (label, t) in enumerate(TEMPLATES)]
    need = lambda s: math.ceil(threshold * len(s) - 1e-9)
    prefixes = [(s[p], i, p, len(s), need(s), size) for i, _, size, s in sets for p in range(len(s) - need(s) + 1)]
    index = spark.createDataFrame(prefixes, "token int, template int, at_template int, n_template int, need int, size int")
    full = spark.createDataFrame([(i, label, s) for i, label, _, s in sets], "template int, label string, ranks array<int>")
    probe = sorted({p[0] for p in prefixes})
    rare = F.array(*(F.lit(order[r]) for r in probe))
    sizes = F.array(*(F.lit(s) for s in sorted({s for _, _, s, _ in sets})))
    ranks = F.create_map(*(x for w, r in rank.items() for x in (F.lit(w), F.lit(r))))
    # only texts with a prefix word of some template have a block that can match
    live = split.filter(F.arrays_overlap("words", rare)).select("key", "words", F.explode(sizes).alias("size"))
    blocks = live.select("key", "size", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.col("size")), lambda i: F.array_intersect(F.slice(F.col("words"), i + 1, F.col("size") * 2), F.array(*map(F.lit, order))))).alias("held"))
    ranked = blocks.filter(F.size("held") > 0).select("key", "size", F.sort_array(F.transform("held", lambda w: F.element_at(ranks, w))).alias("block")).distinct()
    tokens = ranked.select("key", "size", "block", F.posexplode("block").alias("at_block", "token"))
    n_block = F.size("block")
    rest = F.least(n_block - F.col("at_block"), F.col("n_template") - F.col("at_template"))
    fits = (n_block >= F.col("need")) & (F.col("at_block") <= n_block - F.col("need")) & (rest >= F.col("need"))
    # the first common word alone is tested against the rest; later ones have less to come and the first has met the bound
    candidates = tokens.join(F.broadcast(index), ["token", "size"]).filter(fits).select("key", "block", "template", "need").distinct()
    shared = F.size(F.array_intersect("block", "ranks"))
    return candidates.join(F.broadcast(full), "template").filter(shared >= F.col("need")).select("key", "label", (shared / F.size("ranks")).alias("containment"))


def scan(docs: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    n_base counts all places of all phrases. labels joins the phrases' labels with those of templates that a block meets;
    score is the largest containment of such a block, 1 where a phrase stands, else 0. Null and empty texts have no words
    and the labels ''. Rows are told apart by doc_id and text; equal rows get equal results, each its own.
    """
    order = word_order(docs)
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64("text").alias("h"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    split = docs.select(F.col("doc_id"), key.alias("key"), words(F.col("text")).alias("words"))
    found = matches(split.select("key", "words"), order, threshold).groupBy("key").agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
    base = _phrases(split).drop("words")
    both = base.join(found.withColumnRenamed("key", "found"), F.col("key") == F.col("found"), "left")
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    nothing = F.array().cast(T.ArrayType(T.StringType()))
    score = F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"), joined(F.array_union("base", F.coalesce("met", nothing))).alias("labels"), score.alias("score"))
