"""Licence scans by diagonal voting.

All rolling word 3-gram hashes of the texts meet the positions of the same grams in
licence templates; matches vote for their offset diagonal, neighbouring diagonals are
merged, and the span that remains is verified by the template words it covers.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keyed

GRAM = 3
#: Offsets that a diagonal may drift by (words put in or left out) and still be the same span.
DRIFT = 3
#: Share of a template's words that a span must cover.
COVERAGE = 0.8

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that must stand word for word.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licences.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]


def template_grams(spark: SparkSession) -> DataFrame:
    """``(gram, template, label, exact, size, at)``: a few hundred rows, fixed by this module."""
    rows = []
    texts = [(p, label, True) for p, label in PHRASES.items()] + [(t, label, False) for label, t in TEMPLATES]
    for number, (text, label, exact) in enumerate(texts):
        words = re.findall("[0-9a-z]+", text)
        rows += [(" ".join(words[i : i + GRAM]), number, label, exact, len(words), i) for i in range(len(words) - GRAM + 1)]
    return spark.createDataFrame(rows, "gram string, template int, label string, exact boolean, size int, at int")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence spans and labels of every whole text.

    Returns ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``: places of the
    phrases (number, smallest and largest start), distinct sorted labels of the phrases and of all verified
    spans, the best coverage of a template, and the verified spans.  Null and empty texts have no words and
    no labels; texts of fewer than three words have no spans; very long texts are scanned whole; of equal covers
    all labels stand, sorted; every input row gives one result, repeated ones too; an empty table gives an empty
    table; other columns are left out, so names cannot clash.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    words = rows.select("row", "id", F.regexp_extract_all(ascii_lower(F.col("body")), F.lit(f"({WORDS})"), 1).alias("words"))
    gram = lambda i: F.concat_ws(" ", *[F.get("words", i + n) for n in range(GRAM)])
    grams = F.transform(
        F.sequence(F.lit(0), F.size("words") - GRAM),
        lambda i: F.struct(i.alias("pos"), gram(i).alias("gram")),
    )
    end = F.array(F.struct(F.size("words").alias("pos"), F.lit(None).cast("string").alias("gram")))
    rolled = words.select(
        "row", "id", F.inline(F.when(F.size("words") < GRAM, end).otherwise(F.concat(end, grams))).alias("pos", "gram")
    ).withColumn("hash", F.xxhash64("gram"))
    templates = template_grams(spark).withColumn("hash", F.xxhash64("gram"))
    met = (
        rolled.alias("d")
        .join(F.broadcast(templates.alias("t")), F.col("d.hash") == F.col("t.hash"), "left")
        .where(F.col("d.gram").isNull() | (F.col("d.gram") == F.col("t.gram")))
        .select("row", "id", "pos", F.col("d.gram").isNull().alias("is_end"), "template", "label", "exact", "size", "at")
    )
    votes = met.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.first("id").alias("id"),
        F.max(F.when(F.col("is_end"), F.col("pos"))).alias("n_words"),
        F.first("label").alias("label"),
        F.first("exact").alias("exact"),
        F.first("size").alias("size"),
        F.collect_set("at").alias("ats"),
    )
    ordered = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(ordered) <= DRIFT
    spans = (
        votes.withColumn("part", F.sum(F.when(near & ~F.col("exact"), 0).otherwise(1)).over(ordered))
        .groupBy("row", "template", "part")
        .agg(
            F.first("id").alias("id"),
            F.max("n_words").alias("n_words"),
            F.first("label").alias("label"),
            F.first("exact").alias("exact"),
            F.first("size").alias("size"),
            F.min("diagonal").alias("start"),
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        )
        .withColumn("covered", _covered(F.col("ats")) / F.col("size"))
    )
    full = F.col("covered") == 1.0
    base = F.col("exact") & full
    found = base | (~F.col("exact") & (F.col("covered") >= COVERAGE))
    out = spans.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        _joined(F.when(base, F.col("label"))).alias("base_labels"),
        _joined(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct(F.greatest("start", F.lit(0)).alias("start"), "size", "label", "covered")))).alias("spans"),
    )
    return out.drop("row")


def _joined(label: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(label)), ",")


def _covered(ats: Column) -> Column:
    """Number of template words under the grams at these positions."""
    return F.size(F.array_distinct(F.flatten(F.transform(ats, lambda i: F.sequence(i, i + (GRAM - 1))))))


def brute_force(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    """``n_words, n_base, first_word, last_word, base_labels`` word by word, for tests."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    places = []
    for (phrase, label), start in itertools.product(PHRASES.items(), range(len(words))):
        own = phrase.split()
        if words[start : start + len(own)] == own:
            places.append((start, label))
    starts = [s for s, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))
