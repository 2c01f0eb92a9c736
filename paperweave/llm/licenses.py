"""License notices by diagonal voting: word k-grams of texts joined with template positions, column operations only.

Every k-gram of every text is looked up among the template k-grams. A hit votes for its diagonal, the place in
the text minus the place in the template; diagonals near one another are one span with some words added or left
out. A span counts as its template if enough template words stand in it in the template's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.llm.common import let, lower_ascii

GRAM = 3
#: Diagonals of one span lie this far apart at most: so many words may be added or left out in all of it.
DRIFT = 8
#: Share of a template's words that a span must hold.
LEAST_COVERED = 0.6

#: Characters between words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: phrases that name a license by themselves
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# fixed values: openings of public license notices, in lower case and without punctuation
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "this work has been marked as dedicated to the public domain"),
    ("proprietary", "all rights reserved"),
]


def license_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + n) for n in range(k)])


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int = GRAM) -> DataFrame:
    """One row per template position: ``template, label, n_template, j, gram_words, gram``.

    The list is an argument of the job, a few notices of some dozen words, so its size does not follow the data.
    """
    if any(len(text.split()) < k for _, text in templates):
        raise ValueError(f"a template needs {k} words")
    rows = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for n, (label, text) in enumerate(templates)]
    given = spark.range(1).select(F.inline(F.array(*rows)))
    split = given.select("template", "label", F.split("text", " ").alias("w"))
    placed = split.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("w") - k)))
    return placed.select(
        "template", "label", F.size("w").alias("n_template"), "j",
        F.slice("w", F.col("j") + 1, F.lit(k)).alias("gram_words"), _gram(F.col("w"), F.col("j"), k).alias("gram"),
    )


def _base(docs: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """Places of the phrases: ``n_base, first_word, last_word, base_labels``, from the joined words ``_line``."""
    line, n = F.col("_line"), F.col("n_words")

    def spaces(part: Column) -> Column:
        return (F.char_length(part) - F.char_length(F.replace(part, F.lit(" "), F.lit("")))).cast("bigint")

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        own = f" {phrase} "
        has = F.contains(line, F.lit(own))
        counts.append(F.when(has, F.regexp_count(line, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("bigint"))
        firsts.append(F.when(has, spaces(F.substring_index(line, own, 1))))
        lasts.append(F.when(has, n - len(phrase.split()) - spaces(F.substring_index(line, own, -1))))
        labels.append(F.when(has, F.lit(label)))
    n_base = counts[0]
    for more in counts[1:]:
        n_base = n_base + more
    return docs.withColumns(
        {
            "n_base": n_base,
            "first_word": F.array_min(F.array(*firsts)),
            "last_word": F.array_max(F.array(*lasts)),
            "_base_labels": F.array_compact(F.array(*labels)),
        }
    )


def _ordered(hits: Column, k: int) -> Column:
    """Template words in the longest chain of k-grams that ascends in both places; hits are ``i, -j``, sorted.

    Equal text places come with the later template place first, so a chain has one hit of each.
    """

    def longer(chains: Column, hit: Column) -> Column:
        at = -hit["j"]
        before = F.transform(F.filter(chains, lambda c: c["j"] < at), lambda c: c["n"] + F.least(F.lit(k), at - c["j"]))
        return F.concat(chains, F.array(F.struct(at.alias("j"), F.coalesce(F.array_max(before), F.lit(k)).alias("n"))))

    found = F.aggregate(hits, F.array().cast("array<struct<j:int,n:int>>"), longer)
    return F.coalesce(F.array_max(F.transform(found, lambda c: c["n"])), F.lit(0))


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    k: int = GRAM,
    drift: int = DRIFT,
    least_covered: float = LEAST_COVERED,
) -> DataFrame:
    """One row per document: phrase places, labels, score and the accepted spans.

    ``key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``; a span is ``label,
    first_word, end_word, covered``, the best of those that begin within ``drift`` diagonals of it. Covered is the share
    of template words in the longest chain of shared k-grams that ascends in text and template. The score is the largest share of a template that a span holds, 1 where a
    phrase stands. Null and empty texts have no words, no label and score 0; repeated rows give repeated rows;
    other columns of ``docs`` are not read. A text is told from its copies by its place in the input, which a
    task that runs again finds the same.
    """
    narrow = docs.select(F.col(key).alias("_key"), license_words(F.col(text)).alias("_w"))
    numbered = narrow.withColumn("_row", F.monotonically_increasing_id()).withColumn("n_words", F.size("_w").cast("bigint"))
    lined = numbered.withColumn("_line", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))
    of_doc = ["_row", "_key", "n_words", "n_base", "first_word", "last_word", "_base_labels"]
    with_base = _base(lined, phrases).select(*of_doc, "_w")
    # the place is generated, the words stay where they are: k-grams are hashed in generated code, without a copy
    places = F.when(F.size("_w") >= k, F.sequence(F.lit(0), F.size("_w") - k))
    each = with_base.select("*", F.explode_outer(places).alias("_i"))
    grams = F.broadcast(template_grams(docs.sparkSession, templates, k))
    at = F.col("_i")
    same = F.col("gram") == F.when(at.isNotNull(), _gram(F.col("_w"), at, k))
    for n in range(k):  # equal words, not only equal hashes
        same = same & (F.get(F.col("_w"), at + n) == F.get(F.col("gram_words"), F.lit(n)))
    hits = each.join(grams, same, "left").filter(F.col("template").isNotNull() | at.isNull() | (at == 0))
    hits = hits.select(*of_doc, "template", "label", "n_template", "_i", "j").repartition("_row")
    # votes per diagonal; all that follows stays in the partitions of _row
    # a row without a hit only carries its document: its diagonal is null
    votes = hits.withColumn("_diagonal", F.col("_i") - F.col("j")).groupBy(*of_doc, "template", "label", "n_template", "_diagonal").agg(
        F.min("_i").alias("_from"), F.max("_i").alias("_to"), F.collect_set("j").alias("_js")
    )
    line = Window.partitionBy("_row", "template").orderBy("_diagonal")
    span = line.rangeBetween(0, drift)
    each_hit = F.flatten(F.transform("_votes", lambda v: F.transform(v["_js"], lambda j: F.struct((v["_diagonal"] + j).alias("i"), (-j).alias("j")))))
    chained = let(F.sort_array(each_hit), lambda hits: _ordered(hits, k))
    verified = votes.withColumns(
        {
            "_votes": F.collect_list(F.struct("_diagonal", "_js")).over(span),
            "_from": F.min("_from").over(span),
            "_to": F.max("_to").over(span),
        }
    ).withColumn("_covered", F.when(F.col("template").isNotNull(), chained / F.col("n_template")))
    # of spans that start near one another the best is kept, of equal ones the first
    rank = F.struct(F.col("_covered"), (-F.col("_diagonal")).alias("d"))
    best = F.max(rank).over(line.rangeBetween(-drift, drift))["d"] == -F.col("_diagonal")
    verified = verified.withColumn("_best", best)
    accepted = F.col("_covered") >= least_covered
    span = F.struct("label", F.col("_from").cast("bigint").alias("first_word"), (F.col("_to") + k).cast("bigint").alias("end_word"), F.col("_covered").alias("covered"))
    result = verified.groupBy(*of_doc).agg(
        F.collect_set(F.when(accepted, F.col("label"))).alias("_labels"),
        F.coalesce(F.max("_covered"), F.lit(0.0)).alias("_score"),
        F.sort_array(F.collect_set(F.when(accepted & F.col("_best"), span))).alias("spans"),
    )
    return result.select(
        F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array(F.array_distinct("_base_labels")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base_labels", "_labels")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("_score")).alias("score"),
        "spans",
    )
