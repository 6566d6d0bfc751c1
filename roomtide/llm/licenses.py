"""License scans by diagonal voting.

Every run of words of a document is hashed; one array per document is exploded
and joined with the broadcast table of template positions, whose size is fixed
by ``TEMPLATES``. A hit votes for its diagonal (place in the document less place
in the template). Votes are counted by diagonal, neighbouring diagonals of a
template are merged where words were put in or left out, and the merged spans
are verified: each voting run has the template's words, and the share of the
template's runs that voted reaches ``min_cover``. Base phrases must match in
full on one diagonal and are never merged.

A hot license is no hot key: rows meet by document row only. Each document row
carries one marker through the join, so rows without any hit stay in the result
and the input is read once.

Defined cases: null and empty texts have no words and no hits. Repeated rows
are judged one by one. An empty table gives an empty table. Spans that overlap
are all reported. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from roomtide.llm.common import ALNUM_GAP

# Phrases of the base rule, and grant texts of public licenses.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
               "with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
             "published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
GRAM, PHRASE_GRAM = 5, 2
SLACK, GAP = 4, 30
MIN_COVER = 0.6


def word_list(text: Column) -> Column:
    """Words after lowering A-Z. ``lower`` also changes other letters, which no template word has; the two that it
    would turn into an ASCII letter are replaced first."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")), F.lit("\u0130"), F.lit("\u00e5"))
    return F.array_remove(F.split(F.lower(safe), ALNUM_GAP), "")


def run_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(length)])


def template_runs(spark: SparkSession) -> DataFrame:
    """(h2, h5, k, template, label, offset, runs, words): one row per run of each template, and the marker's row."""
    rows = [(i, label, PHRASE_GRAM, text) for i, (label, text) in enumerate(PHRASES)]
    rows += [(len(PHRASES) + i, label, GRAM, text) for i, (label, text) in enumerate(TEMPLATES)]
    values = ", ".join(f"({i}, '{label}', {k}, '{text}')" for i, label, k, text in rows)
    listed = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, k, text)")
    listed = listed.withColumn("words", word_list(F.col("text"))).withColumn("runs", F.size("words") - F.col("k") + 1)
    runs = listed.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).select(
        run_hash(F.col("words"), F.col("offset"), PHRASE_GRAM).alias("h2"),
        run_hash(F.col("words"), F.col("offset"), GRAM).alias("h5"),
        "k", "template", "label", "offset", "runs", F.slice("words", F.col("offset") + 1, F.col("k")).alias("run"),
    )
    marker = spark.sql(
        "SELECT CAST(-1 AS BIGINT) h2, CAST(-1 AS BIGINT) h5, 0 k, -1 template, CAST(NULL AS STRING) label, 0 offset, "
        "1 runs, CAST(array() AS array<string>) run"
    )
    return runs.unionByName(marker)


def first_hashes(spark: SparkSession) -> list[int]:
    """Hashes of the first two words of all template runs; as many as the templates have words."""
    return sorted({row["h2"] for row in template_runs(spark).where("k > 0").select("h2").distinct().collect()})


def votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Votes by document row, template and diagonal; template -1 is the row's marker.

    Places whose first two words begin no template run are left out before a
    row is made of them, and a row carries the words of its own run only, so
    work and memory grow in proportion to the text.
    """
    spark = docs.sparkSession
    words = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), word_list(F.col(text_col)).alias("_w")
    )
    places = F.transform("_w", lambda _, i: F.struct(i.alias("at"), run_hash(F.col("_w"), i, PHRASE_GRAM).alias("h2")))
    places = F.filter(places, lambda p: p.getField("h2").isin(first_hashes(spark)))
    run = lambda p: F.struct(
        p.getField("at").alias("at"), p.getField("h2").alias("h2"), run_hash(F.col("_w"), p.getField("at"), GRAM).alias("h5"),
        F.slice("_w", p.getField("at") + 1, GRAM).alias("run"),
    )
    marker = F.struct(
        F.lit(-1).alias("at"), F.lit(-1).cast("bigint").alias("h2"), F.lit(-1).cast("bigint").alias("h5"),
        F.array().cast("array<string>").alias("run"),
    )
    runs = F.concat(F.array(marker), F.transform(places, run))
    exploded = words.select("_row", "_id", F.size("_w").cast("bigint").alias("_n"), F.explode(runs).alias("_r")).select(
        "_row", "_id", "_n", "_r.at", F.col("_r.h2").alias("_h2"), F.col("_r.h5").alias("_h5"), F.col("_r.run").alias("_run")
    )
    table = F.broadcast(template_runs(spark))
    same = (F.col("_h2") == F.col("h2")) & ((F.col("k") != GRAM) | (F.col("_h5") == F.col("h5")))
    equal = (F.col("at") < 0) == (F.col("k") == 0)
    checked = (F.col("k") == 0) | (F.slice("_run", 1, F.greatest("k", F.lit(1))) == F.col("run"))
    hits = exploded.join(table, same).where(equal & checked)
    return hits.groupBy("_row", "_id", "_n", "template", "label", "k", "runs", (F.col("at") - F.col("offset")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last")
    )


def spans(counted: DataFrame, slack: int = SLACK, gap: int = GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans of each document row (and its marker): neighbouring diagonals merged."""
    order = Window.partitionBy("_row", "template").orderBy("first", "diagonal")
    apart = (
        (F.col("k") != GRAM) | F.lag("diagonal").over(order).isNull()
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > slack)
        | (F.col("first") - F.lag("last").over(order) > gap)
    )
    cut = counted.withColumn("_new", apart.cast("int"))
    cut = cut.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cover = F.least(F.sum("votes") / F.col("runs"), F.lit(1.0))
    need = F.when(F.col("k") == GRAM, F.lit(min_cover)).otherwise(F.lit(1.0))
    return (
        cut.groupBy("_row", "_id", "_n", "template", "label", "k", "runs", "_span")
        .agg(cover.alias("cover"), F.min("first").cast("bigint").alias("first"), F.max("last").alias("_last"))
        .where(F.col("cover") >= need)
        .withColumn("last", (F.col("_last") + F.col("k") - 1).cast("bigint"))
        .drop("_last", "_span")
    )


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc id, label, template, first_word, last_word, cover): every license text found."""
    found = spans(votes(docs, id_col, text_col), **options).where(F.col("template") >= 0)
    return found.select(
        F.col("_id").alias(id_col), "label", "template", F.col("first").alias("first_word"), F.col("last").alias("last_word"), "cover"
    )


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: places of the base phrases, labels and score."""
    base = F.col("k") == PHRASE_GRAM
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    start = F.when(base, F.col("first"))
    return spans(votes(docs, "doc_id", "text")).groupBy("_row", "_id", "_n").agg(
        F.count_if(base).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("k") > 0).alias("labels"),
        F.coalesce(F.max(F.when(F.col("k") > 0, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
