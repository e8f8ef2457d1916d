"""Licence phrases and notices by votes for offset diagonals. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import window_hash, word_hashes

#: Words of a gram; the shortest phrase has as many.
K = 3
#: Diagonals this near to each other are one span, as a word more or less in a notice shifts the rest of it.
GAP = 3
#: Share of a notice's grams that a span must have for its label.
COVERAGE = 0.8

#: The base phrases, and notices in their public wording, with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nc", "You may not use the material for commercial purposes"),
    ("cc-by", "Creative Commons Attribution 4.0 International"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl", "subject to the terms of the Mozilla Public License"),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in lower case: runs of digits, letters and characters beyond ASCII.

    lower() also changes letters beyond ASCII. That joins and splits no words, and of what it turns into
    ASCII, only the Kelvin sign makes a plain letter.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def templates(spark: SparkSession) -> DataFrame:
    """A row for each gram of each phrase and notice: a table of fixed size, whatever the input."""
    quoted = lambda s: "'" + s + "'"
    rows = [f"({i}, {quoted(label)}, {str(i < len(PHRASES)).lower()}, {quoted(text)})" for i, (label, text) in enumerate(PHRASES + NOTICES)]
    given = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, base, text)").withColumn("tw", words(F.col("text")))
    given = given.withColumn("h", word_hashes("tw")).select("*", F.posexplode("h").alias("tpos", "x"))
    return given.where(F.col("tpos") <= F.size("h") - K).select(
        window_hash("h", "tpos", K).alias("gram"), "template", "label", "base", "tpos", F.slice("tw", F.col("tpos") + 1, K).alias("tgram"), (F.size("tw") - K + 1).alias("grams")
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and spans, the verified ones with their label, template, first and last word and share of grams found.

    Every gram of every text is joined with the grams' positions in the templates. A match votes for the
    diagonal, its offset less the template's. A base phrase stands where a diagonal has all of its grams.
    Neighbouring diagonals are merged into spans; a span with COVERAGE of a notice's grams, no wider than
    half as much again, has its label. A gram is compared by its words, so equal hashes alone don't count.
    score is 1 with a base phrase, else the largest share of a notice's grams in any span.

    Null and empty texts have no words and score 0. Rows repeated with the same text are counted apart. An
    empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    rows = rows.withColumn("h", word_hashes("w")).withColumn("n_words", F.size("w"))
    # The element before the words' stands for the row itself, and matches nothing.
    at = rows.select("doc_id", "key", "w", "h", "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), F.col("h"))).alias("p", "x")).withColumn("pos", F.col("p") - 1)
    joined = at.withColumn("gram", window_hash("h", "pos", K)).join(F.broadcast(templates(spark)), "gram", "left")
    voted = F.slice("w", F.col("pos") + 1, K) == F.col("tgram")
    votes = joined.where((F.col("pos") < 0) | voted).select("doc_id", "key", "n_words", "pos", "template", "label", "base", "tpos", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    # One exchange, of a row for each document and vote; whatever follows groups by more than these two.
    diagonals = votes.repartition("doc_id", "key").groupBy("doc_id", "key", "template", "label", "base", "grams", "diagonal").agg(F.collect_set("tpos").alias("found"), F.count("*").alias("rows"), F.max("n_words").alias("n_words"))
    mine = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    spans = diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(mine) > GAP).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(mine))
    whole = F.col("base") & (F.size("found") == F.col("grams"))
    spans = spans.groupBy("doc_id", "key", "template", "label", "base", "grams", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
        F.min("diagonal").alias("from"),
        F.max("diagonal").alias("to"),
        F.sum(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"),
        F.max(F.when(F.col("template").isNull(), F.col("n_words"))).alias("n_words"),
        F.sum(whole.cast("bigint")).alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
    )
    share = F.when(~F.col("base"), F.size("found") / F.col("grams"))
    sound = (share >= COVERAGE) & (F.col("to") - F.col("from") <= F.col("grams") / 2)
    span = F.struct("label", "template", (F.col("from") + F.array_min("found")).alias("first"), (F.col("to") + F.array_max("found") + K - 1).alias("last"), share.alias("share"))
    base_label = F.when(F.col("n_base") > 0, F.col("label"))
    per = spans.groupBy("doc_id", "key").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sum(F.coalesce("n_base", F.lit(0))).alias("n_base"),
        F.min("first_word").cast("bigint").alias("first_word"),
        F.max("last_word").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base_label)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce(base_label, F.when(sound, F.col("label"))))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(sound, span))).alias("spans"),
    )
    return per.select(F.explode(F.array_repeat("doc_id", F.col("copies").cast("int"))).alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
