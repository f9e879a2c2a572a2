"""License scans by diagonal voting, with DataFrame functions only.

All rolling 3-word hashes of every text are joined with the word positions of the templates; hits are counted by
diagonal (position in the text less position in the template); diagonals at most MAX_SHIFT words apart are merged, which
bridges inserted and missing words; and a span counts if it covers enough of its template in not too many words. Notices differ
by single words, so of verified spans that overlap only those with the most hashes stay. The base phrases are templates too: a
phrase stands where its diagonal has all its hashes. Hashes that match are confirmed by their words.

The templates are given with the call (by default those of this module, some hundred words) and counted before they are broadcast; texts aren't
shuffled, only hits and a row of each text are, by row.

Rows: one per input row. Null or empty text: 0 words, no places, empty labels, score 0. Repeated rows are scanned each.
Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.common import ascii_lower, text_or_empty

#: The characters that separate words.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Phrases of the base, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices that projects and works carry, and the labels they give.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "epl-2"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache-2"),
    ("spdx license identifier gpl 3 0", "gpl-3"),
    ("spdx license identifier bsd 3 clause", "bsd"),
    ("spdx license identifier mpl 2 0", "mpl-2"),
    ("spdx license identifier isc", "isc"),
]
#: Words of all templates together, at most: they are broadcast.
MOST_TEMPLATE_WORDS = 200_000
GRAM = 3
MAX_SHIFT = 2
LEAST_COVER = 0.6
MOST_STRETCH = 1.5


def _template_rows(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    rows = []
    for k, (phrase, label) in enumerate([*phrases, *notices]):
        words = re.split(" ", phrase)
        for at in range(len(words) - GRAM + 1):
            rows.append((k, k < len(phrases), label, len(words), len(words) - GRAM + 1, at, " ".join(words[at : at + GRAM])))
    if len(rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {len(rows)} words; at most {MOST_TEMPLATE_WORDS} are broadcast")
    return rows


def templates(spark, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    schema = "template int, base boolean, label string, t_words int, t_grams int, t_at int, t_gram string"
    return spark.createDataFrame(_template_rows(phrases, notices), schema).withColumn("t_hash", F.xxhash64("t_gram"))


def license_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), f"[{SEPARATORS}]+"), "")


def _hits(docs: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """A row of each text (at = -1) and a row of each hash that is in a template."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", license_words(text_or_empty()).alias("words"))
    n, words = F.size("words"), F.col("words")
    row = lambda at, gram: F.struct(at.cast("int").alias("at"), gram.cast("string").alias("gram"))
    grams = F.when(
        n >= GRAM,
        F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: row(i, F.concat_ws(" ", *[F.get(words, i + k) for k in range(GRAM)]))),
    ).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))
    # the type of the constant row must be that of the others, or concat() refuses them
    each = F.concat(F.array(row(F.lit(-1), F.lit(None))).cast("array<struct<at:int,gram:string>>"), grams)
    found = rows.select("rid", "doc_id", n.cast("long").alias("n_words"), F.explode(each).alias("g"))
    found = found.select("rid", "doc_id", "n_words", F.col("g.at").alias("at"), F.col("g.gram").alias("gram"))
    known = F.broadcast(templates(docs.sparkSession, phrases, notices))
    joined = found.join(known, (F.xxhash64(F.col("gram")) == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    return joined.where("at < 0 or template is not null")


def license_scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    phrases, notices: (text of lower-case words with single spaces, label); whole license texts can be given, too.
    """
    diagonals = (
        _hits(docs, phrases, notices)
        .groupBy("rid", "doc_id", "n_words", "template", "base", "label", "t_words", "t_grams", (F.col("at") - F.col("t_at")).alias("diagonal"))
        .agg(F.sort_array(F.collect_list("t_at")).alias("covers"))
    )
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MAX_SHIFT, F.lit(True)).cast("int")
    spans = (
        diagonals.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "doc_id", "n_words", "template", "base", "label", "t_words", "t_grams", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covered"),
            F.min(F.col("diagonal") + F.array_min("covers")).alias("start"),
            F.max(F.col("diagonal") + F.array_max("covers") + GRAM).alias("end"),
            F.sum(F.when(F.size("covers") == F.col("t_grams"), 1).otherwise(0)).alias("places"),
            F.min(F.when(F.size("covers") == F.col("t_grams"), F.col("diagonal"))).alias("first_place"),
            F.max(F.when(F.size("covers") == F.col("t_grams"), F.col("diagonal"))).alias("last_place"),
        )
    )
    cover = F.col("covered") / F.col("t_grams")
    base = F.col("base") & (F.col("places") > 0)
    enough = F.col("template").isNotNull() & ~F.col("base") & (cover >= LEAST_COVER) & (F.col("end") - F.col("start") <= MOST_STRETCH * F.col("t_words"))
    in_text = Window.partitionBy("rid").orderBy(F.desc("enough"), "start", "end", "template")
    before = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("enough", F.coalesce(enough, F.lit(False)))
    spans = spans.withColumn("first", F.coalesce(~F.col("enough") | (F.col("start") >= before), F.lit(True)).cast("int"))
    spans = spans.withColumn("cluster", F.sum("first").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    most = F.max("covered").over(Window.partitionBy("rid", "cluster"))
    spans = spans.withColumn("verified", F.col("enough") & (F.col("covered") == most))
    verified = F.col("verified")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return (
        spans.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("first_place"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("last_place"))).cast("long").alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set(F.when(base | verified, F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.when(base, F.lit(1.0)).when(verified, cover)), F.lit(0.0)).alias("score"),
        )
        .drop("rid")
    )
