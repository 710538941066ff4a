"""License notices found by votes on diagonals: document position minus template position of shared word k-grams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.words import ascii_lower, rolling, split_words

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3

# fixed values: phrases that count by themselves
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: public license notices
NOTICES = {
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                "You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
           "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
            "published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
             "file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}


def template_rows(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """(template, label, whether a phrase, k-grams in all, position, k words)."""
    rows = []
    for base, texts in ((True, phrases.items()), (False, ((text, label) for label, text in notices.items()))):
        for text, label in texts:
            w = [x for x in re.split(GAP, text.lower()) if x]
            if not K <= len(w) <= 4 * 63 + K:
                raise ValueError(f"a template has {K} to {4 * 63 + K} words: {text[:40]}")
            rows += [(f"{label}{'' if base else ' notice'}: {text[:30]}", label, base, len(w) - K + 1, i, *w[i:i + K]) for i in range(len(w) - K + 1)]
    return rows


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
                  slack: int = 3, cover: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first, last, cover).

    Words are runs of digits, a-z and characters beyond ASCII after A-Z are lower-cased. A phrase counts where all its k-grams lie on one
    diagonal, that is word by word. For a notice, diagonals at most `slack` apart are one match (words put in or left out); it counts if
    `cover` of the notice's k-grams are on it and its words span no more than twice the notice. score is the largest cover of any
    match, 1 with a phrase, 0 without any shared k-gram. Null and empty texts have no words: counts 0, null words, empty labels, score 0.
    Rows that repeat id and text get equal results, each its own row; null ids are allowed; other columns are not looked at.

    The template table is broadcast: its size is fixed by the two constants. Hashes are joined, then the words themselves compared.
    """
    spark = docs.sparkSession
    w = split_words(ascii_lower(F.col(text_col).cast("string")), GAP)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), w.alias("w"))
    grams = rolling(rows, "w", K, ["doc_id", "sha"])
    names = [f"t{i}" for i in range(K)]
    marks = spark.createDataFrame(template_rows(phrases, notices), "template string, label string, base boolean, total int, at int, " + ", ".join(f"{n} string" for n in names))
    marks = F.broadcast(marks.withColumn("h", F.xxhash64(*names)))
    same = [F.col(f"g{i}") == F.col(f"t{i}") for i in range(K)]
    met = grams.withColumn("h", F.xxhash64(*(f"g{i}" for i in range(K)))).join(marks, "h")
    for s in same:
        met = met.filter(s)
    bit = lambda i: F.bit_or(F.when(F.expr("at div 63") == i, F.expr("shiftleft(1L, at % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"b{i}")
    key = ["doc_id", "sha", "template", "label", "base", "total"]
    # repeated rows vote alike, so votes are kept as bits and not as counts
    lines = met.withColumn("diag", F.col("pos") - F.col("at")).groupBy(*key, "diag").agg(*(bit(i) for i in range(4)), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy(*key).orderBy("diag")
    lines = lines.withColumn("new", (F.col("base") | F.coalesce(F.col("diag") - F.lag("diag").over(order) > slack, F.lit(True))).cast("int"))
    lines = lines.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    share = lambda cols: sum((F.bit_count(c) for c in cols[1:]), F.bit_count(cols[0])) / F.col("total")
    lines = lines.withColumn("own", share([F.col(f"b{i}") for i in range(4)]))
    spans = lines.groupBy(*key, "run").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)), F.max("own").alias("own"), F.max_by("lo", F.struct("own", -F.col("diag"))).alias("lo1"),
                                          F.max_by("hi", F.struct("own", -F.col("diag"))).alias("hi1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = F.col("hi") - F.col("lo") + 1 <= 2 * (F.col("total") + K)
    spans = spans.withColumn("cover", F.when(whole, share([F.col(f"b{i}") for i in range(4)])).otherwise(F.col("own")))
    spans = spans.select("doc_id", "sha", "label", "base", "cover", F.when(whole, F.col("lo")).otherwise(F.col("lo1")).alias("first"), (F.when(whole, F.col("hi")).otherwise(F.col("hi1")) + K - 1).alias("last"))
    hit = F.when(F.col("base"), F.col("cover") == 1.0).otherwise(F.col("cover") >= cover)
    spans = spans.withColumn("hit", hit).withColumn("place", F.col("base") & F.col("hit"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = spans.groupBy("doc_id", "sha").agg(
        F.count_if("place").alias("n_base"), F.min(F.when(F.col("place"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("place"), F.col("first"))).alias("last_word"),
        joined(F.when(F.col("place"), F.col("label"))).alias("base_labels"), joined(F.when(F.col("hit"), F.col("label"))).alias("labels"),
        F.max(F.when(~F.col("base") | F.col("hit"), F.col("cover"))).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.struct("label", "first", "last", "cover")))).alias("spans"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), *per.columns[2:])
    out = rows.select("doc_id", "sha", F.size("w").cast("long").alias("n_words")).join(per, F.col("sha").eqNullSafe(F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<label:string,first:int,last:int,cover:double>>")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("spans", none).alias("spans"))
