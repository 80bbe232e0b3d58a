"""Licence scan with a positional index of rare words.

The words of all licence templates are the vocabulary; how rare each is, is counted over all documents. A
template is a candidate for a file that holds its key phrase and one of its rarest words, which are so many that
the others weigh less than ``LEAST_SCORE`` of it. All words of a file's candidates are looked up in their postings
(word, template, position), so that no other licence in the file lowers a score. A place in the file and a posting that lie as far
apart as others do belong to one alignment of the template; an alignment's score is the share of the
template's IDF weight that it meets. A template counts where its mandatory key phrase stands in the file word
by word and an alignment reaches ``LEAST_SCORE``. Phrases are templates that must align in all their words.

A file in which no key phrase has all its words cannot pass the verification and is not looked up. All is
DataFrame work; the template postings, a few hundred fixed rows, are broadcast.

Defined results: null and empty texts have no words and no labels; repeated rows give repeated results; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathrank.llm.common import cut

# Phrases that must stand word by word, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Label, mandatory key phrase and notice of each licence.
TEMPLATES = [
    ("gpl-3.0", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "licensed under the gnu affero general public license"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    (
        "gpl-3.0",
        "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "apache-2.0",
        "apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "mit",
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions "
        "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution",
    ),
    (
        "isc",
        "for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
]
LEAST_SCORE = 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, with single spaces between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _OUTSIDE, " "))


def _n_words(t: Column) -> Column:
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _rarest(notice: str, idf: dict[str, float]) -> list[str]:
    """A notice's rarest words, of which an alignment that reaches ``LEAST_SCORE`` has one at least."""
    words = sorted(notice.split(), key=lambda w: (-idf[w], w))
    whole, rest, n = sum(idf[w] for w in words), sum(idf[w] for w in words), 0
    while n < len(words) and rest >= (LEAST_SCORE - 1e-3) * whole:
        rest -= idf[words[n]]
        n += 1
    return sorted(set(words[:n]))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, found_labels (arrays) and score."""
    spark = docs.sparkSession
    patterns = [(label, phrase, phrase, True) for phrase, label in phrases.items()] + [(*t, False) for t in templates]
    vocabulary = sorted({w for *_, notice, _ in patterns for w in notice.split()})
    keys = sorted({phrase for _, phrase, _, _ in patterns})

    t = F.col("_t")
    words = docs.select("doc_id", normal(F.col("text")).alias("_t")).select("doc_id", "_t", F.array_intersect(F.split(t, " "), _strings(vocabulary)).alias("present"))
    possible = F.lit(False)
    for key in keys:
        own = sorted(set(key.split()))
        possible = possible | (F.size(F.array_intersect("present", _strings(own))) == len(own))
    base = words.select("doc_id", _n_words(t).alias("n_words"), "present", F.monotonically_increasing_id().alias("row"), F.when(possible, t).alias("_t"))
    base = cut(base)

    # a row for each word of the vocabulary at most
    total = base.count()
    seen = dict(base.select(F.explode("present").alias("word")).groupBy("word").count().collect())
    idf = {w: round(math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-3, 6) for w in vocabulary}
    weight = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf[w])])

    files = base.where("_t is not null")
    padded = F.concat(F.lit(" "), F.col("_t"), F.lit(" "))
    held = F.filter(_strings(keys), lambda k: F.contains(padded, F.concat(F.lit(" "), k, F.lit(" "))))
    files = files.withColumn("held", held).where(F.size("held") > 0)
    chosen = [F.when(F.array_contains("held", key) & F.arrays_overlap("present", _strings(_rarest(notice, idf))), F.lit(p)) for p, (_, key, notice, _) in enumerate(patterns)]
    own_words = F.array(*[_strings(sorted(set(notice.split()))) for _, _, notice, _ in patterns])
    files = files.withColumn("candidates", F.array_compact(F.array(*chosen))).withColumn("wanted", F.array_distinct(F.flatten(F.transform("candidates", lambda p: own_words[p]))))
    places = files.select("row", "wanted", "candidates", F.posexplode(F.split("_t", " ")).alias("at", "word")).where(F.array_contains("wanted", F.col("word"))).select("row", "candidates", "at", "word")
    postings = spark.createDataFrame(
        [(w, p, k, label, exact, len(notice.split()), float(sum(idf[x] for x in notice.split()))) for p, (label, _, notice, exact) in enumerate(patterns) for k, w in enumerate(notice.split())],
        "word string, pattern int, k int, label string, exact boolean, n int, whole double",
    )
    met = places.join(F.broadcast(postings), "word").where(F.array_contains("candidates", F.col("pattern")))
    # an alignment of a template starts where the file's place and the posting's lie apart; it may begin before the file
    aligned = met.groupBy("row", "pattern", (F.col("at") - F.col("k")).alias("start")).agg(
        F.count("*").alias("hits"), F.sum(weight[F.col("word")]).alias("weight"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("n").alias("n"), F.first("whole").alias("whole")
    )
    aligned = aligned.withColumn("score", F.least(F.lit(1.0), F.round(F.col("weight") / F.col("whole"), 6)))
    is_base = F.col("exact") & (F.col("hits") == F.col("n"))
    is_found = ~F.col("exact") & (F.col("score") >= LEAST_SCORE)
    found = aligned.where(is_base | is_found).groupBy("row").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("found_labels"),
        F.max("score").alias("score"),
    )
    nothing = F.array().cast("array<string>")
    return base.drop("_t", "present").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", nothing).alias("base_labels"), F.coalesce("found_labels", nothing).alias("found_labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
