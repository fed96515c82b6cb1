"""Licence scan: positional index of the rare words of licence templates, verified by key phrases.

The document frequency of every template word is counted over the whole table. Each template is indexed by its
``RARE`` words of highest IDF. A file looks up those of its words that stand in the index; a posting at word ``t``
of a template met at word ``p`` of the file lies on diagonal p - t, and postings of one template are intersected by
diagonal: they are gathered in bands of ``2 * STEP`` diagonals that overlap by half, so that a few words more or less
between them do no harm. Key phrases are postings too: a template is accepted in a band only where all its key phrases
stand at their places and enough of the IDF of its rare words was met. Only DataFrame functions run, on the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from engramlake.llm.store import keep

RARE = 4
STEP = 8
LEAST_SHARE = 0.6
# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label, words of a public licence notice, key phrases that must stand in it.
TEMPLATES = (
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license", "obtain a copy of the license")),
    ("apache", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("as is basis", "without warranties or conditions of any kind")),
    ("artistic", "this program is distributed under the terms of the artistic license 2 0", ("artistic license",)),
    ("boost", "boost software license version 1 0", ("boost software license",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("epl", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("must not be misrepresented",)),
)

VOCABULARY = tuple(sorted({word for _, text, _ in TEMPLATES for word in text.split()}))
PHRASES = tuple(dict.fromkeys([phrase for phrase, _ in BASE] + [phrase for _, _, phrases in TEMPLATES for phrase in phrases]))
KELVIN, OTHER = "K", "é"  # the only sign beyond ASCII whose lower case is ASCII, and one that stays beyond it


def text_words(text: Column) -> Column:
    """Words of a text; only A-Z become a-z as far as comparing with ASCII words goes."""
    lowered = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def document_frequencies(documents: DataFrame) -> tuple[int, dict[str, int]]:
    """(rows, rows that hold it for every template word): at most one row a word of the templates reaches the driver."""
    words = F.array_append(F.array_intersect(text_words(F.col("text")), F.lit(list(VOCABULARY))), "")  # no word is empty: it counts rows
    counted = {row.word: row["n"] for row in documents.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counted.pop("", 0), counted


def rare_postings(rows: int, df: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """(template, word, place, weight): the places of every template's ``RARE`` rarest words; weight is the IDF in thousandths."""
    out = []
    for template, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        rare = sorted(set(words), key=lambda w: (df.get(w, 0), w))[:RARE]
        out += [(template, word, place, 1 + round(1000 * math.log((rows + 1) / (df.get(word, 0) + 1)))) for place, word in enumerate(words) if word in rare]
    return out


def phrase_postings() -> list[tuple[int, str, int]]:
    """(template, phrase, place) of the key phrases."""
    return [(template, phrase, f" {text} ".split(f" {phrase} ")[0].count(" ")) for template, (_, text, phrases) in enumerate(TEMPLATES) for phrase in phrases]


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Places where the phrase's words stand one after the other; the words are only gone through where it occurs."""
    first, *rest = phrase.split()

    def stands(i: Column) -> Column:
        found = F.get(words, i) == first
        for step, word in enumerate(rest, 1):
            found = found & (F.get(words, i + step) == word)
        return found

    span = F.sequence(F.lit(0), F.size(words) - 1)
    return F.when(joined.contains(f" {phrase} "), F.filter(span, stands)).otherwise(F.array().cast("array<int>"))


def scan_words(documents: DataFrame, rare: list[str]) -> DataFrame:
    """One row per row: key, doc_id, n_words, places (per phrase), hits (place and word of every rare word)."""
    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_words(F.col("text")).alias("w"))
    joined = words.withColumn("joined", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    known = F.lit(rare)
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("p"), x.alias("word"))), lambda s: F.array_contains(known, s["word"]))
    none = F.array().cast("array<struct<p:int,word:string>>")
    return joined.select(
        F.monotonically_increasing_id().alias("key"), "doc_id", F.size("w").cast("long").alias("n_words"),
        F.array(*[_places(F.col("w"), F.col("joined"), phrase) for phrase in PHRASES]).alias("places"),
        F.when(F.arrays_overlap("w", known), hits).otherwise(none).alias("hits"),
    )


def _bands(diagonal: Column) -> Column:
    own = F.floor(diagonal / STEP)
    return F.explode(F.array(own - 1, own)).alias("band")


def scan_licenses(documents: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``documents`` (doc_id, text).

    Base phrases count wherever their words follow each other; the index adds the labels of the templates that it accepts.
    ``score`` is 1 where a base phrase stands, else the largest share of a template's IDF met on a band, times the
    share of its key phrases there. A null text counts as empty: no words, no labels (empty strings), score 0. Repeated
    rows and ids are rows of their own; further columns are not read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    total, df = document_frequencies(documents)
    postings = rare_postings(total, df)
    scanned = keep(scan_words(documents, sorted({word for _, word, _, _ in postings})), "licence-words")

    # the index has a few hundred rows, fixed by the templates
    index = F.broadcast(spark.createDataFrame([Row(word=w, template=t, at=p, x=x) for t, w, p, x in postings]))
    phrases = F.broadcast(spark.createDataFrame([Row(phrase=PHRASES.index(x), template=t, at=p) for t, x, p in phrase_postings()]))
    whole = [Row(template=t, label=label, needed=len(wanted), all=sum(x for k, _, _, x in postings if k == t)) for t, (label, _, wanted) in enumerate(TEMPLATES)]
    words = scanned.select("key", F.explode("hits").alias("h")).select("key", "h.p", "h.word").join(index, "word")
    keys = scanned.select("key", F.posexplode("places").alias("phrase", "found")).filter(F.size("found") > 0).select("key", "phrase", F.explode("found").alias("p")).join(phrases, "phrase")
    met = words.select("key", "template", _bands(F.col("p") - F.col("at")), "at", "x", F.lit(0).alias("verified"))
    met = met.unionByName(keys.select("key", "template", _bands(F.col("p") - F.col("at")), "at", F.lit(0).cast("long").alias("x"), F.lit(1).alias("verified"))).distinct()
    bands = met.groupBy("key", "template", "band").agg(F.sum("x").alias("x"), F.sum("verified").alias("verified"))
    judged = bands.join(F.broadcast(spark.createDataFrame(whole)), "template").select("key", "label", (F.col("x") / F.col("all")).alias("share"), (F.col("verified") / F.col("needed")).alias("verified"))
    accepted = (F.col("verified") == 1) & (F.col("share") >= least_share)
    found = judged.groupBy("key").agg(F.collect_set(F.when(accepted, F.col("label"))).alias("found"), F.max(F.col("share") * F.col("verified")).alias("best"))

    base = [F.get("places", F.lit(PHRASES.index(phrase))) for phrase, _ in BASE]
    places = F.concat(*base)
    rows = scanned.select(
        "key", "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(at) > 0, F.lit(label)) for at, (_, label) in zip(base, BASE, strict=True)])).alias("own"),
    ).join(found, "key", "left")
    every = F.array_union("own", F.coalesce("found", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), F.round(score, 6).alias("score"),
    )
