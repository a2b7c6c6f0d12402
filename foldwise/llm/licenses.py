"""License scans by diagonal voting [native: DataFrame functions only]."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.base import ALNUM_WORD, frozen, lower_ascii

#: Words of a rolling gram of phrases and short templates, and of templates from LONG words on.
SHORT_GRAM, LONG_GRAM, LONG = 2, 3, 8
#: Diagonals this near to each other are one alignment: so many words may be inserted or left out. A span may be longer than its template by one word in SLACK.
NEAR_DIAGONALS, SLACK = 3, 10

# Phrases that name a license, and passages of public licenses and their notices, with their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-text", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-text", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-text", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-text", "licensed under the apache license version 2 0"),
    ("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-text", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-notice", "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit-notice", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-text", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-text", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib-text", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost-text", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("warranty", "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("rights-reserved", "all rights reserved"),
]


def words_of(text):
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def n_words(text):
    """Their number, without making them or folding case."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ALNUM_WORD)).cast("long")


def known_templates(phrases=None, templates=None) -> list[tuple[int, str, bool, int, list[str]]]:
    """(number, label, exact, words of a gram, words) of all phrases and templates."""
    every = [(*p, True) for p in phrases or PHRASES] + [(*t, False) for t in templates or TEMPLATES]
    split = [(label, exact, re.findall("[a-z0-9]+", text)) for label, text, exact in every]
    return [(i, label, exact, LONG_GRAM if len(words) >= LONG and not exact else SHORT_GRAM, words) for i, (label, exact, words) in enumerate(split)]


def template_grams(spark, known) -> DataFrame:
    """(template, label, exact, k, n, t_pos, gram): a few hundred rows, one for each place of each template."""
    rows = [(i, label, exact, k, len(words), at, " ".join(words[at : at + k])) for i, label, exact, k, words in known for at in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, k int, n int, t_pos int, gram string")


def matches(docs: DataFrame, known, min_share: float = 0.6) -> DataFrame:
    """(doc_id, text_hash, label, exact, begin, n, hits, share): verified places of templates in documents.

    ``docs`` has doc_id, text_hash and words.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, known)
    # the templates are a constant of this module, so the hashes are a few hundred literals and the broadcast side as many rows, whatever the input
    hashes = {k: sorted({r["hash"] for r in _gram_hashes(spark, sorted({" ".join(w[i : i + k]) for *_, size, w in known if size == k for i in range(len(w) - k + 1)}))}) for k in (SHORT_GRAM, LONG_GRAM)}
    none = F.expr("cast(array() as array<struct<k:int,pos:int,gram:string>>)")

    def found(own, k: int):
        places = F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k)).otherwise(F.expr("cast(array() as array<int>)"))
        hit = F.filter(places, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(k)]).isin(hashes[k]))
        return F.transform(hit, lambda i: F.struct(F.lit(k).alias("k"), i.alias("pos"), F.concat_ws(" ", *[F.get("words", i + j) for j in range(k)]).alias("gram")))

    # words are hashed once, grams are hashed from their words' hashes, and only places whose hash is a template's leave their document
    hashed = F.get(F.transform(F.array(F.transform("words", lambda w: F.xxhash64(w))), lambda h: F.concat(found(h, SHORT_GRAM), found(h, LONG_GRAM))), 0)
    rolled = docs.select("doc_id", "text_hash", F.explode(F.coalesce(hashed, none)).alias("g")).select("doc_id", "text_hash", "g.k", "g.pos", "g.gram")
    votes = rolled.join(F.broadcast(grams), ["k", "gram"]).select("doc_id", "text_hash", "template", "label", "exact", "k", "n", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    # one row a diagonal: a template's places on it, as a sum over distinct template positions
    diagonals = votes.groupBy("doc_id", "text_hash", "template", "label", "exact", "k", "n", "diagonal").agg(F.count_distinct("t_pos").alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    # both kinds of templates are read from here, so the texts are scanned once
    diagonals = frozen(diagonals, "license-diagonals").withColumn("all", F.col("n") - F.col("k") + 1)
    key = ["doc_id", "text_hash", "template"]
    # a diagonal with all its votes is verified on its own, so repetitions back to back stay apart
    whole = diagonals.where("hits = all").select("doc_id", "text_hash", "label", "exact", F.col("diagonal").cast("long").alias("begin"), "n", F.col("hits").cast("long").alias("hits"), F.lit(1.0).alias("share"))
    # neighbouring diagonals whose votes lie close make one alignment
    order = Window.partitionBy(*key).orderBy("first", "diagonal")
    loose = diagonals.where("not exact and hits < all")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > NEAR_DIAGONALS) | (F.col("first") - F.lag("last").over(order) > F.col("n"))
    islands = loose.withColumn("island", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    merged = islands.groupBy(*key, "label", "k", "n", "all", "island").agg(F.min("first").cast("long").alias("begin"), F.max("last").alias("end"), F.sum("hits").cast("long").alias("hits"))
    # a span is verified if it holds enough of the template's grams and is hardly longer than the template
    share = F.least(F.lit(1.0), F.col("hits") / F.col("all"))
    sound = (share >= min_share) & (F.col("end") - F.col("begin") + F.col("k") <= F.col("n") + F.greatest(F.lit(2 * NEAR_DIAGONALS), F.floor(F.col("n") / SLACK)))
    merged = merged.withColumn("share", share).where(sound).select("doc_id", "text_hash", "label", F.lit(False).alias("exact"), "begin", "n", "hits", "share")
    return whole.unionByName(merged)


def _gram_hashes(spark, grams: list[str]) -> list:
    """(hash) of each gram, from its words' hashes as in the documents."""
    rows = spark.createDataFrame([(g.split(" "),) for g in grams], "words array<string>")
    size = len(grams[0].split(" ")) if grams else 1
    return rows.select(F.xxhash64(*[F.xxhash64(F.get("words", j)) for j in range(size)]).alias("hash")).collect()


def scan(docs: DataFrame, phrases=None, templates=None, min_share: float = 0.6) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    All grams of consecutive words (A-Z as a-z; three of long templates, else two) are
    joined to the places of the templates, by their hash first and then by the words
    themselves. Every match votes for the diagonal (place in the document less place
    in the template). A phrase stands where its diagonal has all its votes, and so
    does a license text. Otherwise the votes of a text's neighbouring diagonals with
    close places are merged, and the span is verified: at least ``min_share`` of the
    template's grams, hardly longer than it. A label may have several templates.
    ``score`` is the best verified share; ``spans`` lists (label, begin word, words).

    Votes are summed before any window; a window covers one document and template.
    Null and empty texts have no words, no labels (empty strings) and score 0; a
    very long text is scanned whole; rows equal in doc_id and text share one result
    and appear as often as they came; a null doc_id is kept; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("n_words"))
    # equal rows would vote twice on one diagonal; distinct template positions make that harmless
    found = matches(rows, known_templates(phrases, templates), min_share)
    base = F.when(F.col("exact"), F.col("label"))
    per_doc = found.groupBy("doc_id", "text_hash").agg(
        F.count(base).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("begin"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("begin"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("label", "begin", "n"))).alias("spans"),
    )
    per_doc = frozen(per_doc, "license-matches").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    out = sized.join(per_doc, sized["doc_id"].eqNullSafe(per_doc["__id"]) & sized["text_hash"].eqNullSafe(per_doc["__hash"]), "left")
    return out.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
