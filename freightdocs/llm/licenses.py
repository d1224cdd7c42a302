"""License scan by a positional index of rare licence words. Column expressions and joins only.

The index posts every word of each template with its places and its rank by inverse document frequency over the whole corpus.
Each file looks up its own rarest words: of a template with ``n`` words an accepted place agrees in at least ``need`` of them,
all of which stand in the file; so of the ``c`` places whose word the file holds, the ``c - need + PAIR`` rarest are looked up,
and at least ``PAIR`` of those agree at every accepted place. Their postings are intersected by relative position (place in
text - place in template); offsets on which ``PAIR`` meet are candidates. Last, the wording and the mandatory phrase of each
candidate are verified on the file's words. A file with fewer than ``need`` places of every template looks nothing up. Document
frequencies only choose which words are looked up, never what is accepted: the result of one text does not depend on the others.

The three base phrases are counted besides, wherever their words follow each other.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs.llm.common import narrow, written
from freightdocs.llm.secrets import LOWER, UPPER, let

#: Base phrases with their labels, in the order of the labels' definition.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label, public licence wording in lower-case words, mandatory phrase.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files the software to deal in the software without restriction", "hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "commons attribution 4 0"),
)
#: The share of equal places that an offset needs, and how many looked-up words have to meet on it.
SHARE, PAIR = 0.6, 2
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def need(template: str) -> int:
    """Agreeing words that an accepted place has at least."""
    return ceil(len(template.split()) * SHARE - 1e-9)


def vocabulary() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def index(frequency: dict[str, int]) -> list[tuple[int, int, int, str]]:
    """``(template, rank, place, word)`` for all words of each template; rank 1 has the highest IDF, ties go to the first place."""
    out = []
    for k, (_, t, _) in enumerate(TEMPLATES):
        rare = sorted(enumerate(t.split()), key=lambda x: (frequency.get(x[1], 0), x[0]))
        out += [(k, r, place, word) for r, (place, word) in enumerate(rare, 1)]
    return out


def license_words(text: Column) -> Column:
    """Words of the text, A-Z lowered, without the empty parts that a separator at an end leaves."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT, -1), lambda w: w != "")


def phrase_places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words start to follow each other."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == p)
        return out

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)) \
        .otherwise(F.array().cast("array<int>"))


def _held(mine: Column, words: list[str]) -> Column:
    """Those of ``words``, repeats included, that are among the distinct words ``mine``."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(mine, w))


def _scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, _id, _tag, n_words, base, mine, own``: base places with labels, the distinct licence words, and all words of texts
    that hold enough of them for some template."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    place = "array<struct<at:int,label:string>>"

    def enough(mine: Column) -> Column:
        out = F.lit(False)
        for _, t, _ in TEMPLATES:
            out = out | (F.size(_held(mine, t.split())) >= need(t))
        return out & (F.size(mine) >= min(need(t) for _, t, _ in TEMPLATES) - 1)

    def read(words: Column) -> Column:
        base = F.flatten(F.array(*[_labelled(phrase_places(words, p), label) for label, p in PHRASES])).cast(place)
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        F.when(F.array_contains(words, "license"), base).otherwise(F.array().cast(place)).alias("base"),
                        let(F.array_intersect(known, words), lambda mine: F.struct(
                            mine.alias("mine"), F.when(enough(mine), words).alias("own"))).alias("found"))

    rows = narrow(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"), F.xxhash64("text").alias("_tag"),
        let(license_words(F.col("text")), read).alias("s"))
    return written(rows.select("doc_id", "_id", "_tag", "s.n_words", "s.base", "s.found.*"), "license-rows")


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("int").alias("at"), F.lit(label).alias("label")))


def _cutoffs(mine: Column, posted: list[tuple[int, int, int, str]]) -> Column:
    """For each template the rank of the last word that a file with the words ``mine`` looks up; 0 for none."""
    def cutoff(k: int, least: int) -> Column:
        ranked = F.array(*[F.lit(w) for template, _, _, w in posted if template == k])
        ranks = F.filter(F.transform(ranked, lambda w, i: F.when(F.array_contains(mine, w), i + 1)), lambda r: r.isNotNull())
        return let(ranks, lambda r: F.when(F.size(r) >= least, F.get(r, F.size(r) - least + PAIR - 1)).otherwise(F.lit(0)))

    return F.array(*[cutoff(k, need(t)) for k, (_, t, _) in enumerate(TEMPLATES)])


def _accepted(rows: DataFrame) -> DataFrame:
    """``_id, _tag, accepted``: label and share of each candidate offset that holds."""
    # one count for each word of the templates, whatever the corpus
    frequency = {r.word: r["count"] for r in rows.select(F.explode("mine").alias("word")).groupBy("word").count().collect()}
    posted = index(frequency)
    table = F.broadcast(rows.sparkSession.createDataFrame(posted, "template int, rank int, place int, word string"))  # the templates' words
    texts = rows.filter("own IS NOT NULL").select("_id", "_tag", "own", "mine")
    # the cutoffs stand below the generator: once for each text, not for each word
    cut = texts.select("_id", "_tag", "own", _cutoffs(F.col("mine"), posted).alias("cutoffs"))
    lookups = cut.select("_id", "_tag", F.posexplode("own").alias("at", "word"), "cutoffs")
    votes = lookups.filter(F.col("word").isin(*vocabulary())).join(table, "word").filter(F.col("rank") <= F.get("cutoffs", F.col("template")))
    offsets = votes.groupBy("_id", "_tag", "template", (F.col("at") - F.col("place")).alias("offset")).count().filter(F.col("count") >= PAIR)
    per_text = offsets.groupBy("_id", "_tag").agg(F.collect_list(F.struct("template", "offset")).alias("at"))

    wording = F.array(*[F.struct(F.lit(label).alias("label"), F.split(F.lit(t), " ").alias("words"), F.lit(f" {p} ").alias("phrase"))
                        for label, t, p in TEMPLATES])

    def judged(c: Column) -> Column:
        def of(t: Column) -> Column:
            begin = F.greatest(c["offset"], F.lit(0))
            part = F.slice(F.col("own"), begin + 1, F.greatest(F.lit(0), F.size(t["words"]) + c["offset"] - begin))
            same = F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1),
                                   lambda i: F.coalesce(F.get(F.col("own"), c["offset"] + i) == F.get(t["words"], i), F.lit(False))))
            return F.struct(t["label"].alias("label"), (same / F.size(t["words"])).alias("share"),
                            F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" ")).contains(t["phrase"]).alias("phrase"))
        return let(F.get(wording, c["template"]), of)

    held = texts.drop("mine").join(per_text, ["_id", "_tag"]).select("_id", "_tag", F.filter(
        F.transform("at", judged), lambda j: j["phrase"] & (j["share"] >= SHARE)).alias("accepted"))
    return held.filter(F.size("accepted") > 0).groupBy("_id", "_tag").agg(F.first("accepted").alias("accepted"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, accepted`` of every row of ``docs(doc_id, text, ..)``.

    ``base``: array of ``(at, label)``, the places of the base phrases; ``accepted``: array of ``(label, share, phrase)``,
    the template places that hold (null if none). Null and empty texts have no words. Rows that repeat id and text come out
    alike. An empty table gives an empty table; other columns are left out.
    """
    rows = _scanned(docs)
    return rows.drop("own", "mine").join(_accepted(rows), ["_id", "_tag"], "left").select("doc_id", "n_words", "base", "accepted")


def digest(found: DataFrame) -> DataFrame:
    """One line for each document. ``score``: best share of an accepted place; 0.5 for a base phrase alone; else 0."""
    at = F.transform("base", lambda b: b["at"])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    more = F.coalesce(F.transform("accepted", lambda a: a["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("accepted", lambda a: a["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"))
