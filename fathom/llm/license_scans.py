"""License scans by a positional index of rare words.

Licence notices are indexed as postings word -> (template, position). Document
frequencies of the indexed words over the whole corpus give their IDF. Of each
template the highest-IDF words are looked up in every document: the fewest
that together outweigh what a template may lack, so that no place with SHARE
of its weight can be missed. Their postings, shifted by where the words stand,
intersect in places; a place counts once words of enough weight stand at the
template's relative positions there and the template's mandatory phrase stands
in the document.

The index holds as many entries as the templates have words, whatever the
corpus; every place that the postings name is verified, however many there
are. Documents aren't shuffled.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm._common import let, table

#: Characters of words and between them, in a text of any case.
WORD_CHAR, GAP_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases of the base labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: The share of a template's weight that has to meet in one place, and the least number of its words.
SHARE, LEAST_WORDS = 0.6, 3


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words and the phrase without which it doesn't count."""

    label: str
    text: str
    phrase: str

    def words(self) -> list[str]:
        """Words as those of a document: runs without ASCII other than letters and digits, in lower case."""
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", self.text.replace("\u212a", "\u00e9").lower())


TEMPLATES = (
    Template("mit", "Released under the MIT License.", "mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache", "Licensed under the Apache License, Version 2.0.", "apache license"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    Template("cc-by", "Licensed under CC BY 4.0.", "cc by 4 0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "except in compliance with the license"),
    Template("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "without any express or implied warranty"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "eclipse public license"),
    Template("proprietary", "All rights reserved.", "all rights reserved"),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
)


def lowered(text: Column) -> Column:
    """Lower-cased so that words of ASCII letters compare right; the one other character that would become such a letter is put aside first."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))


def words_of(text: Column) -> Column:
    """Words of a lower-cased text; splitting at the gaps is several times faster than extracting."""
    return F.filter(F.split(text, f"{GAP_CHAR}++", -1), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CHAR}++")), F.lit(0)).cast("long")


def phrase_pattern(*phrases: str) -> str:
    """Java regex of places where one of the phrases' words stand consecutively, in any case of A to Z."""
    either = "|".join(f"{GAP_CHAR}++".join(p.split()) for p in phrases)
    return f"(?i)(?<!{WORD_CHAR})(?:{either})(?!{WORD_CHAR})"


def _frequencies(documents: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each of words; at most as many rows as words reach the driver."""
    found = F.array_distinct(F.filter(words_of(lowered(F.coalesce("text", F.lit("")))), lambda w: w.isin(*words)))
    rows = documents.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.get("", 0), {w: counts.get(w, 0) for w in words}


def anchors(words: list[str], weights: dict[str, float]) -> list[int]:
    """Positions of the highest-IDF words of a template that together weigh more than it may lack: a place with SHARE of its weight holds one of them."""
    spare, taken, chosen = (1 - SHARE) * sum(weights[w] for w in words), 0.0, []
    for at in sorted(range(len(words)), key=lambda i: (-weights[words[i]], words[i], i)):
        chosen.append(at)
        taken += weights[words[at]]
        if taken > spare * (1 + 1e-9):
            break
    return chosen


def _constant(value: object, kind: str) -> Column:
    """A nested value as one constant: the optimizer folds it, and the plan has no column for each of its parts."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _places(words: Column, templates: list[list[str]], weights: dict[str, float]) -> Column:
    """Every place where an anchor of a template stands, from the postings of the anchors: t and shift in one long, see _place(), since distinct longs are found by hashing and distinct structs by comparing all pairs."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, own in enumerate(templates):
        for at in anchors(own, weights):
            postings.setdefault(own[at], []).append((t, at))
    index = _constant({w: [{"t": t, "at": at} for t, at in places] for w, places in postings.items()}, "map<string,array<struct<t:bigint,at:int>>>")
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*postings), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    shifted = F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(index, x["w"]), lambda p: p["t"] * F.lit(2**32) + (x["i"] - p["at"] + F.lit(2**31)))))
    return F.array_distinct(shifted)


def _place(code: Column) -> Column:
    """(t, shift) of a place as _places() gives it."""
    return F.struct(F.shiftright(code, 32).cast("int").alias("t"), (code.bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)).cast("int").alias("shift"))


def _shares(words: Column, places: Column, templates: list[list[str]], weights: dict[str, float]) -> Column:
    """(t, share) of each template found: the share of its weight that stands at its relative positions in a place, by all of its words, and of its places the greatest."""
    whole = _constant([[{"w": w, "weight": weights[w]} for w in own] for own in templates], "array<array<struct<w:string,weight:double>>>")
    totals = _constant([sum(weights[w] for w in own) for own in templates], "array<double>")

    def share(place: Column) -> Column:
        own = F.get(whole, place["t"])
        met = F.transform(own, lambda x, j: F.when(F.get(words, place["shift"] + j) == x["w"], x["weight"]))
        total = F.aggregate(met, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, x: F.struct((s["sum"] + F.coalesce(x, F.lit(0.0))).alias("sum"), (s["n"] + x.isNotNull().cast("int")).alias("n")))
        return let(total, lambda s: F.struct(place["t"].alias("t"), F.when(s["n"] >= LEAST_WORDS, F.least(s["sum"] / F.get(totals, place["t"]), F.lit(1.0))).otherwise(0.0).alias("share")))

    met = F.filter(F.transform(F.transform(places, _place), share), lambda x: x["share"] >= SHARE)
    # Of each template the greatest share; one pass a template, so that what follows costs the same however often a notice stands.
    best = lambda found: F.transform(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda t: F.struct(t.alias("t"), F.aggregate(found, F.lit(0.0), lambda m, x: F.when(x["t"] == t, F.greatest(m, x["share"])).otherwise(m)).alias("share")))
    return F.filter(let(met, best), lambda x: x["share"] > 0)


def scan(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of documents (doc_id, text).

    A null or empty text has no words, no place and empty labels. score is 1
    with a base label, else the greatest share of a template found, else 0.
    Repeated rows are scanned each alike; a null doc_id is returned as it is.
    A template needs LEAST_WORDS words or more and a phrase; others raise.
    """
    owns = [t.words() for t in templates]
    if bad := next((t for t, own in zip(templates, owns, strict=True) if len(own) < LEAST_WORDS or not Template("", t.phrase, "").words()), None):
        raise ValueError(f"a template of {LEAST_WORDS} words or more and a phrase expected: {bad}")
    total, counts = _frequencies(documents, sorted({w for own in owns for w in own}) or [""])
    weights = {w: math.log((total + 1) / (n + 1)) + 1e-3 for w, n in counts.items()}
    text = F.coalesce("text", F.lit(""))
    base = phrase_pattern(*BASE.values())
    places = F.when(F.contains(lowered(text), F.lit("license")), F.regexp_count(text, F.lit(base))).otherwise(0).cast("long")
    # The words are bound once: the optimizer would split the text anew for each lambda that names them.
    found = let(words_of(lowered(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), (_shares(w, _places(w, owns, weights), owns, weights) if owns else F.array().cast("array<struct<t:int,share:double>>")).alias("met")))
    rows = documents.select("doc_id", text.alias("text"), places.alias("n_base"), found.alias("found"))
    before_first, before_last = F.split("text", base, 2)[0], F.regexp_extract("text", f"(?s)^(.*){base.removeprefix('(?i)')}".replace("(?s)", "(?si)", 1), 1)
    rows = rows.withColumn("first_word", F.when(F.col("n_base") > 0, count_words(before_first))).withColumn("last_word", F.when(F.col("n_base") > 0, count_words(before_last)))
    base_found = F.array_compact(F.array(*[F.when((F.col("n_base") > 0) & F.col("text").rlike(phrase_pattern(p)), F.lit(label)) for label, p in BASE.items()]))
    labels = F.array(*[F.lit(t.label) for t in templates]) if templates else F.array().cast("array<string>")
    patterns = F.array(*[F.lit(phrase_pattern(" ".join(Template("", t.phrase, "").words()))) for t in templates]) if templates else F.array().cast("array<string>")
    # The mandatory phrase is looked for once words of enough weight have met.
    good = F.filter(F.col("found.met"), lambda x: F.rlike("text", F.get(patterns, x["t"])))
    rows = rows.select("doc_id", F.col("found.n").alias("n_words"), "n_base", "first_word", "last_word", F.array_sort(base_found).alias("base"), good.alias("good"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("good", lambda x: F.get(labels, x["t"]))))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("good", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all of `documents`, with document frequencies over all of them."""
    return scan(table(spark, sf_dir, "documents"))


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL expresses too."""
    return query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_W = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words as arrays; a phrase's words stand consecutively.
BASE_ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}'), []) AS w FROM documents
), p AS (
  SELECT doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl FROM w
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base,
  list_min(list_concat(mit, apache, gpl)) AS first_word, list_max(list_concat(mit, apache, gpl)) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM p
"""
