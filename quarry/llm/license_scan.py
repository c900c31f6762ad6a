"""Licence scan by a positional rare-token index (operator 12, DataFrame functions only).

The index posts the ``RARE`` highest-IDF words of every licence template with their positions; IDF comes
from the document counts of all licence words over the whole table. For each file and template the
``ANCHORS`` highest-IDF words that the file holds are looked up: an occurrence at word i of a word posted
at q aligns the template with word i - q. There the postings of the template's other rare words are
intersected by relative position (``SLACK`` words of play for inserted or lost ones); an alignment is a
match if the words found carry ``SHARE`` of the rare words' weight and every mandatory key phrase of the
template stands, word for word, near its place. A base phrase is a template of its own with no play and
all words mandatory, so each of its places is found through its rarest word.

Everything happens inside the row: no shuffle, no Python, no bound on text length. Most files hold no
rare licence word and stop after one hash intersection. The one aggregate counts documents per licence
word (at most the distinct words of the templates, pre-aggregated in each task); the templates, which are
fixed, are the only thing sent to the tasks.

Score: the largest matched weight share of a full notice, or 0.5 if only base phrases are found, else 0.

Edge cases: NULL or empty text has 0 words and no labels; repeated rows count as often as they stand; a
NULL ``doc_id`` is kept; existing columns with the names of the results are replaced in ``scan``; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 8
ANCHORS = 3
SLACK = 2
#: Share, in tenths, of the rare words' weight that a match holds.
SHARE = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]


class Template(NamedTuple):
    """A licence text in lower-case words; ``keys`` are phrases of it that a match must hold."""

    label: str
    text: str
    keys: Sequence[str] = ()
    base: bool = False


#: The base phrases, and standard notices of well-known licences in their published wording.
BASE = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
]
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
             "and associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted", "to any person obtaining a copy")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
             "gnu general public license as published by the free software foundation",
             ("gnu general public license", "free software foundation")),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
             "fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
]


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def _held(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``docs`` with ``_n`` (words) and ``_held``, the words of ``vocabulary`` in the text.

    By ``lower``, which is quick but changes letters beyond A-Z too: that moves no word boundary and can
    only add to ``_held`` (the Kelvin sign becomes a k), so it is a filter; places come from exact words.
    """
    quick = docs.withColumn("_q", _split(F.lower(F.coalesce(F.col("text"), F.lit("")))))
    return (quick.withColumn("_held", F.array_intersect("_q", F.lit(vocabulary)))
            .withColumn("_n", F.size("_q").cast("long")).drop("_q"))


def document_counts(docs: DataFrame, templates: Sequence[Template]) -> tuple[int, dict[str, int]]:
    """(documents, {licence word: documents that hold it}); at most one count per word of the templates."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    held = _held(docs.select("text"), vocabulary).select(
        F.explode(F.concat("_held", F.array(F.lit("")))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def postings(templates: Sequence[Template], total: int, counts: dict[str, int], rare: int = RARE) -> list[list[tuple]]:
    """For every template its (word, position, weight) postings, highest IDF first (ties by word).

    A base phrase posts all its words, another template its ``rare`` rarest.
    """
    out = []
    for t in templates:
        words = t.text.split()
        order = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        out.append([(w, words.index(w), 1 + math.floor(1000 * math.log((total + 1) / (counts.get(w, 0) + 1))))
                    for w in (order if t.base else order[:rare])])
    return out


def _literal(templates: Sequence[Template], index: list[list[tuple]], slack: int) -> Column:
    rows = []
    for t, posted in zip(templates, index):
        words = t.text.split()
        keys = [t.text] if t.base else list(t.keys)
        at = []
        for k in keys:
            k = k.split()
            at.append(F.struct(F.lit(next(i for i in range(len(words)) if words[i:i + len(k)] == k)).alias("q"),
                               F.lit(k).alias("words")))
        rows.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(words)).alias("size"),
            F.lit(list(range(1)) if t.base else list(range(-slack, slack + 1))).alias("play"),
            F.array(*[F.struct(F.lit(w).alias("word"), F.lit(q).alias("q"), F.lit(v).cast("long").alias("weight"))
                      for w, q, v in posted]).alias("post"),
            F.lit(sum(v for *_, v in posted)).cast("long").alias("total"),
            F.array(*at).alias("keys")))
    return F.array(*rows)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _weight(posts: Column) -> Column:
    return F.aggregate(F.transform(posts, lambda p: p["weight"]), F.lit(0).cast("long"), lambda total, x: total + x)


def _owned(t: Column) -> Column:
    return F.filter(t["post"], lambda p: F.array_contains("_held", p["word"]))


def _able(templates: Column) -> Column:
    """The templates whose words in the file carry ``SHARE`` of the weight: no other can match anywhere."""
    return F.filter(templates, lambda t: _weight(_owned(t)) * 10 >= t["total"] * SHARE)


def _matches(able: Column, words: Column, anchors: int) -> Column:
    """All matches of a file from its able templates and its words."""
    def starts(own):
        names = F.transform(own, lambda p: p["word"])
        return _let(names, lambda names: F.array_distinct(F.flatten(F.transform(
            F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                     lambda h: F.array_contains(names, h["word"])),
            lambda h: F.transform(F.filter(own, lambda p: p["word"] == h["word"]), lambda p: h["at"] - p["q"])))))

    def stands(t, k, s):
        def phrase(d):
            return F.forall(F.transform(k["words"], lambda w, j: F.get(words, s + k["q"] + d + j).eqNullSafe(w)), lambda x: x)
        return F.exists(t["play"], phrase)

    def aligned(t, s):
        found = _weight(F.filter(t["post"], lambda p: F.exists(
            t["play"], lambda d: F.get(words, s + p["q"] + d).eqNullSafe(p["word"]))))
        return _let(found, lambda found: F.struct(
            t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), t["size"].alias("size"),
            (found / t["total"]).alias("share"),
            ((found * 10 >= t["total"] * SHARE) & F.forall(t["keys"], lambda k: stands(t, k, s))).alias("ok")))

    every = F.flatten(F.transform(able, lambda t: F.transform(
        _let(F.slice(_owned(t), 1, F.when(t["base"], F.lit(1)).otherwise(F.lit(anchors))), starts),
        lambda s: aligned(t, s))))
    return F.filter(every, lambda m: m["ok"])


def scan(docs: DataFrame, notices: Sequence[Template] = NOTICES, base: Sequence[Template] = BASE, rare: int = RARE,
         anchors: int = ANCHORS, slack: int = SLACK) -> DataFrame:
    """``docs`` with the licences of every whole ``text``.

    Adds ``n_words, n_base, first_word, last_word`` (long), ``base_labels, labels, score`` and ``matches``:
    (label, base, start, size, share) of every aligned template, ``start`` in words from 0.
    """
    templates = [*base, *notices]
    index = postings(templates, *document_counts(docs, templates), rare)
    vocabulary = sorted({w for posted in index for w, *_ in posted})
    kept = [c for c in docs.columns if c not in RESULTS]
    held = _held(docs.select(*kept), vocabulary).withColumn("_a", _able(_literal(templates, index, slack)))
    exact = held.withColumn("_w", F.when(
        F.size("_a") > 0, _split(F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER))))
    empty = "array<struct<label:string,base:boolean,start:int,size:int,share:double,ok:boolean>>"
    found = exact.withColumn("_m", F.when(F.size("_a") > 0, _matches(F.col("_a"), F.col("_w"), anchors))
                             .otherwise(F.array().cast(empty)))
    own = F.filter("_m", lambda m: m["base"])
    full = F.filter("_m", lambda m: ~m["base"])
    at = F.transform(own, lambda m: m["start"])

    def names(ms):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")

    score = F.greatest(F.coalesce(F.array_max(F.transform(full, lambda m: m["share"])), F.lit(0.0)),
                       F.when(F.size(own) > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return found.select(
        *kept, F.col("_n").alias("n_words"), F.size(own).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        names(own).alias("base_labels"), names(F.col("_m")).alias("labels"), F.round(score, 6).alias("score"),
        F.transform("_m", lambda m: m.dropFields("ok")).alias("matches"))
