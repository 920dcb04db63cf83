"""License scans by a positional rare-token index, with DataFrame functions only.

The templates are tokenized once into an index: words, their IDF over the templates, and postings (template,
position).  A text that cannot hold any mandatory phrase (none of their longest words, or no phrase with any separators
between its words) has no label; any other is tokenized.  Its ``rarest`` distinct licence words of highest IDF, and
always the rarest words of mandatory phrases, are looked up; a word at position p and a posting at q propose that the
template starts at p - q.  A proposed place is kept where every mandatory word stands at its relative position and the
IDF share of matching words is ``share`` or more.  All of it is an expression over one row: no text is shuffled or
written, the index is a constant of the plan, and a row's proposals are numbers, a few for each looked-up word.

Base phrases are templates of their own whose every word is mandatory, so that all their places count.

Defined results: null, empty or wordless texts have n_words 0, n_base 0, null first_word and last_word, empty label
strings and score 0; equal rows give equal rows; very long texts are tokenized whole; null ids pass through; an empty
table gives an empty one; columns other than doc_id and text are not looked at.
"""
from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a lowered text, and what stands between two words: of a lowered text, and of one whose A-Z are as they were.
#: A class of ranges is matched several times as fast as its complement.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Templates and starts share a number: template * SPAN + start.
SPAN = 1 << 40

#: Phrase and label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label, notice, mandatory phrases (public licence notices).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it", "gnu general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
]


class Index:
    """The constant index over templates and base phrases."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], base: list[tuple[str, str]]) -> None:
        entries = [(label, notice, phrases, False) for label, notice, phrases in templates] + [(label, phrase, [phrase], True) for phrase, label in base]
        self.items = []
        texts = [n.split() for _, n, _, _ in entries]
        df: dict[str, int] = {}
        for words in texts:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        self.idf = {w: round(math.log(1 + len(texts) / n), 6) for w, n in df.items()}
        anchors: set[str] = set()
        for (label, _, phrases, is_base), words in zip(entries, texts):
            spans = []
            for phrase in phrases:
                p = phrase.split()
                at = next(i for i in range(len(words)) if words[i: i + len(p)] == p)
                spans.append((at, p))
                anchors.add(max(p, key=lambda w: (self.idf[w], w)))
            self.items.append((label, words, spans, is_base))
        self.anchors = sorted(anchors)
        self.ranked = sorted(self.idf, key=lambda w: (-self.idf[w], w))


def _constant(index: Index) -> tuple[Column, Column]:
    """The postings (word -> places, each template * SPAN + position) and the items, as constants of the plan."""
    postings: dict[str, list[int]] = {}
    items = []
    for t, (label, words, spans, is_base) in enumerate(index.items):
        for q, w in enumerate(words):
            postings.setdefault(w, []).append(t * SPAN + q)
        total = 0.0
        for w in words:
            total += index.idf[w]
        must = [F.struct(F.lit(at + i).alias("i"), F.lit(w).alias("w")) for at, p in spans for i, w in enumerate(p)]
        items.append(F.struct(
            F.lit(label).alias("label"), F.lit(is_base).alias("is_base"), F.array(*must).alias("must"), F.array(*[F.lit(w) for w in words]).alias("words"),
            F.array(*[F.lit(index.idf[w]) for w in words]).alias("weights"), F.lit(total).alias("total")))
    flat = [x for w, places in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit(p).cast("long") for p in places]))]
    return F.create_map(*flat), F.array(*items)


def _may_hold(low: Column, index: Index) -> Column:
    """Whether a lowered text can hold any mandatory phrase: its longest word somewhere, then the words in a row.

    No text without this can have a label; what passes is tokenized and looked up in the index.
    """
    phrases = sorted({" ".join(p) for _, _, spans, _ in index.items for _, p in spans})
    # a phrase that holds another one is found with it
    phrases = [p for p in phrases if not any(q != p and f" {q} " in f" {p} " for q in phrases)]
    rare = sorted({max(p.split(), key=lambda w: (len(w), w)) for p in phrases})
    some = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in rare])
    return some & low.rlike("|".join(GAP.join(map(re.escape, p.split())) for p in phrases))


def scan(docs: DataFrame, templates: list = TEMPLATES, base: list = BASE, rarest: int = 8, share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each row of docs."""
    index = Index(templates, base)
    postings, items = _constant(index)
    reach = max(len(words) for _, words, _, _ in index.items)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), F.lower(text).alias("_low"), C.n_words(text, RAW_GAP).alias("n_words"))
    words = F.when(_may_hold(F.col("_low"), index), F.array_remove(F.split(F.translate("_text", UPPER, LOWER), GAP, -1), ""))
    rows = rows.select("doc_id", "n_words", F.coalesce(words, F.array().cast("array<string>")).alias("_words"))
    rows = rows.withColumn("_hits", F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("p"))), lambda h: h["w"].isin(index.ranked)))
    ranked, anchors = (F.array(*[F.lit(w) for w in x]) for x in (index.ranked, index.anchors))
    own = F.array_distinct(F.transform("_hits", lambda h: h["w"]))
    rows = rows.withColumn("_own", own)
    rows = rows.withColumn("_chosen", F.array_union(F.slice(F.array_intersect(ranked, "_own"), 1, rarest), F.array_intersect(anchors, "_own")))
    # a word at p and a posting at q propose that the template starts at p - q; a place is template * SPAN + start + reach
    looked_up = F.filter("_hits", lambda h: F.array_contains(F.col("_chosen"), h["w"]))
    proposed = F.transform(looked_up, lambda h: F.transform(F.element_at(postings, h["w"]), lambda x: F.lit(SPAN) * F.floor(x / SPAN) + h["p"] - x % SPAN + reach))
    item = lambda x: F.get(items, F.floor(x / SPAN).cast("int"))
    word = lambda x, i: F.get(F.col("_words"), (x % SPAN - reach + i).cast("int"))
    whole = lambda x: F.forall(item(x)["must"], lambda m: F.coalesce(word(x, m["i"]) == m["w"], F.lit(False)))
    rows = rows.withColumn("_places", F.filter(F.array_distinct(F.flatten(proposed)), whole))
    equal = lambda x: F.transform(item(x)["words"], lambda w, i: F.coalesce(word(x, i) == w, F.lit(False)))
    got = lambda x: F.aggregate(F.zip_with(equal(x), item(x)["weights"], lambda e, v: F.when(e, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    places = F.transform("_places", lambda x: F.struct((x % SPAN - reach).alias("start"), item(x)["label"].alias("label"), item(x)["is_base"].alias("is_base"), (got(x) / item(x)["total"]).alias("share")))
    rows = rows.withColumn("_all", F.filter(places, lambda x: x["is_base"] | (x["share"] >= share)))
    rows = rows.withColumn("_base", F.filter("_all", lambda x: x["is_base"]))
    starts = F.transform("_base", lambda x: x["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    score = F.array_max(F.transform("_all", lambda x: F.when(x["is_base"], F.lit(0.5)).otherwise(x["share"])))
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("_base").alias("base_labels"), labels("_all").alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


QUERIES = {"op9_licenses": op9_licenses}


def _sql(share: float = 0.6) -> str:
    """The same labels by trying every start of every template, in DuckDB's SQL."""
    index = Index(TEMPLATES, BASE)
    places, shares, own, every, scores = [], [], [], [], []
    for t, (label, words, spans, is_base) in enumerate(index.items):
        at_least = -min(at for at, _ in spans)
        word = lambda j: f"(CASE WHEN s + {j} >= 0 THEN w[s + {j + 1}] END)"
        must = " AND ".join(f"coalesce({word(at + i)} = '{x}', false)" for at, p in spans for i, x in enumerate(p))
        places.append(f"list_filter(range({at_least}, len(w)), lambda s: {must}) AS t{t}")
        if is_base:
            own.append((label, t))
            every.append(f"CASE WHEN len(t{t}) > 0 THEN ['{label}'] ELSE [] END")
        else:
            total, got = "0.0::DOUBLE", "0.0::DOUBLE"
            for i, x in enumerate(words):
                total, got = f"({total} + {index.idf[x]}::DOUBLE)", f"({got} + CASE WHEN {word(i)} = '{x}' THEN {index.idf[x]}::DOUBLE ELSE 0.0::DOUBLE END)"
            shares.append(f"list_max(list_filter(list_transform(t{t}, lambda s: {got} / {total}), lambda x: x >= {share})) AS h{t}")
            every.append(f"CASE WHEN h{t} IS NOT NULL THEN ['{label}'] ELSE [] END")
            scores.append(f"coalesce(h{t}, 0.0)")
    all_places = f"list_concat({', '.join(f't{t}' for _, t in own)})" if len(own) > 1 else f"t{own[0][1]}"
    base_labels = f"list_concat({', '.join(f'CASE WHEN len(t{t}) > 0 THEN [{chr(39)}{label}{chr(39)}] ELSE [] END' for label, t in own)})"
    text = lambda x: f"coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, {', '.join(places)} FROM d),
h AS (SELECT *, {', '.join(shares)}, {all_places} AS places FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       {text(base_labels)} AS base_labels, {text(f"list_concat({', '.join(every)})")} AS labels,
       greatest({', '.join(scores)}, CASE WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM h"""


ORACLE = {"op9_licenses": _sql()}
