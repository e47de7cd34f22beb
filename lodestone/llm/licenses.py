"""License scans: a positional index of rare licence words, in DataFrame expressions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind, fresh

#: The base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and grants of well-known licences, as words. (label, words, phrases that must stand in the text)
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("distributed on an as is basis",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("may be used to endorse or promote products",)),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ("copy of the mpl",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation covered by this license",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
)
WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Shifts of up to so many words between a template's words are still one place.
SLACK = 8
#: Part of a template's weight that one place must hold.
LEAST = 0.6
#: Licence words that a file is looked up by, at least: the upper half of its own by IDF, or so many if that is fewer.
LOOKED_UP = 8
#: Positions in a template are below this number, and starts of places above its negative.
MOST_POSITIONS = 4096


def _padded(text: Column) -> Column:
    """'# w0 w1 ... ' in lower case: a space before and after every word.

    Lower-casing more than A-Z can't make or break a phrase: none of their letters arises from another character as a
    whole word.
    """
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, " "))
    return F.concat(F.lit("# "), F.lower(words), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _index(templates) -> dict[str, list[tuple[int, int]]]:
    """Postings: word -> (template, position)."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(templates):
        for p, w in enumerate(words.split()):
            found.setdefault(w, []).append((t, p))
    return found


def word_rarity(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, float]:
    """IDF of the words over all documents: one grouped sum, at most as many rows as words."""
    seen = F.array_distinct(F.filter(F.split(_padded(F.col(text)), " "), lambda w: w.isin(words)))
    counts = docs.select(F.explode(F.concat(seen, F.array(F.lit("#")))).alias("w")).groupBy("w").count().collect()
    n = {r.w: r["count"] for r in counts}
    return {w: math.log((n.get("#", 0) + 1) / (n.get(w, 0) + 1)) for w in words}


def licence_words(templates, idf: dict[str, float]) -> dict[str, float]:
    """The words that files are looked up by: those at or above the median IDF of a template's words."""
    rare = {}
    for _, text, _ in templates:
        words = set(text.split())
        middle = sorted(idf[w] for w in words)[len(words) // 2]
        rare |= {w: idf[w] for w in words if idf[w] >= middle}
    return rare


def _literal(value, kind: str) -> Column:
    """A constant of nested arrays and structs, as one literal of the plan however many templates there are."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _places(hits: Column, templates, rare: dict[str, float]) -> Column:
    """struct(found, best): the places where a template has LEAST of its weight, and the largest share of any place.

    ``hits``: array of (w, p), the file's licence words. Those at or above the file's own cut of IDF are looked up in the
    postings, word -> (IDF, template positions); each posting votes for the place p - template position, cut into places
    of 2 * SLACK words in two grids that overlap by half. A template position counts once at a place, and a template's
    whole weight is that of its words at or above the cut. One sorted pass sums the votes of all templates.
    ``found``: (template * 2 + grid) * 2^34 + place.
    """
    postings = _index(templates)
    index = _literal({w: {"idf": rare[w], "at": [{"t": t, "q": q} for t, q in postings[w]]} for w in sorted(rare)}, "map<string,struct<idf:double,at:array<struct<t:int,q:int>>>>")
    weights = _literal([[rare.get(w, 0.0) for w in text.split()] for _, text, _ in templates], "array<array<double>>")

    def counted(known: Column, cut: Column, totals: Column) -> Column:
        def vote(p: Column, at: Column, grid: int) -> Column:
            place = F.floor((p - at["q"] + F.lit(grid * SLACK + MOST_POSITIONS)) / F.lit(2 * SLACK))
            return ((at["t"].cast("long") * 2 + grid) * 2**34 + place) * MOST_POSITIONS + at["q"]

        chosen = F.filter(known, lambda x: x["e"]["idf"] >= cut)
        votes = F.flatten(F.transform(chosen, lambda x: F.flatten(F.transform(x["e"]["at"], lambda a: F.array(vote(x["p"], a, 0), vote(x["p"], a, 1))))))
        zero = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("sum"), F.lit(False).alias("told"), F.array().cast("array<bigint>").alias("found"), F.lit(0.0).alias("best"))

        def step(s: Column, code: Column) -> Column:
            at = F.shiftright(code, 12)
            t = F.shiftright(code, 47).cast("int")
            w = F.get(F.get(weights, t), (code % MOST_POSITIONS).cast("int"))
            same = at == s["at"]
            now = F.when(same, s["sum"] + w).otherwise(w)
            share = now / F.get(totals, t)
            enough = share >= LEAST
            told = same & s["told"]
            found = F.when(enough & ~told, F.concat(s["found"], F.array(at))).otherwise(s["found"])
            return F.struct(at.alias("at"), now.alias("sum"), (told | enough).alias("told"), found.alias("found"), F.greatest(s["best"], share).alias("best"))

        return F.aggregate(F.array_sort(F.array_distinct(votes)), zero, step, lambda s: F.struct(s["found"].alias("found"), s["best"].alias("best")))

    def cut_of(known: Column) -> Column:
        own = F.sort_array(F.transform(F.array_distinct(F.transform(hits, lambda x: x["w"])), lambda w: F.element_at(index, w)["idf"]), asc=False)
        return bind(own, lambda o: F.element_at(o, F.least(F.size(o), F.greatest(F.lit(LOOKED_UP), F.ceil(F.size(o) / 2).cast("int")))))

    def totals_of(cut: Column) -> Column:
        return F.transform(weights, lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + F.when(w >= cut, w).otherwise(0.0)))

    known = F.transform(hits, lambda x: F.struct(x["p"].alias("p"), F.element_at(index, x["w"]).alias("e")))
    found = bind(known, lambda k: bind(cut_of(k), lambda c: bind(totals_of(c), lambda t: counted(k, c, t))))
    none = F.struct(F.array().cast("array<bigint>").alias("found"), F.lit(0.0).alias("best"))
    return F.when(F.size(hits) > 0, found).otherwise(none)


def scan_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Finds licence notices and grants in whole texts.

    Words are runs of digits, letters a-z and characters from U+0080 on, A-Z lower-cased. Base phrases are places where
    a phrase's words stand consecutively. For the labels of the method, the words of the templates are weighed by IDF
    over all documents. Each file is looked up by its own licence words of highest IDF (the upper half, LOOKED_UP at
    least); their postings are intersected by relative position. A template counts where one place holds LEAST of
    its weight among such words and its mandatory phrases stand at that place.

    Returns all columns and ``license``: struct(n_words, n_base, first_word, last_word, base_labels, labels, score).
    ``score`` is 1 with a base phrase, else the largest share of a template at one place, halved where no template
    counts. Null and empty texts have no words, null places, empty labels and score 0. Every row has its own result,
    also repeated ones. Nothing is shuffled but the counts of template words.
    """
    rare = licence_words(templates, word_rarity(docs, sorted(_index(templates)), text))
    out, low, n, hits, places = (fresh(docs, c) for c in ("license", "padded", "n_all", "hits", "places"))
    phrases = "|".join(p for p, _ in BASE_PHRASES)
    rows = docs.withColumn(low, _padded(F.col(text)))
    segments = F.split(F.col(low), f"(?= (?:{phrases}) )")
    rows = rows.withColumn(n, F.when(F.length(low) == 3, 0).otherwise(_spaces(F.col(low)) - 1).cast("long"))
    everything = F.transform(F.split(F.col(low), " "), lambda w, p: F.struct(w.alias("w"), (p - 1).cast("long").alias("p")))
    rows = rows.withColumn(hits, F.filter(everything, lambda x: x["w"].isin(sorted(rare))))
    rows = rows.withColumn(places, bind(_places(F.col(hits), templates, rare), lambda x: x))
    lengths = _literal([len(words.split()) for _, words, _ in templates], "array<int>")
    labels = _literal([label for label, _, _ in templates], "array<string>")
    needed = _literal([[f" {x} " for x in phrases] for _, _, phrases in templates], "array<array<string>>")

    def stands(code: Column) -> Column:
        """Whether the mandatory phrases stand at the place: from its start on, the template's words and some more."""
        t = F.shiftright(code, 35).cast("int")
        start = (code % 2**34) * (2 * SLACK) - F.lit(MOST_POSITIONS) - F.when(F.shiftright(code, 34) % 2 == 1, SLACK).otherwise(0)
        words = F.slice(F.split(F.col(low), " "), (F.greatest(start, F.lit(0)) + 2).cast("int"), F.get(lengths, t) + 4 * SLACK)
        return bind(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), lambda x: F.forall(F.get(needed, t), lambda phrase: F.contains(x, phrase)))

    found = F.when(F.size(F.col(places)["found"]) > 0, F.transform(F.filter(F.col(places)["found"], stands), lambda c: F.get(labels, F.shiftright(c, 35).cast("int")))).otherwise(F.array().cast("array<string>"))
    base = F.filter(F.array(*[F.when(F.contains(F.col(low), F.lit(f" {p} ")), F.lit(x)) for p, x in BASE_PHRASES]), lambda x: x.isNotNull())
    best = F.col(places)["best"]
    result = bind(segments, lambda s: bind(found, lambda f: F.struct(
        F.col(n).alias("n_words"),
        (F.size(s) - 1).cast("long").alias("n_base"),
        F.when(F.size(s) > 1, _spaces(s[0])).cast("long").alias("first_word"),
        F.when(F.size(s) > 1, F.col(n) - _spaces(F.element_at(s, -1)) + 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, f))), ",").alias("labels"),
        F.when(F.size(s) > 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.when(F.size(f) > 0, best).otherwise(best / 2))).alias("score"),
    )))
    return rows.withColumn(out, result).drop(low, n, hits, places)


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "license.*")
