"""Licence notices in sentence texts: a trained paragraph classifier whose predictions templates confirm."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingotide.llm.common import uniform, whole

# Usual wordings of public licences, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is available under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "This software is released under the Apache License 2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU General Public License, version 2",
        "Released under the GPL, version 3",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3",
        "Released under the terms of the GNU Affero General Public License",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
    ],
    "bsd": [
        "Released under the BSD License",
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
    ],
    "all-rights-reserved": [
        "All rights reserved",
        "Copyright by the author. All rights reserved",
        "No part of this publication may be reproduced without prior written permission of the publisher",
    ],
}
# Sentences with the same words that are no notices.
NEAR_MISSES = [
    "He lost his driving license under the bridge", "The museum released a new version of its public program",
    "The rights of all people", "Students of MIT work on free software", "The general public was reserved",
    "Apache is the name of a people", "She asked for permission to use the library", "A copy of this work is in the library",
    "The version of the story told by the author", "Public transport is free of charge for any person", "The source of the river lies under the hill",
    "Under the terms of the treaty the land was granted", "All seats are reserved", "He was released under the condition that he leaves",
]
# Words that name a licence or its terms, at least two in each template. They are cues however common they are, and a line
# with two of them may be a notice, so it is no example without one.
NAMES = set(
    """mit apache gnu gpl lgpl agpl lesser affero mozilla mpl bsd cc cc0 creative commons sharealike noncommercial license licensed version
    domain hereby granted redistribution binary copyright waived rights reserved publication reproduced""".split()
)
FAMILIES = list(TEMPLATES)
UNKNOWN = "unknown"
# paragraphs drawn from the texts as examples without a notice
SAMPLE = 2000
# a word in more than this share of all paragraphs without a notice says nothing about notices
COMMON = 0.005
# share of the paragraphs without a notice that the threshold lets through, where it is between these two
PASSED, LEAST, MOST = 0.001, 0.5, 0.9
# share of a template's word pairs that a paragraph must hold to confirm its family
CONFIRM = 0.6
WORD = r"[a-z0-9]+"


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


# words of the longest template, as far as a wrapped notice can reach
REACH = max(len(_words(t)) for texts in TEMPLATES.values() for t in texts)


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def template_words() -> set[str]:
    return {w for texts in TEMPLATES.values() for t in texts for w in _words(t)}


@dataclass(frozen=True)
class LicenceModel:
    """Weights per n-gram and class (families, then unknown), biases and temperature."""

    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float

    @property
    def cues(self) -> list[str]:
        """Words of which every n-gram with a weight holds one: without them a paragraph is unknown for certain."""
        return sorted({w for w in self.weights if " " not in w})


def _examples() -> tuple[list[set[str]], list[int]]:
    """Templates whole and cut at either end, as notices are often quoted in part or with more around them."""
    x, y = [], []
    for family, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            words = _words(text)
            cuts = {(0, len(words)), (0, max(3, len(words) - 2)), (min(2, len(words) - 3), len(words)), (0, max(3, 2 * len(words) // 3))}
            for a, b in sorted(cuts):
                x.append(_grams(words[max(0, a) : b]))
                y.append(family)
    return x, y


def fit_licences(paragraphs: list[str], common: set[str] | None = None) -> LicenceModel:
    """Sparse softmax regression on templates, near misses and ``paragraphs`` of the texts at hand.

    N-grams count only if they hold a word that is not in ``common`` (by default what is common in ``paragraphs``) or is one of
    ``NAMES``; small weights become zero each step (L1). Drawn paragraphs that hold most of a template or two of
    ``NAMES`` are left out, since they may be notices. The temperature is the one that fits every third
    example best, which the weights have not seen; the threshold lets at most one in a thousand examples without notice through.
    """
    drawn = [_grams(_words(p)) for p in paragraphs]
    pairs = [{g for g in _grams(_words(t)) if " " in g} for texts in TEMPLATES.values() for t in texts]
    drawn = [g for g in drawn if g and len(g & NAMES) < 2 and not any(len(g & t) >= CONFIRM * len(t) for t in pairs)]
    x, y = _examples()
    if common is None:
        common = {w for w in template_words() if sum(w in g for g in drawn) > COMMON * len(drawn)}
    rare = {w for g in x for w in g if " " not in w} - (common - NAMES)
    vocabulary = sorted(g for g in set().union(*x) if any(w in rare for w in g.split(" ")))
    place = {g: i for i, g in enumerate(vocabulary)}
    none = [_grams(_words(s)) for s in NEAR_MISSES] + drawn
    x, y = x + none, np.array(y + [len(FAMILIES)] * len(none))
    # all drawn paragraphs together weigh as much as the templates
    mass = np.array([1.0] * (len(x) - len(drawn)) + [max(0.02, len(FAMILIES) * 3 / max(1, len(drawn)))] * len(drawn))
    rows = np.zeros((len(x), len(vocabulary) + 1))
    for i, grams in enumerate(x):
        rows[i, [place[g] for g in grams if g in place]] = 1.0
    rows[:, -1] = 1.0
    fit = np.ones(len(x), dtype=bool)
    fit[2::3] = False
    fit[[i for i, g in enumerate(x) if y[i] < len(FAMILIES) and len(g) < 6]] = True
    target = np.eye(len(FAMILIES) + 1)[y]

    def train(used: np.ndarray) -> np.ndarray:
        w, r, t, m = np.zeros((rows.shape[1], len(FAMILIES) + 1)), rows[used], target[used], mass[used][:, None]
        for _ in range(400):
            p = np.exp(r @ w - (r @ w).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= 0.5 * r.T @ ((p - t) * m) / m.sum() * 10
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 0.002, 0)
        return w

    def proba(w: np.ndarray, temperature: float) -> np.ndarray:
        z = rows @ w / temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    partial = train(fit)
    held = ~fit
    grid = [0.3, 0.5, 0.7, 1.0, 1.4, 2.0]
    losses = [-(mass[held] * np.log(proba(partial, t)[held, y[held]] + 1e-12)).sum() for t in grid]
    temperature = grid[int(np.argmin(losses))]
    w = train(np.ones(len(x), dtype=bool))
    seen = proba(w, temperature)[y == len(FAMILIES), :-1].max(1)
    threshold = float(np.clip(np.quantile(seen, 1 - PASSED), LEAST, MOST))
    weights = {g: [round(float(v), 4) for v in w[i]] for g, i in place.items() if np.abs(w[i]).max() > 0}
    # a cue must be found by itself, so every rare word of a weighted n-gram is listed
    for gram in list(weights):
        for word in gram.split(" "):
            if word in rare:
                weights.setdefault(word, [0.0] * (len(FAMILIES) + 1))
    return LicenceModel(weights, [round(float(v), 4) for v in w[-1]], temperature, threshold)


def draw_paragraphs(texts: DataFrame, sample: int = SAMPLE) -> list[str]:
    """One paragraph each of at most ``sample`` texts, those with the smallest hash of their id."""
    lines = F.filter(F.split(whole("text"), "\n"), lambda p: p != "")
    # only about twice as many rows as are drawn take part in the ordering, whatever the table's size
    share = min(1.0, 2.0 * sample / max(1, texts.count()))
    some = texts.select("id", lines.alias("lines"), uniform("id", 31).alias("u")).filter((F.col("u") < share) & (F.size("lines") > 0))
    one = F.element_at("lines", (F.pmod(F.xxhash64("id"), F.size("lines")) + 1).cast("int"))
    drawn = some.select(one.alias("p"), "u", "id").orderBy("u", "id", "p").limit(sample)
    return [r["p"] for r in drawn.select("p").collect()]


def _literal(values: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in values])


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), 0)


class _Scorer:
    """Column expressions of a model: which lines hold a cue, and the odds of each class for a list of words."""

    def __init__(self, model: LicenceModel) -> None:
        grams = sorted(model.weights)
        self.model = model
        self.table = F.map_from_arrays(F.array(*map(F.lit, grams)), _literal([model.weights[g] for g in grams]))
        # cue words are plain lower-case words and numbers, so no character needs quoting
        self.cue = "(?i)(?<![a-z0-9])(?:" + "|".join(model.cues) + ")(?![a-z0-9])"

    def odds(self, words: Column) -> Column:
        """struct<pairs, z, top, at>: word pairs, logits, the largest of them and its place from 1."""

        def pairs(w: Column) -> Column:
            nexts = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
            return F.array_distinct(F.filter(F.zip_with(w, nexts, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull()))

        def logits(w: Column, p: Column) -> Column:
            hits = F.filter(F.transform(F.concat(F.array_distinct(w), p), lambda g: F.element_at(self.table, g)), lambda v: v.isNotNull())
            zero = F.array(*[F.lit(b) for b in self.model.bias])
            return F.aggregate(hits, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))

        def with_top(s: Column) -> Column:
            top = F.array_max(s["z"])
            at = F.array_position(s["z"], top).cast("int")
            return F.struct(s["p"].alias("pairs"), s["z"].alias("z"), top.alias("top"), at.alias("at"))

        return _let(_let(words, lambda w: _let(pairs(w), lambda p: F.struct(p.alias("p"), logits(w, p).alias("z")))), with_top)

    def mass(self, s: Column, z: Column) -> Column:
        return F.exp((z - s["top"]) / self.model.temperature)

    def total(self, s: Column) -> Column:
        return F.aggregate(s["z"], F.lit(0.0), lambda acc, z: acc + self.mass(s, z))


def licence_spans(text: Column, model: LicenceModel) -> Column:
    """array<struct<family, start, end, score, similarity>> of the lines that hold a notice, in order.

    Notices may be wrapped: besides each line, runs of lines without an empty one between them are scored, as far as a
    template can reach. Of runs that overlap, a family is reported for the one most like its template, then the shortest. A run may
    name several families: another one needs, besides its likeness, half the word pairs that tell it from those found.
    ``family`` is ``unknown`` where a notice is likely but no template of the likeliest family confirms it.
    """
    scorer = _Scorer(model)
    names = F.array(*[F.lit(f) for f in [*FAMILIES, UNKNOWN]])
    pairs_of = [[sorted(g for g in _grams(_words(t)) if " " in g) for t in TEMPLATES[f]] for f in FAMILIES]
    templates = F.array(*[F.array(*[F.array(*map(F.lit, t)) for t in ts]) for ts in pairs_of])
    telling = F.array(*map(F.lit, sorted({g for ts in pairs_of for t in ts for g in t})))
    out = "array<struct<rank:int,unlike:double,n:int,against:double,i:int,j:int,family:string>>"

    def runs(lines: Column) -> Column:
        """array<struct<i, j>>: lines with a cue alone, and runs that hold one, from line i to j."""

        def from_line(marks: Column, i: Column) -> Column:
            near = F.slice(marks, i + 1, F.lit(REACH + 2))
            here = F.get(near, F.lit(0))
            steps = F.sequence(F.lit(1), F.size(near) - 1)

            def together(m: Column, k: Column) -> Column:
                between = F.aggregate(F.slice(m, F.lit(2), k - 1), F.lit(0), lambda acc, c: acc + c["n"])
                held = F.slice(m, F.lit(1), k + 1)
                return (between < REACH) & F.forall(held, lambda c: c["n"] > 0) & F.exists(held, lambda c: c["cue"])

            some = (here["n"] > 0) & (F.size(near) > 1) & F.exists(near, lambda c: c["cue"])
            more = F.when(some, _let(near, lambda m: F.filter(steps, lambda k: together(m, k)))).otherwise(F.array().cast("array<int>"))
            alone = F.when(here["cue"], F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
            return F.transform(F.concat(alone, more), lambda k: F.struct(i.alias("i"), (i + k).alias("j")))

        marks = F.transform(lines, lambda p: F.struct(F.regexp_count(F.lower(p), F.lit(WORD)).alias("n"), p.rlike(scorer.cue).alias("cue")))
        return _let(marks, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: from_line(m, i))))

    def words(lines: Column, r: Column) -> Column:
        """Words of a run; of its first and last line only those that a template across the lines can hold."""
        length = r["j"] - r["i"]

        def part(p: Column, k: Column) -> Column:
            def cut(w: Column) -> Column:
                tail = F.slice(w, F.greatest(F.size(w) - REACH + 1, F.lit(1)), F.lit(REACH))
                return F.when(length == 0, w).when(k == 0, tail).when(k == length, F.slice(w, F.lit(1), F.lit(REACH))).otherwise(w)

            return _let(_words_of(p), cut)

        return F.flatten(F.transform(F.slice(lines, r["i"] + 1, length + 1), part))

    def families(s: Column) -> Column:
        """array<int> of the confirmed families, the likeliest first."""
        none = F.element_at(s["z"], len(FAMILIES) + 1)
        every = F.transform(F.slice(s["z"], 1, len(FAMILIES)), lambda z, k: F.struct(z.alias("z"), (k + 1).alias("at")))
        ordered = F.sort_array(F.filter(every, lambda f: f["z"] > none), asc=False)

        def step(acc: Column, f: Column) -> Column:
            first = F.size(acc["used"]) == 0

            def fits(t: Column) -> Column:
                own = F.array_except(t, acc["used"])
                told = F.size(F.array_intersect(own, s["pairs"]))
                return (F.size(F.array_intersect(t, s["pairs"])) >= CONFIRM * F.size(t)) & (first | ((told > 0) & (told * 2 >= F.size(own))))

            def joined(ok: Column) -> Column:
                used = F.when(ok | first, F.concat(acc["used"], F.flatten(F.element_at(templates, f["at"])))).otherwise(acc["used"])
                return F.struct(F.when(ok, F.concat(acc["out"], F.array(f["at"]))).otherwise(acc["out"]).alias("out"), used.alias("used"))

            return _let(F.exists(F.element_at(templates, f["at"]), fits), joined)

        empty = F.struct(F.array().cast("array<int>").alias("out"), F.array().cast("array<string>").alias("used"))
        return F.aggregate(ordered, empty, step, lambda acc: acc["out"])

    def likeness(s: Column, at: Column) -> Column:
        return F.array_max(F.transform(F.element_at(templates, at), lambda t: F.size(F.array_intersect(t, s["pairs"])) / F.size(t)))

    def notices(r: Column, s: Column) -> Column:
        """The families of a run, each weighed against no notice and the families that are not confirmed."""

        def row(at: Column, family: Column, others: Column, rank: int) -> Column:
            n, like = r["j"] - r["i"], likeness(s, at)
            score = scorer.mass(s, F.element_at(s["z"], at)) / (scorer.total(s) - others)
            return F.struct(
                F.lit(rank).alias("rank"), (-like).alias("unlike"), n.alias("n"), (-score).alias("against"), r["i"].alias("i"), r["j"].alias("j"), family.alias("family")
            )

        def listed(found: Column) -> Column:
            def others(at: Column) -> Column:
                return F.aggregate(F.filter(found, lambda f: f != at), F.lit(0.0), lambda acc, f: acc + scorer.mass(s, F.element_at(s["z"], f)))

            sure = F.transform(found, lambda at: row(at, F.element_at(names, at), others(at), 0))
            return F.when(F.size(found) > 0, sure).otherwise(F.array(row(s["at"], F.lit(UNKNOWN), F.lit(0.0), 1)))

        return F.filter(_let(families(s), listed), lambda n: -n["against"] >= model.threshold)

    def scored(lines: Column, r: Column) -> Column:
        def of(s: Column) -> Column:
            known = F.struct(F.array_intersect(s["pairs"], telling).alias("pairs"), s["z"].alias("z"), s["top"].alias("top"), s["at"].alias("at"))
            return F.when(s["at"] <= len(FAMILIES), _let(known, lambda k: notices(r, k))).otherwise(F.array().cast(out))

        return _let(scorer.odds(words(lines, r)), of)

    def chosen(found: Column) -> Column:
        """The most alike first, then what neither overlaps one of its family nor, if unknown, any."""
        # an unknown notice has no likeness to go by, so the shortest run is the first
        keyed = F.transform(found, lambda n: F.struct(n["rank"].alias("rank"), F.when(n["rank"] == 0, n["unlike"]).otherwise(0.0).alias("by"), n["n"].alias("n"), n["against"].alias("against"), n["i"].alias("i"), n.alias("it")))

        def step(acc: Column, k: Column) -> Column:
            n = k["it"]
            met = F.exists(acc, lambda a: (a["i"] <= n["j"]) & (n["i"] <= a["j"]) & ((a["family"] == n["family"]) | (n["rank"] == 1)))
            return F.when(met, acc).otherwise(F.concat(acc, F.array(n)))

        return F.aggregate(F.array_sort(keyed), F.array().cast(out), step)

    def placed(lines: Column, n: Column) -> Column:
        start = F.aggregate(F.slice(lines, F.lit(1), n["i"]), F.lit(0), lambda acc, p: acc + F.length(p) + 1)
        end = F.aggregate(F.slice(lines, n["i"] + 1, n["j"] - n["i"] + 1), F.lit(-1), lambda acc, p: acc + F.length(p) + 1)
        return F.struct(start.alias("start"), end.alias("length"), n["family"].alias("family"), (-n["against"]).alias("score"), (-n["unlike"]).alias("similarity"))

    def spans(lines: Column) -> Column:
        every = F.flatten(F.transform(runs(lines), lambda r: scored(lines, r)))
        rows = F.array_sort(F.transform(chosen(every), lambda n: placed(lines, n)))
        return F.transform(rows, lambda n: F.struct(n["family"], n["start"], (n["start"] + n["length"]).alias("end"), n["score"], n["similarity"]))

    none = F.array().cast("array<struct<family:string,start:int,end:int,score:double,similarity:double>>")
    return F.when(text.rlike(scorer.cue), _let(F.split(text, "\n"), spans)).otherwise(none)


def _two_names(words: Column) -> Column:
    return F.size(F.array_intersect(words, F.array(*map(F.lit, sorted(NAMES))))) >= 2


def count_words(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """Of all paragraphs but those with two of ``NAMES``: how many there are, and how many hold each word of the templates."""
    lines = texts.select(F.explode(F.split(whole("text"), "\n")).alias("p")).filter("p <> ''")
    known = F.array(*map(F.lit, sorted(template_words() | NAMES)))
    held = lines.select(F.array_intersect(_words_of(F.col("p")), known).alias("w")).filter(~_two_names(F.col("w")))
    # the empty word counts the paragraphs
    rows = held.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def counted_threshold(texts: DataFrame, model: LicenceModel, total: int) -> float:
    """The least score in steps of a hundredth that at most ``PASSED`` of ``total`` paragraphs reach, from all paragraphs
    but those with two of ``NAMES``."""
    scorer = _Scorer(model)
    lines = texts.select(F.explode(F.split(whole("text"), "\n")).alias("p")).filter(F.col("p").rlike(scorer.cue))

    def score(s: Column) -> Column:
        return F.when(s["at"] <= len(FAMILIES), 1 / scorer.total(s)).otherwise(0.0)

    scores = lines.select(_words_of(F.col("p")).alias("w")).filter(~_two_names(F.col("w"))).select(_let(scorer.odds(F.col("w")), score).alias("s"))
    steps = scores.filter(F.col("s") >= LEAST).select(F.floor(F.col("s") * 100).cast("int").alias("step")).groupBy("step").count().collect()
    counts, above = {r["step"]: r["count"] for r in steps}, 0
    for step in range(100, round(LEAST * 100) - 1, -1):
        above += counts.get(step, 0)
        if above > PASSED * total:
            return float(np.clip((step + 1) / 100, LEAST, MOST))
    return LEAST


def fit_to_texts(texts: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """A model fitted on a bounded draw of paragraphs; common words and the threshold are counted over all."""
    total, counts = count_words(texts)
    model = fit_licences(draw_paragraphs(texts, sample), {w for w, n in counts.items() if n > COMMON * total})
    return replace(model, threshold=counted_threshold(texts, model, total))


def scan_licences(texts: DataFrame, model: LicenceModel | None = None, sample: int = SAMPLE) -> DataFrame:
    """Licence notices of sentence texts (id, text): id, licences array<struct<family, start, end, score, similarity>>.

    Spans are whole lines, one or several of a wrapped notice, places code points, ends exclusive. The classifier is fitted on fixed templates and a bounded
    draw of paragraphs, with words and scores counted over all of them; scoring is built-in expressions over whole texts without moving a row. Null and empty texts have
    no notices; repeated rows repeat; ids may be null; other columns are left out.
    """
    model = model or fit_to_texts(texts, sample)
    return texts.select("id", licence_spans(whole("text"), model).alias("licences"))
