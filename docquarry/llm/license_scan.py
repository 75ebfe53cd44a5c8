"""Licence scans: a trained paragraph classifier, in DataFrame functions only.

How documents name their licence is fixed text, below: names and notices of families, and the frames that
names stand in.  A multinomial logistic regression over hashed words, word pairs and triples is trained on them
(the model depends on nothing else, so training is plain arithmetic on the driver over some hundreds of short
examples).  Examples of the class ``unknown`` are licences that are none of the families, names with their
telling words replaced, mixed-up words and ordinary sentences.  The probability of ``unknown`` is calibrated
by a temperature chosen on other unseen licences and on frames and mixtures that training hasn't had.

Features are pairs and triples with a telling word, one that neither frames nor ordinary sentences have,
and such words alone where they have ``ALONE`` letters or more.
Every paragraph (line) with a stem of ``STEMS`` in it, of every whole text, is scored; one without a stem or
without a feature has no evidence for any family: it is unknown without arithmetic.

A predicted family is confirmed against its templates, in one of two ways:

* it holds one of the family's names, word for word and one after another, with no negation before it;
* of the words from its first feature to its last, it holds ``CONFIRM`` of those of a notice, and those
  that the notice lacks (numbers aside) come to ``EXTRA`` of the notice's at most, and it holds no other
  family's name.

Statements wrapped over lines are found in windows: a line and those after it, up to a line without
letters and digits, that can hold a notice begun in the line.  Windows are scored as paragraphs are.
Of overlapping windows of a family the one that holds most of a template counts, the latest of equals, and
none that holds a line confirmed for the family.

Null and empty texts have no paragraph, so no licence.  Equal texts get equal results.  Columns of docs keep
their names and values, whatever these are.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import free_name

PLACES, MIN_PROBABILITY, CONFIRM, EXTRA, EPOCHS, RATE, DECAY = 1 << 13, 0.5, 0.6, 0.25, 25, 0.5, 1e-4

#: Letters of a word that is a feature alone.
ALONE = 4

#: Names of licences, by family.
NAMES = {
    "MIT": ("MIT License", "MIT Licence", "Expat License"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache Software License", "Apache 2.0"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL version 3", "GPL version 2", "GPL v3", "GPL v2", "GPLv3", "GPLv2", "GPL 3.0", "GPL 2.0"),
    "LGPL": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL version 2.1", "LGPL 2.1", "LGPL 3.0", "LGPLv3"),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPL version 3", "AGPL 3.0", "AGPLv3"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "3-Clause BSD License", "2-Clause BSD License", "New BSD License", "BSD 3-Clause", "BSD 2-Clause"),
    "ISC": ("ISC License", "ISC Licence"),
    "MPL-2.0": ("Mozilla Public License", "MPL 2.0"),
    "EPL": ("Eclipse Public License", "EPL 2.0", "EPL 1.0"),
    "CC0": ("CC0 1.0", "CC0 license", "Creative Commons Zero", "Creative Commons CC0"),
    "CC-BY": ("CC BY 4.0", "CC BY 3.0", "CC BY license", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution License", "Creative Commons Attribution International"),
    "CC-BY-SA": ("CC BY-SA", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-Share Alike"),
    "CC-BY-ND": ("CC BY-ND", "Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution-NoDerivs"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC license", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 3.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial International"),
    "CC-BY-NC-SA": ("CC BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND": ("CC BY-NC-ND", "Creative Commons Attribution-NonCommercial-NoDerivatives", "Creative Commons Attribution-NonCommercial-NoDerivs"),
    "Proprietary": ("All rights reserved", "Confidential and proprietary"),
}
#: Notices of licences that say it in words of their own, by family.
NOTICES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "Apache-2.0": (
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "LGPL": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "Proprietary": ("Unauthorized copying of this file, via any medium is strictly prohibited", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited"),
}
#: What names stand in.
FRAMES = (
    "{}",
    "Released under the {}",
    "Licensed under {}",
    "Licensed under the {}",
    "This software is licensed under the {}",
    "This work is licensed under a {} International License",
    "This work is licensed under the {}, version 3",
    "It is published on the terms of the {} by the authors",
    "SPDX License Identifier: {}",
    "See the {} for details",
    "Copyright 2019 the authors. {}.",
)
#: What calibration has them stand in.
OTHER_FRAMES = ("The files in this folder are covered by {}", "You can copy it under {}", "License: {} or later", "Copyright (c) 2021 by its makers, {}")
#: Licences that are none of the families; for training and for calibration.
UNSEEN = ("Zope Public License", "Artistic License 2.0", "zlib License", "Boost Software License 1.0", "Common Development and Distribution License", "Microsoft Public License", "Open Software License 3.0", "Creative Commons Sampling Plus License", "Some rights reserved", "All rights released")
OTHER_UNSEEN = ("Python Software Foundation License", "European Union Public Licence 1.2", "SIL Open Font License 1.1", "Academic Free License", "Q Public License", "Sleepycat License", "No rights reserved")
#: Ordinary sentences with words that licences use.
ORDINARY = (
    "The work of the committee is subject to the terms of the agreement",
    "You may obtain a copy of the report at the office",
    "this is the version of the story that you can read and use",
    "He was released under the terms of the court and the law",
    "All members of the public are free to use the park and the source of the river",
    "The driver of the car had a license and all the documents with him",
    "Permission to use the hall was granted by the council",
    "the general public may read the files in the library without charge",
)
FAMILIES = tuple(NAMES)
#: Parts of words one of which every name and notice has, in small letters.
STEMS = ("licen", "gpl", "apache", "bsd", "mpl 2", "mpl-2", "epl 2", "epl-2", "epl 1", "epl-1", "cc by", "cc-by", "cc0", "creative", "reserved", "proprietary", "unauthorized", "permission", "redistribut", "copyright", "source code form")
#: A name after one of these, and four more words at most, is not taken.
NEGATIONS = ("not", "never", "neither", "nor", "no longer", "isn t", "wasn t", "cannot")


def _tokens(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if ("a" <= c <= "z") or ("0" <= c <= "9"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _hash(words: list[str]) -> int:
    """As Spark's xxhash64 of one string."""
    h = xxhash.xxh64_intdigest(" ".join(words), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


@lru_cache(1)
def telling() -> frozenset[str]:
    """Words of names and notices that neither frames nor ordinary sentences have, numbers aside."""
    common = {w for t in (*FRAMES, *ORDINARY) for w in _tokens(t)} - {"license", "international"}
    every = (t for texts in (*NAMES.values(), *NOTICES.values()) for t in texts)
    return frozenset(w for t in every for w in _tokens(t) if w not in common and not w.isdigit())


def _features(words: list[str]) -> list[int]:
    own = telling()
    grams = (words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return sorted(_hash(g) for g in grams if not own.isdisjoint(g) and (len(g) > 1 or len(g[0]) >= ALONE))


def _framed(names: tuple[str, ...], frames: tuple[str, ...] = FRAMES) -> list[list[str]]:
    return [_tokens(f.format(n)) for n in names for f in frames]


@lru_cache(1)
def vocabulary() -> dict[int, int]:
    """Feature -> place: the word pairs and triples of names in their frames, of notices and of UNSEEN."""
    texts = [w for names in (*NAMES.values(), UNSEEN) for w in _framed(names)] + [_tokens(t) for ts in NOTICES.values() for t in ts]
    found = sorted({f for w in texts for f in _features(w)})
    if len(found) > PLACES:
        raise ValueError("more template features than places")
    return {f: i for i, f in enumerate(found)}


def _examples(seed: int, frames: tuple[str, ...], unseen: tuple[str, ...]) -> list[tuple[list[int], int]]:
    rng, vocab, out = random.Random(seed), vocabulary(), []
    plain = [w for t in ORDINARY for w in _tokens(t)]
    every = [w for texts in (*NAMES.values(), *NOTICES.values()) for t in texts for w in _tokens(t)]
    own, unknown = telling(), len(FAMILIES)

    def add(words: list[str], family: int) -> None:
        out.append(([vocab[f] for f in _features(words) if f in vocab], family))

    for k, family in enumerate(FAMILIES):
        for words in _framed(NAMES[family], frames):
            cut = [rng.choice(plain) for _ in range(rng.randrange(0, 6))]
            add(cut + words, k)
            if rng.random() < 0.3:  # the same with its telling words gone is none of the families
                add([rng.choice(plain) if w in own and w != "license" else w for w in words], unknown)
        for text in NOTICES.get(family, ()):
            words = _tokens(text)
            for _ in range(12):
                a = rng.randrange(0, len(words) // 3 + 1) * rng.randrange(2)
                add([w for w in words[a:] if rng.random() > 0.06], k)
    for words in _framed(unseen, frames):
        add(words, unknown)
    for t in ORDINARY:
        add(_tokens(t), unknown)
    for _ in range(12 * len(FAMILIES)):
        add([rng.choice(every + plain) for _ in range(rng.randrange(2, 30))], unknown)
    rng.shuffle(out)
    return out


def _softmax(z: list[float]) -> list[float]:
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


@lru_cache(1)
def model() -> tuple[list[list[float]], list[float]]:
    """(weights by family and place, biases), the last family being unknown; divided by the temperature."""
    k, n = len(FAMILIES) + 1, len(vocabulary())
    w, bias = [[0.0] * n for _ in range(k)], [0.0] * k
    bias[-1] = 2.0
    seen = _examples(1, FRAMES, UNSEEN)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 10)
        for features, y in seen:
            z = [b + sum(row[f] for f in features) for row, b in zip(w, bias, strict=True)]
            p = _softmax(z)
            for c in range(k):
                g = p[c] - (c == y)
                if abs(g) < 1e-4:
                    continue
                step = rate * g / max(1.0, math.sqrt(len(features)))
                for f in features:
                    w[c][f] -= step + DECAY * w[c][f]
                if c < k - 1:
                    bias[c] -= 0.05 * step
    kept = _examples(2, OTHER_FRAMES, OTHER_UNSEEN)

    def loss(t: float) -> float:
        total = 0.0
        for features, y in kept:
            p = _softmax([(b + sum(row[f] for f in features)) / t for row, b in zip(w, bias, strict=True)])
            total -= math.log(max(1e-12, p[y]))
        return total

    t = min((2 ** (i / 4) for i in range(-8, 13)), key=loss)
    return [[round(x / t, 5) for x in row] for row in w], [round(b / t, 5) for b in bias]


@lru_cache(1)
def name_patterns() -> tuple[tuple[str, str, str], ...]:
    """Of each family, for words joined and bounded by spaces: its names, a negated one, another family's name."""

    def longest_first(families) -> str:
        return "|".join(sorted({" ".join(_tokens(n)) for f in families for n in NAMES[f]}, key=lambda n: (-len(n), n)))

    denied = "|".join(NEGATIONS)
    return tuple((f" (?:{longest_first([f])}) ", f" (?:{denied})(?: [a-z0-9]+){{0,4}} (?:{longest_first([f])}) ", f" (?:{longest_first(x for x in FAMILIES if x != f)}) ") for f in FAMILIES)


@lru_cache(1)
def lookup(buckets: int = 512, size: int = 1 << 13) -> tuple[int, list[int], list[int], list[int]]:
    """The vocabulary as a table without collisions: shift, move of each bucket, feature and place of each slot.
    A feature h is in slot ((h >> shift) + move of bucket h mod buckets) mod size."""
    groups: dict[int, list[int]] = {}
    for f in vocabulary():
        groups.setdefault(f % buckets, []).append(f)
    for shift in range(16, 40):
        moves, slots = [0] * buckets, [None] * size
        for b, own in sorted(groups.items(), key=lambda g: -len(g[1])):
            for move in range(size):
                at = [((f >> shift) + move) % size for f in own]
                if len(set(at)) == len(at) and all(slots[i] is None for i in at):
                    break
            else:
                break
            moves[b] = move
            for i, f in zip(at, own, strict=True):
                slots[i] = f
        else:
            vocab = vocabulary()
            return shift, moves, [f or 0 for f in slots], [-1 if f is None else vocab[f] for f in slots]
    raise ValueError("no table without collisions")


def _array(values: list, kind: str) -> Column:
    """A literal array, from one string."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array ``licences``: line (from 1), family, probability, overlap, confirmed, paragraph
    of each paragraph that isn't unknown, in order; and an array ``wrapped_licences`` of the same, with the
    last line, of confirmed statements that are wrapped over lines."""
    name, wrapped, p, q, lines_at = (free_name(docs, n) for n in ("licences", "wrapped_licences", "_paragraphs", "_windows", "_lines"))
    weights, bias = model()
    shift, moves, slots, places = lookup()
    move, slot, where = _array(moves, "int"), _array(slots, "bigint"), _array(places, "int")
    rows = [_array(row, "double") for row in weights]
    stem = lambda t: F.lower(t).rlike("|".join(x.replace("-", "[-]") for x in STEMS))

    def place(h: Column) -> Column:
        at = F.pmod(F.shiftright(h, shift) + F.get(move, F.pmod(h, F.lit(len(moves))).cast("int")), F.lit(len(slots))).cast("int")
        return F.when(F.get(slot, at) == h, F.get(where, at)).otherwise(-1)

    def grams(words: Column, n: int) -> Column:
        """Place and index of each feature of n words."""

        def at(word: Column, i: Column) -> Column:
            return F.struct(place(F.xxhash64(F.concat_ws(" ", word, *(F.get(words, i + k) for k in range(1, n))))).alias("place"), i.alias("first"), (i + n - 1).alias("last"))

        return F.filter(F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), at), lambda x: x["place"] >= 0)

    keys = ("line", "last", "paragraph", "words")
    notices = F.array(*(F.array(*(F.lit(sorted(set(_tokens(t)))) for t in NOTICES[f])) if f in NOTICES else F.array().cast("array<array<string>>") for f in FAMILIES))
    patterns = [F.array(*map(F.lit, of)) for of in zip(*name_patterns(), strict=True)]
    score = lambda x, c: F.aggregate(x["hits"], F.lit(float(bias[c])), lambda a, h: a + F.get(rows[c], h["place"]))

    def span(x: Column) -> Column:
        """Its words from its first feature to its last."""
        first = F.array_min(F.transform(x["hits"], lambda h: h["first"]))
        return F.slice(x["words"], first + 1, F.array_max(F.transform(x["hits"], lambda h: h["last"])) - first + 1)

    def compared(x: Column, t: Column) -> Column:
        """Share of the notice t's words that x has, and how many others, numbers aside, in t's number."""
        more = F.filter(F.array_except(x["span"], t), lambda w: ~w.rlike("^[0-9]+$"))
        return F.struct((F.size(F.array_intersect(t, x["span"])) / F.size(t)).alias("share"), (F.size(more) / F.size(t)).alias("more"))

    def found(df: DataFrame, p: str) -> DataFrame:
        """df with what is found in its array p of line, last, paragraph and words."""

        def then(df: DataFrame, *kept: str, **new) -> DataFrame:
            return df.withColumn(p, F.transform(p, lambda x: F.struct(*(x[k].alias(k) for k in (*keys, *kept)), *(f(x).alias(n) for n, f in new.items()))))

        df = then(df, hits=lambda x: F.concat(*(grams(x["words"], n) for n in (1, 2, 3))))
        df = df.withColumn(p, F.filter(p, lambda x: F.size(x["hits"]) > 0))
        df = then(df, span=span, z=lambda x: F.array(*(score(x, c) for c in range(len(rows)))))
        df = then(df, "span", "z", top=lambda x: F.array_max(x["z"]))
        df = then(df, "span", best=lambda x: F.array_position(x["z"], x["top"]).cast("int"), probability=lambda x: 1 / F.aggregate(x["z"], F.lit(0.0), lambda a, z: a + F.exp(z - x["top"])))
        df = df.withColumn(p, F.filter(p, lambda x: (x["best"] <= len(FAMILIES)) & (x["probability"] >= MIN_PROBABILITY)))
        whole = lambda x: F.concat(F.lit(" "), F.array_join(x["words"], " "), F.lit(" "))
        df = then(df, "span", "best", "probability", whole=whole)
        said = lambda x, k: F.rlike(x["whole"], F.get(patterns[k], x["best"] - 1))
        # another family's name that is part of this one's, as a notice may hold, is none
        bare = lambda x: F.regexp_replace(x["whole"], F.get(patterns[0], x["best"] - 1), F.lit(" | "))
        other = lambda x: F.rlike(bare(x), F.get(patterns[2], x["best"] - 1))
        df = then(df, "best", "probability", named=lambda x: said(x, 0) & ~said(x, 1), other=other, like=lambda x: F.transform(F.get(notices, x["best"] - 1), lambda t: compared(x, t)))
        near = lambda x: F.coalesce(F.array_max(F.transform(x["like"], lambda c: c["share"])), F.lit(0.0))
        sure = lambda x: x["named"] | (~x["other"] & F.exists(x["like"], lambda c: (c["share"] >= CONFIRM) & (c["more"] <= EXTRA)))
        family = lambda x: F.get(F.array(*map(F.lit, FAMILIES)), x["best"] - 1)
        overlap = lambda x: F.when(x["named"], 1.0).otherwise(near(x))
        return df.withColumn(p, F.transform(p, lambda x: F.struct(x["line"].alias("line"), family(x).alias("family"), x["probability"].alias("probability"), overlap(x).alias("overlap"), sure(x).alias("confirmed"), x["paragraph"].alias("paragraph"), x["last"].alias("last"))))

    none = F.array().cast("array<string>")
    out = docs.withColumn(lines_at, F.when(stem(F.col(text)), F.split(F.col(text), "\n")).otherwise(none))
    all_lines = F.col(lines_at)
    lines = F.filter(F.transform(all_lines, lambda x, i: F.struct((i + 1).alias("line"), (i + 1).alias("last"), x.alias("paragraph"))), lambda x: stem(x["paragraph"]))
    out = out.withColumn(p, lines)
    out = found(out.withColumn(p, F.transform(p, lambda x: F.struct(x["line"].alias("line"), x["last"].alias("last"), x["paragraph"].alias("paragraph"), _words(x["paragraph"]).alias("words")))), p)

    # a line of a block has a word at least, so ``more`` lines suffice
    more = max(len(_tokens(t)) for texts in NOTICES.values() for t in texts) - 1
    state = lambda words, n, last, open_: F.struct(words.alias("words"), n.alias("n"), last.alias("last"), open_.alias("open"))

    def joined(a: Column, w: Column) -> Column:
        goes_on = state(F.concat(a["words"], w), a["n"] + F.size(w), a["last"] + 1, a["n"] + F.size(w) < more)
        return F.when(a["open"] & (F.size(w) > 0), goes_on).otherwise(state(a["words"], a["n"], a["last"], F.lit(False)))

    out = out.withColumn(q, F.when(F.size(all_lines) > 1, F.transform(all_lines, lambda x: _words(x))).otherwise(F.array().cast("array<array<string>>")))
    window = lambda w, i: F.aggregate(F.slice(F.col(q), i + 2, more), state(w, F.lit(0), i + 1, F.size(w) > 0), joined)
    out = out.withColumn(q, F.transform(q, lambda w, i: F.struct((i + 1).alias("line"), window(w, i).alias("w"))))
    out = out.withColumn(q, F.filter(q, lambda x: x["w"]["last"] > x["line"]))
    out = out.withColumn(q, F.transform(q, lambda x: F.struct(x["line"].alias("line"), x["w"]["last"].alias("last"), F.array_join(F.slice(all_lines, x["line"], x["w"]["last"] - x["line"] + 1), "\n").alias("paragraph"), x["w"]["words"].alias("words"))))
    out = found(out.withColumn(q, F.filter(q, lambda x: stem(x["paragraph"]))), q)
    meets = lambda x, y: (x["family"] == y["family"]) & y["confirmed"] & (y["line"] <= x["last"]) & (x["line"] <= y["last"])
    better = lambda x, y: (y["overlap"] > x["overlap"]) | ((y["overlap"] == x["overlap"]) & (y["line"] > x["line"]))
    kept = F.filter(q, lambda x: x["confirmed"] & ~F.exists(p, lambda y: meets(x, y)) & ~F.exists(q, lambda y: meets(x, y) & better(x, y)))
    return out.withColumn(wrapped, kept).withColumn(name, F.transform(p, lambda x: x.dropFields("last"))).drop(p, q, lines_at)
