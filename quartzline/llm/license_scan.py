"""Licence scan: a trained paragraph classifier in DataFrame expressions, with template comparison.

Paragraphs are lines. All are judged: they go through sparse logistic regression over word 1- and 2-grams, one
weight vector for each licence family and one for "none". The probabilities are calibrated by a temperature fitted on
held-out variants. A family counts if it is likelier than ``SURE`` and a template of the family agrees: the share of common words among all words of
both reaches ``AGREE``, or the share of the template's words that are there reaches ``HELD``. Where the template has the family's name (one of
``NAMES``), the paragraph must have one too, so another licence's name in a known form of words gives no family. A paragraph that is a licence statement, but of no family surely, is "unknown".

A paragraph of more than ``WINDOW`` words is judged in windows of that many, one at each ``STEP`` words, so that its other words don't weigh against a
statement in it. It counts once; its families are those of all its windows, and it is "unknown" if none has a family but one is a statement.

Training needs no corpus: paragraphs are written from the templates below with seeded changes, and "none" from
ordinary sentences with the same words. Grams of ``COMMON`` words alone have no weight. Lines that hold no word of a gram that makes any
class likelier than "none" aren't scored: without such grams a line is at most as likely a statement as an empty one, which is "none".

Null texts count as empty; every row gives one row, repeated ones too; an empty table gives an empty result. Texts of any length are judged whole.
Other columns of the table are left out, so their names can't clash.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

SURE, AGREE, LEAST_STATEMENT, SEED = 0.6, 0.3, 0.5, 11
HELD, WINDOW, STEP = 0.75, 32, 8
#: What a line must have to be judged: any word.
ANCHOR = "[a-zA-Z0-9]"
COMMON = frozenset("a all an and any are as at be by for from have he her in is it its may more no not of on or she that the they this to under was we with you your".split())
NONE = "none"
MIT_NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
APACHE_NOTICE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def _pieces(notice: str, n: int = 24) -> list[str]:
    """A notice in pieces that fit into a window."""
    w = notice.split()
    return [" ".join(w[k : k + n]) for k in range(0, len(w), n) if len(w) - k >= n // 2]


TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT license", "SPDX-License-Identifier: MIT", *_pieces(MIT_NOTICE)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "you may not use this file except in compliance with the Apache License", "SPDX-License-Identifier: Apache-2.0", *_pieces(APACHE_NOTICE)],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU GPL v3 license.", "Distributed under the terms of the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", *_pieces(GPL_NOTICE)],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is licensed under the LGPL.", "SPDX-License-Identifier: LGPL-2.1"],
    "BSD": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0 license.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution license."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial License."],
    "CC0": ["Released into the public domain under CC0.", "To the extent possible under law, the author has waived all copyright under CC0 public domain dedication."],
    "proprietary": ["All rights reserved.", "Copyright Example Inc. All rights reserved.", "No part may be reproduced without a license from the copyright holder. All rights reserved."],
}
#: Words that tell a family from others in the same form of words, its name mostly: all of one list have to be there.
NAMES = {
    "MIT": [["mit"]],
    "Apache-2.0": [["apache"], ["file", "compliance"]],
    "GPL": [["gpl"], ["gnu", "general"]],
    "LGPL": [["lgpl"], ["gnu", "lesser"]],
    "BSD": [["bsd"]],
    "MPL": [["mpl"], ["mozilla"]],
    "CC-BY": [["cc", "by"], ["commons", "attribution"]],
    "CC-BY-SA": [["cc", "sa"], ["sharealike"]],
    "CC-BY-NC": [["cc", "nc"], ["commons", "noncommercial"]],
    "CC0": [["cc0"], ["public", "domain"]],
    "proprietary": [["rights", "reserved"], ["reproduced", "copyright"]],
}
ORDINARY = ["She got her driving license last week.", "The plumber is a licensed professional with years of work.", "Poetic license allows the author to change the facts.", "The bar lost its liquor license in the city.", "Parking requires a license plate number.", "A fishing licence costs ten euros in this state.", "The doctor is licensed to practice medicine.", "They discussed copyright law at the university.", "Copyright disputes are common in music.", "He has a license to operate the crane.", "The term public domain came up in class.", "The apache helicopter pilot had a license.", "Students at MIT need a license for the lab.", "The mayor renewed the taxi license of the general public service.", "Er kommt mit dem Zug und geht mit ihr nach Hause.", "Mit dem Hund war sie im Wald.", "Das ist mit Abstand der beste Tag und mit viel Arbeit verbunden.", "Sie sprach mit ihm.", "Mit und ohne Regen.", "The software was slow in the first version.", "The author may not use this text in class.", "The public library has a general source of files.", "Under the terms of the agreement he may leave the project.", "All people have rights.", "She reserved a table for two.", "Permission to enter was granted by the owner.", "The foundation published work on free speech.", "The international commons room is part of the domain.", "The holder of the ticket is governed by the law of the state."]
UNKNOWN = ["Licensed under the terms given below.", "This work is licensed under the Foo Bar License, version 7.", "Released under the Example Community License.", "Distributed under a custom license.", "The software is provided \"as is\", without warranty of any kind, express or implied."]


def words_in(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams(text: str) -> set[str]:
    w = words_in(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


class Model:
    def __init__(self, families: list[str], vocabulary: list[str], weights: np.ndarray, temperature: float):
        self.families, self.vocabulary, self.weights, self.temperature = families, vocabulary, weights, temperature

    def probabilities(self, text: str) -> np.ndarray:
        g = grams(text)
        z = self.weights[-1] + sum((self.weights[k] for k, v in enumerate(self.vocabulary) if v in g), np.zeros(len(self.families)))
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()


def _variants(rng: random.Random, text: str, n: int) -> list[str]:
    filler = "the of and this file code data project see notice in more work document with for all".split()
    out = [text]
    for _ in range(n - 1):
        w = text.split()
        for _ in range(rng.randrange(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(filler))
        if len(w) > 4 and rng.random() < 0.3:
            del w[rng.randrange(len(w))]
        out.append(re.sub(r"\d", lambda m: m[0] if rng.random() < 0.7 else str(rng.randrange(10)), " ".join(w)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@cache
def train(seed: int = SEED) -> Model:
    """Multinomial logistic regression with an L2 penalty; the classes are the families, "unknown" and "none"."""
    rng = random.Random(seed)
    families = [*TEMPLATES, "unknown", NONE]
    rows = [(v, families.index(f)) for f, ts in (TEMPLATES | {"unknown": UNKNOWN, NONE: ORDINARY}).items() for t in ts for v in _variants(rng, t, 12)]
    rng.shuffle(rows)
    vocabulary = sorted({g for t in [*sum(TEMPLATES.values(), []), *ORDINARY, *UNKNOWN] for g in grams(t) if not COMMON.issuperset(g.split())})
    place = {g: k for k, g in enumerate(vocabulary)}
    x, y = np.zeros((len(rows), len(vocabulary) + 1)), np.array([k for _, k in rows])
    for i, (t, _) in enumerate(rows):
        x[i, [place[g] for g in grams(t) if g in place]] = 1
    x[:, -1] = 1
    cut = len(rows) * 4 // 5

    def fitted(x, y):
        w, hot = np.zeros((x.shape[1], len(families))), np.eye(len(families))[y]
        for _ in range(400):
            w -= 0.5 * (x.T @ (_softmax(x @ w) - hot) / len(x) * 4 + 0.002 * w)
        return w

    w = fitted(x[:cut], y[:cut])
    loss = lambda t: -np.log(_softmax(x[cut:] @ w / t)[np.arange(len(rows) - cut), y[cut:]] + 1e-12).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    w = fitted(x, y)
    keep = np.abs(w[:-1]).max(axis=1) >= 0.1
    return Model(families, [v for v, k in zip(vocabulary, keep, strict=True) if k], np.round(w[np.r_[keep, True]], 4), temperature)


def cues(model: Model) -> list[str]:
    """Words without one of which a line has no gram that makes any class likelier than "none", which an empty line is."""
    assert model.probabilities("")[-1] > max(1 - LEAST_STATEMENT, 1 - SURE)
    helps = [g for g, w in zip(model.vocabulary, model.weights[:-1], strict=True) if w[:-1].max() > w[-1]]
    return sorted({next(w for w in g.split() if w not in COMMON) for g in helps})


def _judge(line: Column, model: Model) -> Column:
    """Structs (family, p, statement) of the windows of a paragraph that hold a cue."""
    wanted = F.array(*[F.lit(w) for w in cues(model)])
    words = F.filter(F.split(F.lower(line), "[^a-z0-9]+", -1), lambda w: w != "")
    vec = lambda v: F.array(*[F.lit(float(x)) for x in v])
    vocabulary, weights = F.array(*[F.lit(g) for g in model.vocabulary]), F.array(*[vec(w) for w in model.weights[:-1]])
    names = F.array(*[F.lit(f) for f in model.families])
    called = F.array(*[F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in NAMES.get(f, [[""]])]) for f in model.families])
    has_name = lambda f, t: any(set(ws) <= set(words_in(t)) for ws in NAMES.get(f, []))
    template = lambda f, t: F.struct(F.array(*[F.lit(w) for w in sorted(set(words_in(t)))]).alias("ws"), F.lit(has_name(f, t)).alias("named"))
    templates = F.array(*[F.array(*[template(f, t) for t in TEMPLATES.get(f, [""])]) for f in model.families])

    def with_words(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.concat_ws(" ", w[i], F.when(i + 1 < F.size(w), w[F.least(i + 1, F.size(w) - 1)])))
        return let(F.array_distinct(F.concat(w, pairs)), lambda g: let(scores(g), lambda z: let(softmax(z), lambda p: verdict(w, p))))

    def scores(g: Column) -> Column:
        at = F.transform(F.array_intersect(g, vocabulary), lambda x: (F.array_position(vocabulary, x) - 1).cast("int"))
        return F.aggregate(F.array_sort(at), vec(model.weights[-1]), lambda a, k: F.zip_with(a, weights[k], lambda x, y: x + y))

    def softmax(z: Column) -> Column:
        e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / model.temperature))
        return let(e, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

    def verdict(w: Column, p: Column) -> Column:
        best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
        both = lambda t: F.size(F.array_intersect(w, t))
        named = F.exists(called[best], lambda ws: F.size(F.array_except(ws, w)) == 0)
        like = lambda t: (both(t) / F.size(F.array_union(w, t)) >= AGREE) | (both(t) / F.size(t) >= HELD)
        agrees = F.exists(templates[best], lambda t: (named | ~t["named"]) & like(t["ws"]))
        statement = 1 - p[len(model.families) - 1]
        sure = (F.array_max(p) > SURE) & (best < len(model.families) - 2) & agrees
        family = F.when(sure, names[best]).when(statement > LEAST_STATEMENT, F.lit("unknown")).otherwise(F.lit(NONE))
        return F.struct(family.alias("family"), F.array_max(p).alias("p"), statement.alias("statement"))

    def windows(w: Column) -> Column:
        # the last one starts less than STEP before the words that the others leave
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - WINDOW) / STEP), F.lit(0)).cast("int"))
        parts = F.transform(starts, lambda k: F.slice(w, k * STEP + 1, WINDOW))
        return F.transform(F.filter(parts, lambda x: F.arrays_overlap(x, wanted)), with_words)

    return let(words, windows)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_paragraphs (licence statements), families (sorted, comma-joined), n_unknown, best_p."""
    model = train()
    by_letter: dict[str, list[str]] = {}
    for w in cues(model):
        by_letter.setdefault(w[0], []).append(w[1:])
    cue = "(?<![a-z0-9])(?:" + "|".join(f"{a}(?:{'|'.join(ws)})" for a, ws in by_letter.items()) + ")(?![a-z0-9])"
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.lower(x).rlike(cue))
    found = F.filter(F.transform(lines, lambda x: F.filter(_judge(x, model), lambda j: j["family"] != NONE)), lambda js: F.size(js) > 0)
    kind = "array<array<struct<family:string,p:double,statement:double>>>"

    def summary(j: Column) -> Column:
        named = F.filter(F.flatten(j), lambda x: x["family"] != "unknown")
        unknown = F.filter(j, lambda js: F.forall(js, lambda x: x["family"] == "unknown"))
        return F.struct(
            F.size(j).cast("long").alias("n_paragraphs"),
            F.array_join(F.sort_array(F.array_distinct(F.transform(named, lambda x: x["family"]))), ",").alias("families"),
            F.size(unknown).cast("long").alias("n_unknown"),
            F.round(F.array_max(F.transform(F.flatten(j), lambda x: x["p"])), 6).alias("best_p"),
        )

    judged = found.cast(kind)
    texts = pick(docs, doc_id=id_col, t=text_col).select("doc_id", F.coalesce("t", F.lit("")).alias("t"))
    return texts.select("doc_id", F.inline(F.array(let(judged, summary))))
