"""Operator 9: the expressions against the model in plain Python, and held-out accuracy on other seeds' variants."""

import random
import re

from quartzline.llm import license_scan as L


def brute(text):
    model, out = L.train(), []
    for line in (text or "").split("\n"):
        if not re.search(L.ANCHOR, line):
            continue
        p, w = model.probabilities(line), set(L.words_in(line))
        k = int(p.argmax())
        name = model.families[k]
        like = max((len(w & set(L.words_in(t))) / len(w | set(L.words_in(t))) for t in L.TEMPLATES.get(name, [""])), default=0)
        if p[k] > L.SURE and name in L.TEMPLATES and like >= L.AGREE:
            out.append(name)
        elif 1 - p[-1] > L.LEAST_STATEMENT:
            out.append("unknown")
    return len(out), ",".join(sorted(set(out) - {"unknown"})), out.count("unknown")


def test_expressions_brute_and_accuracy(spark):
    rng = random.Random(99)
    named = [(f, v) for f, ts in L.TEMPLATES.items() for t in ts for v in L._variants(rng, t, 4)]
    plain = [v for t in L.ORDINARY for v in L._variants(rng, t, 3)]
    texts = [f"ordinary words\n{v}\nmore" for _, v in named] + plain + [None, "", "\n\n", "license", "word " * 20000 + "\nReleased under the MIT License.", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the Example Community License."]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, families string, T2 int")
    got = {r.doc_id: r for r in L.license_scan(docs.unionByName(docs.limit(1))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_paragraphs, got[i].families, got[i].n_unknown) == brute(t), t
    right = sum(got[i].families == f for i, (f, _) in enumerate(named))
    assert right / len(named) > 0.85, right / len(named)
    false = sum(got[len(named) + i].families != "" for i in range(len(plain)))
    assert false <= len(plain) // 20
    assert got[len(texts) - 1].families == "Apache-2.0,MIT"
    assert L.license_scan(docs.filter("false")).collect() == []


def test_statements_without_the_word_license(spark):
    texts = {
        "All rights reserved.": "proprietary",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
        "This is distributed under the terms of the GPL v3.": "GPL",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED': "",
    }
    plain = ["", "Er fuhr mit dem Bus.", "The rights of the people.", "The men went to work in this state under the general."]
    docs = spark.createDataFrame(list(enumerate([f"some words\n{t}" for t in texts] + plain)), "doc_id long, text string")
    got = [(r.n_paragraphs, r.families) for r in L.license_scan(docs).sort("doc_id").collect()]
    assert got == [(1, f) for f in texts.values()] + [(0, "")] * len(plain)


def test_statements_inside_long_paragraphs(spark):
    prose = "the old man walked along a quiet river and thought about his day while birds sang in trees near town ".split()
    said = {"Released under the MIT License.": "MIT", L.MIT_NOTICE: "MIT", L.APACHE_NOTICE: "Apache-2.0", L.GPL_NOTICE: "GPL", "All rights reserved.": "proprietary", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY"}
    rows, want = [], []
    for t, f in said.items():
        for before, after in ((0, 0), (33, 41), (2000, 3000)):
            rows.append(" ".join([(prose * 200)[k] for k in range(before)] + [t] + [(prose * 200)[k] for k in range(after)]))
            want.append((1, f, 0))
    rows += [" ".join(prose * 100), f"{rows[4]} {rows[7]}"]
    want += [(0, "", 0), (1, "Apache-2.0,MIT", 0)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [(r.n_paragraphs, r.families, r.n_unknown) for r in L.license_scan(docs).sort("doc_id").collect()]
    assert got == want


def test_other_licences_in_known_words_are_unknown(spark):
    """Families left out of training, in the forms of words of those in it."""
    forms = ["This software is licensed under the {} license.", "Released under the {} License.", "This project is licensed under the terms of the {} license.", "Licensed under the {} License, version 2.1."]
    others = ["Zlib", "WTFPL", "ISC", "EUPL", "Artistic", "Eclipse", "Unlicense", "OpenSSL"]
    rows = [f.format(o) for f in forms for o in others]
    known = [f.format(n) for f in forms for n in ("MIT", "BSD", "Apache")]
    got = [r.families for r in L.license_scan(spark.createDataFrame(list(enumerate(rows + known)), "doc_id long, text string")).sort("doc_id").collect()]
    assert got[: len(rows)] == [""] * len(rows)
    right = sum(g in ("MIT", "BSD", "Apache-2.0") and g[:3] in k for g, k in zip(got[len(rows) :], known, strict=True))
    assert right >= 0.75 * len(known), got[len(rows) :]
    unknown = [r.n_unknown for r in L.license_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()]
    assert sum(unknown) >= 0.9 * len(rows)
