"""Operator 7: the automaton against edit distances by definition, and held-out accuracy."""

import random
import zlib

from quartzline.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_brute():
    rng = random.Random(1)
    terms = ["idiot", "moron", "pathetic", "disgusting", "sad", "id*", "réeux*", "clowns"]
    auto = toxicity.Automaton(terms)
    words = ["", "idiot", "idoit", "idi0t", "disgustng", "dissgustingg", "réeuxvi", "clwn"] + ["".join(rng.choice("idotmrnpaehcsgu") for _ in range(rng.randrange(1, 11))) for _ in range(1500)]
    for t in terms:
        for _ in range(60):
            w = list(t.rstrip("*"))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(["", "x", w[0] + "q"])
            words.append("".join(w))
    for w in words:
        best = []
        for k, t in enumerate(terms):
            if t.endswith("*"):
                best += [(0, 1, k)] * w.startswith(t[:-1])
            elif distance(w, t) <= toxicity.allowed(t):
                best.append((distance(w, t), 0, k))
        want = (min(best)[2], min(best)[0]) if best else None
        assert auto.match(w) == want, w


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    bad = ["idiot", "moron", "pathetic", "worthless"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        y = int(rng.random() < 0.2)
        for _ in range(y * rng.randrange(1, 4)):
            t = rng.choice(bad)
            w.insert(rng.randrange(len(w)), t if rng.random() < 0.8 else t[:2] + "x" + t[3:])
        rows.append((i, " ".join(w), y, 1))
        labels.append((i, None if i % 50 == 0 else y))
    rows += [(None, "", 0, 1), (5000, None, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, Score int")
    lab = spark.createDataFrame(labels + [(7, 0), (7, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert len(held) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert next(r.score for r in got if r.doc_id == 5000) < 0.5
    none = toxicity.toxicity(docs, lab.filter("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(docs.filter("false"), lab).collect() == []


def test_quotation_is_no_abuse():
    s = toxicity.Lexicon(["moron"], [3.0]).ready()
    abuse, quote = s.features("you moron"), s.features('he said "what a moron" and left')
    assert abuse[0] > 0 and abuse[5] > 0 and abuse[4] == 0
    assert quote[0] == 0 and quote[4] > 0
