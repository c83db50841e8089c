"""Operator 3's battery: against plain Python, and its two errors on names and keys that nothing was fitted to."""

import math
import random
import re

from quartzline.llm import secret_scan as S

WORDS = "apple banana copper dragon eagle forest garden hammer island jacket kettle lemon marble needle orange pepper quartz rabbit silver tiger umbrella violet window yellow zebra anchor bridge candle desert engine feather guitar harbor insect jungle kitchen ladder mirror".split()


def tail(z):
    x = max(-8.0, min(8.0, z))
    return 1 / (1 + math.exp(x * 1.5976 + x * x * x * 0.07056))


def p_random(v, abc):
    x, n, a = [abc.index(c) for c in v.replace("-", "+").replace("_", "/")], len(v), len(abc)
    chi = sum(x.count(c) ** 2 for c in set(x)) * a / n - n
    z1 = (chi - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    high = [c * 2 >= a - 1 for c in x]
    n1, turns = sum(high), 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    mu = 2 * n1 * (n - n1) / n + 1
    z2 = (turns - mu) / math.sqrt(max(1e-9, (mu - 1) * (mu - 2) / (n - 1)))
    mean = sum(x) / n
    r = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / max(1e-9, sum((c - mean) ** 2 for c in x))
    z3 = (r + 1 / n) * math.sqrt(n)
    return min(1.0, 3 * min(tail(z1), 2 * tail(abs(z2)), 2 * tail(abs(z3))))


def p_name(v, kind):
    sort = lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"
    changes, (rate, spread) = sum(sort(p) != sort(q) for p, q in zip(v, v[1:], strict=False)), S.word_null()[kind]
    return tail((changes - rate * (len(v) - 1) - 0.5) / math.sqrt(spread * (len(v) - 1)))


def brute(t):
    runs = []
    for m in re.finditer(S.RUN, t):
        kind = next((k for k, (pattern, _) in S.ALPHABETS.items() if re.search(pattern, m[0])), None)
        if kind:
            runs.append((m.start(), m.end(), p_random(m[0], S.ALPHABETS[kind][1]), p_name(m[0], kind), len(m[0]) * math.log2(len(S.ALPHABETS[kind][1]))))
    total = sum(e - s for s, e, *_ in runs)
    weighted = [p * total / ((e - s) * len(runs)) for s, e, _, p, _ in runs]
    limit = max([w for k, w in enumerate(sorted(weighted), 1) if w <= k * S.FDR / len(runs)], default=-1)
    return [(s, e) for (s, e, p, _, bits), w in zip(runs, weighted, strict=True) if w <= limit and p >= S.STRAY and bits >= S.MIN_BITS]


def key(rng, n, abc=S.ALPHABETS["base64"][1][:62]):
    return "".join(rng.choice(abc) for _ in range(n))


def name(rng):
    words = [rng.choice(WORDS) for _ in range(4)]
    join = rng.choice(["", "", "_", "-"])
    return join.join(w.capitalize() if not join or rng.random() < 0.5 else w for w in words) + (str(rng.randrange(10_000)) if rng.random() < 0.7 else "9")


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(f.start, f.end) for f in r.found if f.kind == "random"] for r in S.secret_scan(docs).collect()}


def test_battery_brute(spark):
    rng = random.Random(12)
    kinds = [abc for _, abc in S.ALPHABETS.values() if "f" not in abc or len(abc) > 16]
    piece = lambda: rng.choice([lambda: name(rng), lambda: key(rng, rng.randrange(20, 60)), lambda: key(rng, rng.randrange(20, 60), rng.choice(kinds)), lambda: "plain words", lambda: key(rng, 30, "aB3")])()
    texts = [" ".join(piece() for _ in range(rng.randrange(0, 8))) for _ in range(300)]
    got = scanned(spark, texts)
    assert sum(map(len, got.values())) > 200
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_names_and_keys_alone(spark):
    rng = random.Random(13)
    names, keys = [name(rng) for _ in range(1000)], [key(rng, 24) for _ in range(1000)]
    got = scanned(spark, names + keys)
    wrong, right = sum(map(len, [got[i] for i in range(1000)])), sum(map(len, [got[i] for i in range(1000, 2000)]))
    assert wrong <= 50, wrong
    assert right >= 900, right


def test_share_of_names_among_what_is_reported(spark):
    rng = random.Random(14)
    texts, planted = [], []
    for _ in range(200):
        parts = [(name(rng), False) if rng.random() < 0.7 else (key(rng, rng.randrange(24, 50)), True) for _ in range(20)]
        at, spans = 0, set()
        for p, secret in parts:
            if secret:
                spans.add((at, at + len(p)))
            at += len(p) + 1
        texts.append(" ".join(p for p, _ in parts))
        planted.append(spans)
    got = scanned(spark, texts)
    found = [(i, s) for i in got for s in got[i]]
    false = sum(s not in planted[i] for i, s in found)
    assert false <= 0.05 * len(found), (false, len(found))
    assert len(found) - false >= 0.9 * sum(map(len, planted)), (false, len(found), sum(map(len, planted)))
