"""Operator 4 against a plain dictionary version, and sums of its probabilities."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from quartzline.llm import katz_lm


def good_turing(counts):
    """Katz's discounts r*/r with the correction that leaves counts above K alone; half a count where that is no discount."""
    counts, k = list(counts), katz_lm.K
    n = {r: counts.count(r) for r in range(1, k + 2)}
    d = {r: 1 - 1 / (2 * r) for r in range(1, k + 1)}
    if all(n.values()):
        a = (k + 1) * n[k + 1] / n[1]
        for r in d:
            x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else 0
            d[r] = x if 0 < x < 1 else d[r]
    return d


def brute(rows):
    toks = [((t or "").encode().lower().split() + [None]) for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    uni, big = Counter(), defaultdict(Counter)
    for w, h in zip(toks, held, strict=True):
        if not h:
            uni.update(w)
            for a, b in zip([None, *w], w, strict=False):
                big[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    d1, d2 = good_turing(uni.values()), good_turing([c for x in big.values() for c in x.values()])

    def disc(c, d, context):
        if c <= katz_lm.K:
            return d[c] * c
        return c - 0.5 * (min(x for x in context.values() if x) > katz_lm.K)

    unk = 1 - sum(disc(c, d1, uni) for c in uni.values()) / n if n else 1.0
    p1 = lambda w: disc(uni[w], d1, uni) / n if uni[w] else unk

    def p2(a, b):
        if not uni[a]:
            return p1(b)
        if big[a][b]:
            return disc(big[a][b], d2, big[a]) / uni[a]
        seen = [x for x, c in big[a].items() if c]
        return (1 - sum(disc(big[a][x], d2, big[a]) for x in seen) / uni[a]) / (1 - sum(map(p1, seen))) * p1(b)

    for a in list(uni)[:5] + ["never seen"]:  # the words and the unknown class sum to 1
        assert abs(sum(p2(a, b) for b in [*uni, "unknown"]) - 1) < 1e-9
    return [(i, h, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(a, b)) for a, b in zip([None, *w], w, strict=False))) for (i, _), w, h in zip(rows, toks, held, strict=True)]


def test_scores_brute(spark, monkeypatch):
    monkeypatch.setattr(katz_lm, "BLOCK", 700)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(200)]
    p = 1 / np.arange(1, 201)
    rows = [(i, " ".join(rng.choices(vocab, p, k=rng.randrange(0, 60))) + (" The THE" if i % 3 else " odd%d" % i)) for i in range(150)]
    rows += [(3000 + i, "always so") for i in range(20)]  # a context whose counts are all large
    rows += [(900, None), (901, ""), (None, "the end"), (5, "again w1 w2")]
    docs = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id long, text string, held_out boolean, Score int").repartition(3)
    got = sorted(map(tuple, katz_lm.lm_scores(docs).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6, (g, w)


def test_edges(spark):
    assert katz_lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if katz_lm.held_out(i))
    r = katz_lm.lm_scores(spark.createDataFrame([(held, "only held out")], "doc_id long, text string")).collect()
    assert [(x.held_out, x.n_known, x.train_tokens, x.base_score, x.score) for x in r] == [(True, 0, 0, 0.0, 0.0)]
