"""Operator 2 against all pairs, compared as sets of word tuples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzline.llm import near_dedup
from quartzline.llm.common import saved
from quartzline.llm.components import components


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {(i, len(sets[i]), root(i)) for i in ids}


def corpus(seed, n_groups=25, crowd=260):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = [None, "", "\n \t", "a b", "A B", "a b c", "a b c d e", "a b c d e f"]
    for g in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(crowd):  # one large group, of copies that differ by up to a handful of words
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    for _ in range(200):  # a passage that many share, in texts that are otherwise different
        texts.append(" ".join(passage + [rng.choice(vocab) for _ in range(60)]))
    rng.shuffle(texts)
    return list(enumerate(texts))


def shuffled(spark):
    """Bytes that the session's executors have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    each = sc.statusStore().executorList(False)
    return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))


def components_of(spark, rows):
    docs = spark.createDataFrame([(i, t, True, 1, 2) for i, t in rows], "doc_id long, text string, kept boolean, Node int, sk int")
    got = near_dedup.near_dedup(docs).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize(("seed", "node", "few"), [(2, 8192, 500), (9, 150, 4_000_000)])
def test_components_brute(spark, monkeypatch, seed, node, few):
    """Nodes within one task, which branch in memory; and large nodes, dealt into chunks and branched as tables."""
    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "FEW", few)
    rows = corpus(seed)
    assert components_of(spark, rows) == brute(rows)


def test_one_crowd_around_the_threshold():
    """Copies of one text around the threshold, every document apart at first: a node misses no component."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert in_one_node(rows) == {(i, c) for i, _, c in brute(rows)}


def in_one_node(rows, lab=None):
    ids = np.arange(len(rows))
    sets = [near_dedup.shingles(t) for _, t in rows]
    links = near_dedup._links(ids, ids if lab is None else lab, sets)
    assert len(links) == len({a for a, _ in links} | {b for _, b in links}) - len({c for _, _, c in brute(rows)} & {x for p in links for x in p})
    up: dict = {}
    for a, b in links:
        p, q = sorted((near_dedup._root(up, a), near_dedup._root(up, b)))
        up[q] = p
    return {(int(i), int(near_dedup._root(up, i))) for i in ids}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_dedup(empty).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, near_dedup.near_dedup(docs).collect()))
    assert len(got) == 5 and sum("kept=True" in x for x in got) == 4
    stay = near_dedup.drop_near(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [1, 2, 3]


def test_star_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(5000 + i, 5001 + i) for i in range(60)] + [(9000, 9001 + i) for i in range(500)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    want = {x: root(x) for p in links for x in p if root(x) != x}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0


def _family(rng, n=70):
    """Texts that share about two thirds of their shingles with each other, each with a near copy of its own."""
    base, texts = [f"b{k}" for k in range(200)], []
    for _ in range(n):
        t = list(base)
        for k in rng.sample(range(0, 200, 5), 4):
            t[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
        t[rng.randrange(200)] = "copy"
        texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


def test_pairs_within_a_family(spark, monkeypatch):
    """Documents that resemble all others without reaching the threshold, while some reach it with each other."""
    monkeypatch.setattr(near_dedup, "NODE", 60)
    rows = list(enumerate(_family(random.Random(12))))
    want = brute(rows)
    assert len({c for _, _, c in want}) > 40
    assert in_one_node(rows) == {(i, c) for i, _, c in want}
    assert components_of(spark, rows) == want


def test_marks_lose_no_pair_within_reach():
    """In-memory branching may miss a pair in one tree only where no member is marked by another partner; brute force over sketches."""
    rng = random.Random(4)
    rows = corpus(rng.random())
    sets = [x for x in (near_dedup.shingles(t) for _, t in rows) if len(x)]
    m = np.stack([near_dedup.minwise(x) for x in sets]).astype(np.uint8)
    lab = np.arange(len(m))
    want = np.array([(near_dedup._alike(m, m[k]) & (lab != k)).any() for k in lab])
    assert (near_dedup._mark(m, lab, 3) == want).all()
    assert not near_dedup._mark(m, np.zeros(len(m), int), 3).any()


def test_shuffles_leave_texts_out(spark):
    """Two near copies among texts that nothing resembles: confirming them doesn't shuffle all texts, as joining them whole did."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.randrange(16**8):x}" for _ in range(2000))) for i in range(200)]
    rows.append((200, rows[0][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = saved(docs)
        at = shuffled(spark)
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect()}
        written = shuffled(spark) - at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows)
    assert 0 < written < sum(len(t) for _, t in rows) / 2


def test_likely_keeps_all_that_are_wanted(spark, monkeypatch):
    """Also where many ids fall on the same bits."""
    docs, wanted = (spark.range(*x).select((F.col("id") * 7919 - 50000).alias("doc_id")) for x in ((20000,), (0, 20000, 9)))
    for bits in (1 << 25, 1 << 14, 1, 1000):
        monkeypatch.setattr(near_dedup, "BITS", bits)
        kept = near_dedup._likely(docs, wanted)
        assert wanted.join(kept, "doc_id", "left_anti").isEmpty()
        assert kept.count() == kept.distinct().count() <= 20000
        assert bits < 1 << 25 or kept.count() < 2300
