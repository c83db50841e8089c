"""Operators 1, 3, 8 and 10 against brute force, on nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from quartzline.llm import exact_dedup, mixing, quality_rules, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = SCHEMA + ", kept boolean, H string, size int, KEEP_ID long, w string"


def rows_of(texts, source="s"):
    return [(i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)]


TEXTS = ["Same TEXT", "same text", "Ünlike", "ünlike", "", None, "a " * 3000, "A " * 3000, " \t\n", "word"]


def norm(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact_dedup_brute(spark):
    docs = spark.createDataFrame([(*r, True, "x", 1, 5, "w") for r in rows_of(TEXTS)], CLASH)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[norm(t)].append(i)
    for g in groups.values():
        for i in g:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), i == max(g))
            assert r.text_sha256 == hashlib.sha256(norm(TEXTS[i]).encode()).hexdigest()
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.select("doc_id").collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_separates_hash_collisions(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows_of(TEXTS), SCHEMA)
    weak = lambda t: F.lit(b"same").cast("binary")
    plain = {tuple(r) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs, content_hash=weak).collect()} == plain


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(7, "x", "en", "s", 1)] * 3 + [(None, "x", "en", "s", 1), (None, "lone", "en", "s", 4)], SCHEMA)
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == {(7, 7, 4, True): 3, (None, 7, 4, False): 1, (None, None, 1, True): 1}
    assert exact_dedup.drop_copies(docs).count() == 2


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, exact_dedup.drop_copies, secret_scan.secret_scan, quality_rules.quality_rules, quality_rules.keep_good, mixing.mix_sources, mixing.mixed])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


HEXES = "0f3b9c72d1e84a65f0c2b7d9e3a1584c6f7d"
SECRETS = [
    'token = "' + HEXES + '"',
    "token=ab token=abcdefgh PASSWORD: 'hunter22!' api-key=abcdef api_key=abcdef",
    "token=token = abcdefgh",
    "AKIA" + "A1B2" * 4 + " AKIASHORT " + "\U0001f600" + "AKIA" + "Z9" * 10,
    "ünï " + HEXES.upper() + " " + HEXES,
    None,
    "",
    "x " * 5000 + "secret:" + "y" * 30,
    "ghp_8fK2mQz7XwP4vRt9LbN3cYd6HsJ1aGe5TuVi and thisisaverylongordinarywordwithoutdigits",
]


def base_spans(t):
    assign = re.compile(secret_scan.ASSIGN, re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan_brute(spark):
    docs = spark.createDataFrame([(*r, True, "x", 1, 5, "w") for r in rows_of(SECRETS)], CLASH)
    for r in secret_scan.secret_scan(docs).collect():
        spans = base_spans(SECRETS[r.doc_id] or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        if r.doc_id == 8:
            assert r.n_random == 1 and r.found[0].kind == "random"


def test_randomness_battery_tells_keys_from_names(spark):
    import random

    rng = random.Random(5)
    abc = secret_scan.ALPHABETS["base64"][1][:62]
    keys = ["".join(rng.choice(abc) for _ in range(40)) for _ in range(200)]
    names = ["getTheLongFunctionName%dOfThisClass" % i for i in range(50)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaB%d" % i for i in range(50)]
    got = {r.doc_id: r.n_random for r in secret_scan.secret_scan(spark.createDataFrame(rows_of(keys + names), SCHEMA)).collect()}
    assert sum(got[i] for i in range(200)) >= 180
    assert sum(got[i] for i in range(200, 300)) <= 55


def brute_quality(t):
    t = t or ""
    w = re.findall("[^\\x20\\x09-\\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_rules_brute(spark):
    import random

    rng = random.Random(1)
    texts = [None, "", " \n ", "a b c d e", "a " * 50, "one\ntwo\none\n\n \n", "é# $%& < >|" * 3, "x y z\x0bq\x0cw"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 80))) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"w{i}" for i in range(rng.randrange(1, 40))) for _ in range(5)] + [" ".join(f"w{i % 7000}" for i in range(20000))]
    docs = spark.createDataFrame([(*r, True, "x", 1, 5, "w") for r in rows_of(texts)], CLASH)
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept <= (not r.base_failed)
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.select("doc_id").collect()} == {r.doc_id for r in got if r.kept}


def fill(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        each = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += each * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"] if i % 40 else ["rare"]), 1) for i in range(1500)]
    rows += [(5000, None, "en", "none", None), (5001, "", "en", "none", 0), (None, "a b c", "en", "a", 5)] + [(6000, "one two three", "en", "b", 13)] * 3
    docs = spark.createDataFrame([(*r, True, "x", 1, 5, "w") for r in rows], CLASH)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    for r in got:
        assert r.source_size == sizes[r.source]
    for s, t in fill(dict(sizes)).items():
        assert all(abs(r.target - t) < 1e-6 * max(1, t) for r in got if r.source == s)
        assert abs(taken[s] - t) <= 30, (s, taken[s], t)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    copies = Counter(r.doc_id for r in mix.select("doc_id").collect())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies * (r.size > 0)
    assert +copies == +want


def test_pareto_sample_has_its_inclusion_odds(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "ab"[i % 2], 1) for i in range(4000)], SCHEMA)
    hits = Counter()
    for seed in range(6):
        for r in mixing.mix_sources(docs, seed=seed).filter("source = 'b'").collect():
            hits[r.doc_id] += r.copies
    # b is due half as many words as a's cap leaves: 1.5 * 4000 - 2 * 2000 = 2000 documents, one copy each
    assert sum(hits.values()) == 6 * 2000


def test_larger_documents_are_likelier(spark):
    """Several sources that are alike stand for several draws: inclusion goes with the logarithm of the size, and words meet the target."""
    sizes = [4] * 100 + [64] * 100
    docs = spark.createDataFrame([(s * 1000 + k, "w " * n, "en", f"s{s:03d}", 1) for s in range(15) for k, n in enumerate(sizes)], SCHEMA)
    got = mixing.mix_sources(docs, weights=(1,), share=0.3).collect()
    hit = {n: sum(r.copies for r in got if r.size == n) / 1500 for n in (4, 64)}
    assert 2.2 < hit[64] / hit[4] < 3.0  # log 65 / log 5 = 2.59
    assert abs(sum(r.taken for r in got) / (15 * 6800) - 0.3) < 0.01
