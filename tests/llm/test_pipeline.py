"""The pipeline: each stage on its predecessor's rows against the operators' own verdicts and brute force."""

import random
from collections import Counter

import corpus_pipeline
from test_near_dedup import brute, shuffled

from quartzline.llm import exact_dedup, quality_rules
from quartzline.llm.common import saved


def test_stages(spark, tmp_path):
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 300, 60)]
    near = texts[0].split()
    near[30] = "other"
    texts += [texts[1], texts[1].upper().replace("WORD", "word"), " ".join(near), "too short", None, "spam " * 100, ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    out = []
    for _, f in corpus_pipeline.STAGES:
        at = f(spark, at, str(tmp_path))
        out.append(at)
    good = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert {r.doc_id for r in out[0].collect()} == good == set(range(8))
    assert {r.doc_id for r in out[1].collect()} == {0, 2, 3, 4, 6, 7}
    left = [(i, t) for i, t in enumerate(texts) if i in (0, 2, 3, 4, 6, 7)]
    assert {r.doc_id for r in out[2].collect()} == {c for _, _, c in brute(left)}
    assert all(x.columns == docs.columns for x in out[:4])
    mixed = Counter(r.doc_id for r in out[3].collect())
    assert max(mixed.values()) <= 2 and set(mixed) <= {0, 2, 3, 4, 6}
    assert Counter(r.doc_id for r in out[4].collect()) == mixed
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == mixed


def test_exact_copies_shuffle(spark):
    """Rows go through one shuffle and normalised texts through another; a third had the rows again. Null ids, repeated rows and ties stay right."""
    rng = random.Random(3)
    rows = [(i, rng.randbytes(2500).hex()) for i in range(300)]
    rows += [(300, rows[0][1].upper()), (None, rows[1][1]), (None, "Only null"), (None, "only NULL"), (2, rows[2][1]), (301, None), (302, ""), (301, "other")]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = shuffled(spark)
        got = [(r.doc_id, (r.text or "").lower()) for r in exact_dedup.drop_copies(docs).collect()]
        written = shuffled(spark) - at
        at = shuffled(spark)
        docs.repartition(5, "doc_id").write.format("noop").mode("overwrite").save()
        once = shuffled(spark) - at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    most: dict = {}
    for i, t in rows:
        t = (t or "").lower()
        most[t] = max((most.get(t, -1), -1 if i is None else i))
    assert Counter(got) == Counter({(None if i == -1 else i, t): 1 for t, i in most.items()})
    assert 0 < written < 2.5 * once
