"""Operator 5 against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quartzline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.merges_of(bpe.read_tokenizer(PATH)), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(2)
    out = ["", " ", "\n\n \n", "it's I'll we've 'LL don't<|endoftext|>x <|endoftext|>", "\x1c\x1d a\x85b　c\xa0 d", "aaaa" * 500, "ab" * 3000, " " * 999 + "x", "ÃÂ" * 400, "日本語テキスト🎉🎉", "é́", "1234 5,678.90", "�\u0000"]
    abc = "abcdeé ñ 日\n\t.,'!<|>12 "
    out += ["".join(rng.choice(abc) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(50)) for _ in range(100)]
    out.append(" ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randrange(1, 14))) for _ in range(30_000)))
    return out


def test_same_as_library(both):
    m, lib = both
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        got = m.encode(t)
        assert list(got) == want, t[:80]
        assert "".join(m.decode(got)) == lib.decode(want, skip_special_tokens=False)


def test_stable_tokens_come_early(both):
    m, lib = both
    rng = random.Random(4)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    first = next(m.piece(word.encode()))
    assert first == lib.encode(word, add_special_tokens=False).ids[0]
    assert list(m.piece(word.encode())) == lib.encode(word, add_special_tokens=False).ids
    assert m.lookahead == max(len(t) for t in m.ids)


def test_query_rows(spark, both):
    _, lib = both
    rows = [(i, t, True, 1) for i, t in enumerate(texts())] + [(None, "a b", True, 1), (9999, None, True, 1), (3, "x", True, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens boolean, DOC_iD2 int")
    got = bpe.bpe_round_trip(docs, PATH, with_ids=True).collect()
    assert len(got) == len(rows)
    want = {}
    for _, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.setdefault((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()), packed)
    for r in got:
        assert bytes(r.ids) == want[r.n_tokens, r.ids_sha256, r.decoded_sha256]
    assert bpe.bpe_round_trip(docs.filter("false"), PATH).collect() == []


def test_parts_are_streamed_and_long_pieces_too(both, monkeypatch):
    m, lib = both
    monkeypatch.setattr(bpe, "PART", 64)
    word = "".join(random.Random(6).choice("etaoin") for _ in range(3000))
    for t in [word, f"{word} {word}\n日本語{word}<|endoftext|>{word}é", "short words, many of them. " * 200, "🎉" * 500]:
        parts = list(m.stream(t))
        want = lib.encode(t, add_special_tokens=False).ids
        assert list(m.encode(t)) == want
        assert len(parts) > 3
        assert max(map(len, parts)) <= 4 * 64
        assert "".join(m.decode_stream(bpe.array("I", p) for p in parts)) == t
