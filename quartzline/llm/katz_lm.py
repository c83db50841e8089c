"""Language-model scores: a bigram Katz backoff model with Good-Turing discounts.

p(v | u) = d(c(u,v)) c(u,v) / c(u) for pairs seen in training, and weight(u) p(v) for others, evaluated per token: pair
table first, then word table, then the one class of unknown words. p(v) = d(c(v)) c(v) / N. Counts
up to ``K`` are discounted by Good and Turing's rule, with Katz's correction; larger ones keep theirs, as Katz has it, but in a context without any count
up to ``K`` each loses half a count. So every context has mass left, and weight(u) shares it exactly: the probabilities of the V words and the unknown class
sum to 1 after any context. A text's words follow an end token, and one more end token closes it.

Texts become blocks of about ``BLOCK`` tokens: their ids, word hashes and codes, saved once. Count tables are
partitioned into buckets by a hash. Each block sends a bucket its distinct keys with its own training counts, packed
as arrays; the bucket sums all blocks' counts and answers with the totals in the order asked. So a pair that
is frequent costs one entry a block. A word's bucket also numbers it, densely, so pairs travel as 32-bit numbers (64-bit ones where
a vocabulary needs them). Pairs are put together by context; contexts with more than a fair share
of tokens are dealt over more buckets. There are fewer such contexts than buckets; their sums and the counts of counts are
all that comes to the driver.

Null texts count as empty (one end token). Every row gives one row, repeated ones too; a null id counts as training
text. Words are known by 64-bit hashes. An empty table gives an empty result; without training text
all words are the unknown class, of probability 1. A very long text is one row of its block, whole. Columns are found by
name, exactly first and without regard to case next; all others are left out. Each step is a table in the shared folder, deleted at the end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, saved, settled

BLOCK, K, FOLDS, HELD_OUT, BUCKETS_A_PARTITION, BUCKETS_A_BLOCK = 2_000_000, 5, 7, 2, 8, 4
END, NO_ID = 0, np.iinfo(np.int64).min
ASK = "block long, bucket int, u binary, runs binary, v binary, k binary, cv binary"
REPLY = "block long, bucket int, kind int, total binary, stats binary, m array<long>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1  # never the end token
        return h


_hashes = _Hashes()


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _open(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def text_blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, ids, lens, vocab, codes): whole texts, each with its closing end token."""

    def run(batches):
        import pyarrow as pa

        part, seq = TaskContext.get().partitionId(), 0
        ids, lens, words, n = [], [], [], 0

        def full():
            vocab, codes = np.unique(np.concatenate(words), return_inverse=True)
            row = [(part << 32) + seq, np.array(ids, np.int64).tobytes(), np.array(lens, np.int32).tobytes(), vocab.tobytes(), _pack(codes.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "ids", "lens", "vocab", "codes"])

        for batch in batches:
            for k in range(batch.num_rows):
                i, t = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                w = (t or "").encode("utf-8", "surrogatepass").lower().split()
                h = np.empty(len(w) + 1, np.uint64)
                h[:-1] = list(map(_hashes.__getitem__, w))
                h[-1] = END
                ids.append(NO_ID if i is None else i)
                lens.append(len(h))
                words.append(h)
                n += len(h)
                if n >= BLOCK:
                    yield full()
                    seq, ids, lens, words, n = seq + 1, [], [], [], 0
        if ids:
            yield full()

    return docs.mapInArrow(run, "block long, ids binary, lens binary, vocab binary, codes binary")


class Block:
    def __init__(self, row):
        self.block = row["block"]
        self.ids, self.lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int32)
        self.vocab, self.v = np.frombuffer(row["vocab"], np.uint64), _open(row["codes"], np.uint32).astype(np.int64)
        ends = np.cumsum(self.lens)
        self.starts = ends - self.lens
        self.held = np.array([held_out(None if i == NO_ID else int(i)) for i in self.ids], bool)
        self.train = np.repeat(~self.held, self.lens)
        # the context of a text's first token is the end token
        self.u = np.concatenate([[0], self.v[:-1]])
        self.u[self.starts] = np.searchsorted(self.vocab, np.uint64(END))

    def pairs(self):
        """Distinct pairs as (key, place of each token's pair, training count)."""
        key, at = np.unique(self.u * len(self.vocab) + self.v, return_inverse=True)
        return key, at, np.bincount(at, self.train, len(key)).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _by_bucket(bucket: np.ndarray):
    """(bucket, its places) in the order that both sides of an exchange use."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]), strict=True)


class Model:
    """What is the same for all: totals and discounts. Counts of counts are over all training texts."""

    def __init__(self, words: list[int], pairs: list[int] | None = None, hot: tuple[np.ndarray, np.ndarray] | None = None):
        self.hot = hot
        self.number = np.uint64
        self.n, self.v = words[0], words[1]
        self.word_d = discounts(words[2:])
        self.pair_d = discounts(pairs[2:]) if pairs else None
        left = sum((1 - self.word_d[r]) * r * words[1 + r] for r in range(1, K + 1))
        self.bare = left == 0
        self.unknown = (left or 0.5 * self.v) / self.n if self.n else 1.0

    def word_p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        return np.where(c > 0, discounted(c, self.word_d, self.bare) / max(1, self.n), self.unknown)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(r) for r = 0 to K from how many keys occur 1 to K + 1 times; half a count where the rule gives no proper value."""
    n = [0, *counts_of_counts]
    d = np.array([1.0, *[(r - 0.5) / r for r in range(1, K + 1)]])
    if all(n[r] > 0 for r in range(1, K + 2)):
        lost = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - lost) / (1 - lost) if lost < 1 else 0
            if 0 < x < 1:
                d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray, bare) -> np.ndarray:
    """Counts with their discounts; ``bare``: of a context without any count up to ``K``."""
    return np.where(c > K, c - 0.5 * np.asarray(bare), d[np.minimum(c, K).astype(int)] * c)


def _tally(c: np.ndarray) -> list[int]:
    """Sum, number, and how many are 1 to K + 1, of the positive counts."""
    return [int(c.sum()), int((c > 0).sum()), *[int((c == r).sum()) for r in range(1, K + 2)]]


def _word_asks(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(pdfs):
        for pdf in pdfs:
            for _, row in pdf.iterrows():
                b = Block(row)
                counts = np.bincount(b.v, b.train, len(b.vocab)).astype(np.uint32)
                yield pd.DataFrame([(b.block, k, b.vocab[at].tobytes(), None, None, _pack(counts[at]), None) for k, at in _by_bucket(_mixed(b.vocab) % np.uint64(buckets))], columns=[x.split()[0] for x in ASK.split(", ")])

    return blocks.mapInPandas(run, ASK)


def _sum_words(pdf: pd.DataFrame) -> pd.DataFrame:
    words, counts = [np.frombuffer(x, np.uint64) for x in pdf["u"]], [_open(x, np.uint32) for x in pdf["k"]]
    _, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    cuts = np.cumsum([len(x) for x in words])[:-1]
    rows = [(b, k, 0, _pack(r.astype(np.uint64)), _pack(n.astype(np.uint32)), None) for b, k, r, n in zip(pdf["block"], pdf["bucket"], np.split(total[at], cuts), np.split(at, cuts), strict=True)]
    rows.append((-1, pdf["bucket"].iloc[0], 0, None, None, [*_tally(total), len(total)]))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in REPLY.split(", ")])


def _word_totals(b: Block, replies: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and numbers of a block's words; a number is the place in the word's bucket, and the bucket."""
    got = {k: (_open(t, np.uint64), _open(n, np.uint32)) for k, t, n in zip(replies["bucket"], replies["total"], replies["stats"], strict=True)}
    out, number = np.zeros(len(b.vocab), np.int64), np.zeros(len(b.vocab), np.uint64)
    for k, at in _by_bucket(_mixed(b.vocab) % np.uint64(buckets)):
        out[at], place = got[k]
        number[at] = place.astype(np.uint64) * np.uint64(buckets) + np.uint64(k)
    return out, number


def _is_hot(c: np.ndarray, model: Model, buckets: int) -> np.ndarray:
    """Contexts with more tokens than a bucket's fair share, so fewer than there are buckets."""
    return c * buckets > max(1, model.n)


def _pair_places(b: Block, c: np.ndarray, key: np.ndarray, model: Model, buckets: int) -> np.ndarray:
    """Bucket of each distinct pair: by context, and by word too for hot contexts."""
    u, v = key // len(b.vocab), key % len(b.vocab)
    split = np.where(_is_hot(c, model, buckets), np.minimum(buckets, 1 + c * 4 * buckets // max(1, model.n)), 1).astype(np.uint64)
    sub = _mixed(b.vocab[v] + np.uint64(7)) % split[u]
    return (_mixed(b.vocab[u] + np.uint64(3)) + sub) % np.uint64(buckets)


def _pair_asks(model: Model, buckets: int):
    def run(key, blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = Block(blocks.iloc[0])
        c, number = _word_totals(b, replies, buckets)
        number = number.astype(model.number)
        pair, _, count = b.pairs()
        rows = []
        for k, at in _by_bucket(_pair_places(b, c, pair, model, buckets)):
            u, runs = np.unique(pair[at] // len(b.vocab), return_counts=True)  # sorted already, as the pairs are
            v = pair[at] % len(b.vocab)
            rows.append((b.block, k, _pack(number[u]), _pack((runs * 2 + _is_hot(c[u], model, buckets)).astype(np.uint32)), _pack(number[v]), _pack(count[at]), _pack(c[v].astype(np.uint32))))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ASK.split(", ")])

    return run


def _sum_pairs(model: Model):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us = [_open(x, model.number) for x in pdf["u"]]
        runs = [_open(x, np.uint32).astype(np.int64) for x in pdf["runs"]]
        names, ui = np.unique(np.concatenate(us), return_inverse=True)
        hot = np.zeros(len(names), bool)
        hot[ui[np.concatenate(runs) % 2 == 1]] = True
        runs = [x // 2 for x in runs]
        u = np.repeat(ui, np.concatenate(runs))
        v = np.concatenate([_open(x, model.number) for x in pdf["v"]])
        k, cv = (np.concatenate([_open(x, np.uint32) for x in pdf[c]]) for c in ("k", "cv"))
        order = np.lexsort((v, u))
        new = np.ones(len(order), bool)
        new[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        total = np.bincount(at, k).astype(np.int64)
        first = order[new]
        # for each context: how many of its words occur 1 to K times and more, and the sum of their word probabilities
        stats = np.zeros((len(names), K + 2))
        for r in range(1, K + 2):
            stats[:, r - 1] = np.bincount(u[first], total == r if r <= K else total > K, len(names))
        stats[:, K + 1] = np.bincount(u[first], np.where(total > 0, model.word_p(cv[first]), 0.0), len(names))
        rows, pos, upos = [], 0, 0
        for block, bucket, x, n in zip(pdf["block"], pdf["bucket"], us, runs, strict=True):
            reply = total[at[pos : pos + int(n.sum())]]
            # only contexts with a pair that training hasn't need their weight; hot ones get it from all their buckets
            own = ui[upos : upos + len(x)]
            lacks = np.logical_or.reduceat(reply == 0, np.cumsum(n) - n) & ~hot[own]
            mine = np.column_stack([stats[own] * lacks[:, None], _is_bare(stats[own])])
            rows.append((block, bucket, 1, _pack(reply.astype(np.uint32)), _pack(mine), None))
            pos, upos = pos + len(reply), upos + len(x)
        rows.append((-1, pdf["bucket"].iloc[0], 1, None, None, _tally(total)))
        if hot.any():
            rows.append((-2, pdf["bucket"].iloc[0], 1, _pack(names[hot].astype(np.uint64)), _pack(stats[hot]), None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in REPLY.split(", ")])

    return run


def _is_bare(stats: np.ndarray) -> np.ndarray:
    return (stats[:, :K].sum(axis=1) == 0) & (stats[:, K] > 0)


def _scores(model: Model, buckets: int):
    def run(key, blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = Block(blocks.iloc[0])
        c, number = _word_totals(b, replies[replies["kind"] == 0], buckets)
        got = {k: (t, s) for k, t, s in replies.loc[replies["kind"] == 1, ["bucket", "total", "stats"]].itertuples(index=False)}
        pair, at, _ = b.pairs()
        total, stats = np.zeros(len(pair), np.int64), np.zeros((len(b.vocab), K + 3))
        for k, place in _by_bucket(_pair_places(b, c, pair, model, buckets)):
            t, s = got[k]
            total[place] = _open(t, np.uint32)
            stats[np.unique(pair[place] // len(b.vocab))] += _open(s, np.float64).reshape(-1, K + 3)
        names, sums = model.hot
        if len(names):
            near = np.minimum(np.searchsorted(names, number), len(names) - 1)
            mine = names[near] == number
            stats[mine] = np.column_stack([sums, _is_bare(sums)])[near[mine]]
        u, v = pair // len(b.vocab), pair % len(b.vocab)
        p, bare = model.word_p(c), stats[:, K + 2] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            left = (stats[:, :K] * (1 - model.pair_d[1:]) * np.arange(1, K + 1)).sum(axis=1) + np.where(bare, 0.5 * stats[:, K], 0)
            weight = np.where(c > 0, left / c / (1 - stats[:, K + 1]), 1.0)
            seen = np.log10(discounted(total.astype(np.float64), model.pair_d, bare[u]) / c[u])
            log_p = np.where(total > 0, seen, np.log10(weight[u]) + np.log10(p[v]))
        base = np.log10((c + 1) / (model.n + model.v + 1))
        add = lambda x: np.add.reduceat(x, b.starts)
        ids = pd.array([None if i == NO_ID else int(i) for i in b.ids], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": b.held, "n_tokens": b.lens.astype(np.int64), "n_known": add((c > 0)[b.v].astype(np.int64)), "train_tokens": np.int64(model.n), "base_score": add(base[b.v]), "score": add(log_p[at])})

    return run


def _totals(replies: DataFrame) -> list[int]:
    sums = replies.filter("block = -1").select(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(K + 3)]).first()
    return [x or 0 for x in sums]


def _hot_sums(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot contexts, sorted, and their sums over all buckets: at most five rows a bucket."""
    rows = pairs.filter("block = -2").select("total", "stats").collect()
    if not rows:
        return np.empty(0, np.uint64), np.empty((0, K + 2))
    names, at = np.unique(np.concatenate([_open(r.total, np.uint64) for r in rows]), return_inverse=True)
    sums = np.zeros((len(names), K + 2))
    np.add.at(sums, at, np.concatenate([_open(r.stats, np.float64).reshape(-1, K + 2) for r in rows]))
    return names, sums


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return settled(lambda: _lm_scores(docs, id_col, text_col))


def _lm_scores(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = saved(text_blocks(texts))
    # a bucket's share of a block shrinks as the blocks grow in number, so what a bucket holds at once doesn't grow
    buckets = max(BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS_A_BLOCK * blocks.count())
    words = saved(_word_asks(blocks, buckets).groupBy("bucket").applyInPandas(_sum_words, REPLY))
    word_totals = _totals(words)
    model = Model(word_totals)
    widest = words.filter("block = -1").agg(F.max(F.col("m")[K + 3])).first()[0] or 0
    model.number = np.uint32 if widest * buckets < 1 << 32 else np.uint64
    mine = words.filter("block >= 0")
    asks = blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(_pair_asks(model, buckets), ASK)
    pairs = saved(asks.groupBy("bucket").applyInPandas(_sum_pairs(model), REPLY))
    model = Model(word_totals, _totals(pairs), _hot_sums(pairs))
    replies = mine.unionByName(pairs.filter("block >= 0"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_scores(model, buckets), out)
