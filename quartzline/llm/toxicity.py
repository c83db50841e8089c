"""Toxicity: a learned lexicon, matched by Levenshtein automata, with context windows.

The lexicon comes from labelled training texts: words, and word beginnings (terms that end in ``*``), that are far more
frequent in texts of label 1. Whole words may be misspelled, by one edit from five letters on and by two from nine on. The automaton is the
product of the lexicon's trie with the edits: a set of (trie node, edits, begun term) that is made deterministic state by
state as words need it, so a word costs one step a letter.

Each hit weighs by its term, less per edit. A window around it tells quotation (quotation marks, words of saying)
from abuse (words that address someone); the two sums are separate features, with the density of hits, of a logistic
regression that gives the score. Only the text is ever an input.

It is fitted on a bounded sample of training rows: at most ``SAMPLE`` of each label, those with the least hash of the id; the
intercept is set back to the share of label 1 among all training labels. Rows are for training if crc32(doc_id as text) mod
5 is not 0; unlabelled, null and conflicting labels aren't used. Without rows of both labels, the score is that share (0.5
without labels). Null texts count as empty; every row gives one row, repeated ones too; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

FOLDS, SAMPLE, TERMS, WINDOW = 5, 2500, 300, 4
LEAST_DOCS, LEAST_RATIO, BEGINNINGS = 4, 6.0, (3, 4, 5, 6, 7, 8)
EDGE = "\"'“”«»‘’.,;:!?()[]{}<>|#%&*$-_…"
QUOTES = "\"“”«»"
SAYING = frozenset("said says say wrote writes quote quoted quoting called word term dit écrit sagte schrieb dijo".split())
ADDRESS = frozenset("you your youre you're u ur yourself tu te toi du dich dir vous usted".split())
FEATURES = 7


def in_training(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS != 0


def allowed(term: str) -> int:
    """Edits that still match a term."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie, determinised as needed."""

    MOST_STATES = 200_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.edits, self.ends, self.begins = [0], [None], [None]
        for k, term in enumerate(terms):
            node = 0
            self.edits[0] = max(self.edits[0], allowed(term))
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                    self.ends.append(None)
                    self.begins.append(None)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], allowed(term))
            (self.begins if term.endswith("*") else self.ends)[node] = k
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict = {}
        self.states: list = []
        self.steps: list[dict[str, int]] = []
        self.first = self._number(self._closed({(0, 0, -1)}))

    def _closed(self, state: set) -> frozenset:
        """With letters left out, and term beginnings noted."""
        todo, out = list(state), set()
        while todo:
            s = todo.pop()
            if s in out:
                continue
            out.add(s)
            node, e, begun = s
            if node < 0:
                continue
            if self.begins[node] is not None and e == 0:
                todo.append((-1, 0, self.begins[node]))
            todo += [(n, e + 1, begun) for n in self.children[node].values() if e + 1 <= self.edits[n]]
        return frozenset(out)

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def _step(self, number: int, c: str) -> int:
        to = set()
        for node, e, begun in self.states[number]:
            if node < 0:
                to.add((node, e, begun))
                continue
            for letter, n in self.children[node].items():
                cost = e + (letter != c)
                if cost == 0 or cost <= self.edits[n]:
                    to.add((n, cost, begun))
            if e + 1 <= self.edits[node]:
                to.add((node, e + 1, begun))
        to = self._number(self._closed(to))
        self.steps[number][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best match: fewest edits, then the whole word, then the first term."""
        if len(self.states) > self.MOST_STATES:
            self._reset()
        at, steps = self.first, self.steps
        for c in word:
            to = steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if not self.states[at]:
                return None
        found = []
        for node, e, begun in self.states[at]:
            if node < 0:
                found.append((0, 1, begun))
            elif self.ends[node] is not None and e <= allowed(self.terms[self.ends[node]]):
                found.append((e, 0, self.ends[node]))
        return (min(found)[2], min(found)[0]) if found else None


@dataclass
class Lexicon:
    terms: list[str]
    weights: list[float]
    coef: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))

    def ready(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton, self.known = lexicon, Automaton(lexicon.terms), {}

    def hit(self, raw: str):
        """(weight less edits) of a word as it stands in the text, or None."""
        try:
            return self.known[raw]
        except KeyError:
            if len(self.known) > 300_000:
                self.known.clear()
            m = self.automaton.match(raw.lower().strip(EDGE)) if self.lexicon.terms else None
            out = self.known[raw] = m and self.lexicon.weights[m[0]] * (0.7 ** m[1])
            return out

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        found = [(k, w) for k, w in enumerate(map(self.hit, words)) if w]
        abuse = quoted = addressed = most = 0.0
        for k, w in found:
            window = words[max(0, k - WINDOW) : k + WINDOW + 1]
            near = {x.lower().strip(EDGE) for x in window}
            marks = words[k][:1] in QUOTES or any(x[:1] in QUOTES for x in words[max(0, k - WINDOW) : k]) and any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in words[k : k + WINDOW + 1])
            if marks or near & SAYING:
                quoted += w
            else:
                abuse += w
                addressed += w * bool(near & ADDRESS)
                most = max(most, w)
        n = len(words)
        return [math.log1p(abuse), abuse / math.sqrt(n + 10), abuse / (n + 10), most, math.log1p(quoted), math.log1p(addressed), math.log1p(len(found))]

    def score(self, text: str | None) -> float:
        z = self.lexicon.coef[0] + sum(a * b for a, b in zip(self.lexicon.coef[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(rows: list[tuple[str | None, int]]) -> Lexicon:
    """Terms that are far more frequent in texts of label 1, by the odds of their document frequencies."""
    n, df = Counter(), (Counter(), Counter())
    for text, y in rows:
        words = {x.lower().strip(EDGE) for x in (text or "").split()}
        # a beginning counts by how many different words of the text begin so, as a whole word can't
        starts = Counter(w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k)
        n[y] += 1
        df[y].update(words)
        df[y].update({s: c / max(1, len(words)) ** 0.5 for s, c in starts.items()})
    scored = []
    for t, a in df[1].items():
        ratio = ((a + 0.1) / (n[1] + 1)) / ((df[0][t] + 0.5) / (n[0] + 1))
        if t and a >= LEAST_DOCS and ratio >= LEAST_RATIO:
            scored.append((a * math.log(ratio), -len(t), t, math.log(ratio)))
    terms, weights, taken = [], [], []
    for _, _, t, w in sorted(scored, reverse=True):
        if len(terms) < TERMS and not any(t.startswith(p) or p.startswith(t.rstrip("*")) for p in taken):
            terms.append(t)
            weights.append(w)
            if t.endswith("*"):
                taken.append(t[:-1])
    return Lexicon(terms, weights)


def fit(rows: list[tuple[str | None, int]], share: float) -> Lexicon:
    """Lexicon and regression. Terms are learned on one half and the regression on the other, and then on all, so that the weights aren't too sure."""
    ys = [y for _, y in rows]
    logit = lambda p: math.log(max(p, 1e-3) / max(1 - p, 1e-3))
    if len(set(ys)) < 2:
        return Lexicon([], [], [logit(share)] + [0.0] * FEATURES)
    halves = rows[::2], rows[1::2]
    x, y = [], []
    for a, b in (halves, halves[::-1]):
        scorer = learn_lexicon(a).ready()
        x += [scorer.features(t) for t, _ in b]
        y += [v for _, v in b]
    x, y = np.array(x), np.array(y, float)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [1.0] * FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    coef = w[1:] / sd
    lexicon = learn_lexicon(rows)
    lexicon.coef = [float(w[0] - coef @ mean + logit(share) - logit(y.mean())), *map(float, coef)]
    return lexicon


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic). The sample's ids are bounded, so they go to the texts."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0
    sure = labels.filter(fold & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y1")).filter("y = y1")
    n = {r.y: r.n for r in sure.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [sure.filter(F.col("y") == y).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    rows = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).collect()
    rows = sorted(((r.doc_id, r.text, r.y) for r in rows), key=lambda r: zlib.crc32(b"half%d" % r[0]))
    return fit([(t, y) for _, t, y in rows], n.get(1, 0) / sum(n.values()) if n else 0.5)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = pick(labels, doc_id="doc_id", toxic=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null")
    model = docs.sparkSession.sparkContext.broadcast(train(texts, known))

    def run(batches):
        import pyarrow as pa

        scorer = model.value.ready()
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(1)]
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
