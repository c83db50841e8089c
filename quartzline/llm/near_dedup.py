"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Equal sets form a class, and only
each class's smallest id goes on. For ``TREES`` independent trees, documents branch by selected minwise
tokens: the first is a whole minwise hash, the next are one or two coordinates of the sketch, chosen by the node's own hash, so
that pairs at the threshold are expected to go on together once. A pair at the threshold meets in the first node of a tree with odds 0.75,
so it is missed by all ten with odds of one in a million.

A node that fits in one task (``NODE`` documents and ``NODE_BYTES`` of sets) is compared there. Sketches come first: all pairs of a small
node; in others pivots with all, then the branching goes on in memory, until what no pivot resembles is few enough to be compared with all. They mark the documents that resemble any
other of another component. Only marked documents bring their full sets, in which an inverted index counts exact intersections; a document is no longer looked up once it is in
the node's largest component, as a link that matters has a side out of it. A node gives a star for each component that confirmed links make of its labels, not all pairs.

A larger node is dealt into chunks that fit, and its ``PIVOTS`` pivots go along to each of them. Then it branches, with the components
confirmed by then as labels, and so on until no large node is left; a node of a single component ends at once. The trees run in two
batches, and components that the first confirms are labels in the second, so that large groups of near copies go through few trees.
Nothing of a group's size is joined onto rows. Each step is a table in the shared folder, deleted once nothing reads it.

Null texts count as empty; a text without words has the empty set and is linked with nothing; one with fewer
words than a shingle has its whole sequence as the one shingle. A very long text is one set as any other. Rows with the same id are one document; if their
texts differ, the one with the smallest hash stands for it. Rows
without an id are never linked: their component is null and they aren't kept. Ties go to the smaller id. An empty table gives an empty result.
Columns are found by name, exactly first and without regard to case next; all others are left out.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, saved, settled
from .components import components

SHINGLE, PER_CENT = 5, 75
BATCHES = ((0, 1, 2), (3, 4, 5, 6, 7, 8, 9))
TREES = sum(map(len, BATCHES))
SKETCH, SMALL, PIVOTS, FEW = 96, 48, 4, 4_000_000
#: What one task compares: documents and bytes of their sets. A very long text may be more by itself.
NODE, NODE_BYTES = 8192, 24_000_000
#: Bits of the bitmaps that texts are looked up in before they are shuffled: 4 MB.
BITS = 1 << 25
#: Sketches estimate similarity with a deviation under 0.05; candidates may lie three and a half of them below the threshold.
MAYBE = 0.59
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Word hashes, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; bytes.split() splits at exactly the word separators."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(len(h), width)):
            out = _mix(out * _PRIME + h[k : k + n])
    return np.unique(out)


def minwise(sets: np.ndarray) -> np.ndarray:
    """The sketch: for each coordinate, the least value of its hash over the set."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(sets), 2048):
            v = (sets[k : k + 2048, None] ^ _XOR) * _ODD
            v ^= v >> np.uint64(32)
            out = np.minimum(out, (v * _PRIME).min(axis=0))
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set (null if empty), keys (one for each tree), sk (a byte for each coordinate)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for t in batch.column(1):
                s = shingles(t.as_py())
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = minwise(s)
                keys = _mix(m[:TREES] + np.arange(1, TREES + 1, dtype=np.uint64) * _PRIME)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), keys.view(np.int64).tolist(), ((m >> np.uint64(13)) & np.uint64(255)).astype(np.uint8).tobytes()))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "th", "n_shingles", "digest", "keys", "sk"])

    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("th", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, th long, n_shingles long, digest binary, keys array<long>, sk binary")


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(len(col), SKETCH)


def _alike(m: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which sketches may be within reach of ``one``: the share of equal bytes, less those that agree by chance."""
    return ((m == one).sum(axis=1) / SKETCH - 1 / 256) / (1 - 1 / 256) >= MAYBE


def _mark(m: np.ndarray, lab: np.ndarray, seed: int) -> np.ndarray:
    """Which documents of a node resemble one of another label. Only those not marked yet are asked for, so all pairs of a crowd aren't compared."""
    marked, rng, stack = np.zeros(len(m), bool), np.random.default_rng(seed & (2**63 - 1)), [np.arange(len(m))]

    def ask(at: np.ndarray, x: int) -> None:
        near = at[_alike(m[at], m[x]) & (lab[at] != lab[x])]
        if len(near):
            marked[x] = True
            marked[near] = True

    while stack:
        at = stack.pop()
        if (lab[at] == lab[at[0]]).all():
            continue
        if len(at) > SMALL:
            for x in rng.choice(at, PIVOTS, replace=False):
                ask(at, x)
        left = at[~marked[at]]
        if len(left) * len(at) <= FEW:
            for x in left:
                if not marked[x]:
                    ask(at, x)
            continue
        # one coordinate, or two for a third of the nodes: the threshold's 3/4 of pairs that agree, times 4/3
        for c in rng.choice(SKETCH, 2 if rng.integers(3) == 0 else 1, replace=False):
            order = at[np.argsort(m[at, c], kind="stable")]
            kids = np.split(order, np.flatnonzero(np.diff(m[order, c])) + 1)
            stack.extend(k for k in kids if 1 < len(k) < len(at) and not marked[k].all())
            if len(kids) == 1:  # all agree on it
                stack.append(at)
    return marked


def _links(ids: np.ndarray, lab: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The components that exact links give to the labels of one node's documents, as stars: (label, smallest label)."""
    up, n = {}, len(ids)
    sizes, every = np.array([len(x) for x in sets]), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owners = every[order], np.repeat(np.arange(n), sizes)[order]
    names, counts = np.unique(lab, return_counts=True)
    weight = dict(zip(names.tolist(), counts.tolist(), strict=True))
    home = max(weight, key=lambda x: (weight[x], -x))
    for x in np.argsort(_mix(ids.astype(np.uint64)), kind="stable"):
        if len(up) and _root(up, int(lab[x])) == home:
            continue
        lo, hi = np.searchsorted(every, sets[x]), np.searchsorted(every, sets[x], "right")
        runs = hi - lo
        at = np.arange(runs.sum()) + np.repeat(lo - np.cumsum(runs) + runs, runs)
        both = np.bincount(owners[at], minlength=n)
        for y in np.unique(lab[100 * both >= PER_CENT * (sizes + len(sets[x]) - both)]).tolist():
            a, b = sorted((_root(up, int(lab[x])), _root(up, y)))
            if a != b:  # the smaller label stays
                up[b] = a
                weight[a] += weight[b]
                if weight[a] >= weight[home] or home == b:
                    home = a
    return [(x, _root(up, x)) for x in names.tolist() if _root(up, x) != x]


def _root(up: dict, x):
    while up.get(x, x) != x:
        up[x] = x = up.get(up[x], up[x])
    return x


def _units(batches, *cols: str):
    """Arrow tables of whole units (node and chunk) with all of ``cols``, from batches sorted by these; and each row's unit number."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch])
        key = np.stack([t["node"].to_numpy(), t["chunk"].to_numpy().astype(np.int64)])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        last = int(np.flatnonzero(new)[-1])  # the last unit may go on in the next batch
        held = t.slice(last).to_batches()
        if last:
            yield t.slice(0, last), np.cumsum(new[:last]) - 1
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.zeros(t.num_rows, np.int64)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "chunk").sortWithinPartitions("node", "chunk", "id")


def marked(rows: DataFrame) -> DataFrame:
    """(node, chunk, id, lab) of the rows (node, chunk, id, lab, sk) whose sketch resembles one of another label in their unit."""

    def run(batches):
        for t, unit in _units(batches):
            m, lab, n = _matrix(t["sk"].to_pylist()), t["lab"].to_numpy(), np.bincount(unit)
            out = np.zeros(len(unit), bool)
            small = np.flatnonzero(n[unit] <= SMALL)  # all of these at once: each with the d-th after it
            for d in range(1, SMALL):
                i, j = small[:-d], small[d:]
                same = unit[i] == unit[j]
                if not same.any():
                    break
                same &= lab[i] != lab[j]
                i, j = i[same], j[same]
                near = _alike(m[i], m[j])
                out[i[near]] = True
                out[j[near]] = True
            for u in np.flatnonzero(n > SMALL):
                at = np.flatnonzero(unit == u)
                out[at] = _mark(m[at], lab[at], t["node"][int(at[0])].as_py())
            yield from t.select(["node", "chunk", "id", "lab"]).filter(out).to_batches()

    return _dealt(rows.select("node", "chunk", "id", "lab", "sk")).mapInArrow(run, "node long, chunk int, id long, lab long")


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``wanted``: all that are, and those whose hash falls on the same one of ``BITS``.

    It keeps the texts that nobody asks for out of the exact join's shuffle; the bitmaps are as large for any input.
    """
    h = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bucket, at = F.bitmap_bucket_number(h), F.bitmap_bit_position(h)
    # dealt by bucket first, so that map tasks don't each send a part of every bitmap
    maps = wanted.select(bucket.alias("bucket"), at.alias("at")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(maps), (bucket == F.col("bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def confirmed(marks: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) on the full sets of whole texts that join the labels of each unit of ``marks`` wherever any of its documents reach the threshold."""

    def as_sets(batches):
        import pyarrow as pa

        last, s = None, b""
        for batch in batches:
            out = []
            for i, t in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                if i != last:
                    last, s = i, shingles(t.as_py()).tobytes()
                out.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["node", "chunk", "id", "lab", "s"])

    def run(batches):
        import pyarrow as pa

        for t, unit in _units(batches):
            ids, lab, s = t["id"].to_numpy(), t["lab"].to_numpy(), t["s"]
            cuts = [*np.flatnonzero(np.diff(unit, prepend=-1)).tolist(), len(unit)]
            found = []
            for x, y in zip(cuts, cuts[1:]):
                found += _links(ids[x:y], lab[x:y], [np.frombuffer(v, np.uint64) for v in s.slice(x, y - x).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    wanted = marks.select(F.col("id").alias("doc_id")).distinct()
    texts = _likely(docs, wanted).join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    whole = marks.join(texts.withColumnRenamed("doc_id", "id"), "id").select("node", "chunk", "id", "lab", "text")
    return _dealt(whole.mapInArrow(as_sets, "node long, chunk int, id long, lab long, s binary")).mapInArrow(run, "a long, b long")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (node, id, sk, n_shingles, lab) of nodes with several labels, with their chunk and the number of chunks. A node's pivots are in all of them."""
    marks = [F.xxhash64("id", "node", F.lit(j)) for j in range(PIVOTS)]
    lowest = [F.min(h).alias(f"h{j}") for j, h in enumerate(marks)]
    counts = rows.groupBy("node").agg(F.greatest(F.ceil(F.count("*") / NODE), F.ceil(F.sum("n_shingles") * 8 / NODE_BYTES)).cast("int").alias("chunks"), F.min("lab").alias("l0"), F.max("lab").alias("l1"), *lowest)
    pivot = F.exists(F.array(*[h == F.col(f"h{j}") for j, h in enumerate(marks)]), lambda x: x)
    own = F.array(F.pmod(F.xxhash64("id", "node"), "chunks").cast("int"))
    chunk = F.explode(F.when((F.col("chunks") > 1) & pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)).alias("chunk")
    return rows.join(counts.filter("l0 <> l1"), "node").select("node", chunk, "id", "lab", "sk", "n_shingles", "chunks")


def _branched(placed: DataFrame, comps: DataFrame) -> DataFrame:
    """The children of the nodes that had to be dealt into chunks, with the components known by now as labels."""
    c = lambda k: F.pmod(F.xxhash64("node", F.lit(100 + k)), F.lit(SKETCH)).cast("int")
    child = lambda k: F.xxhash64("node", c(k), F.substring("sk", c(k) + 1, F.lit(1)))
    both = F.pmod(F.xxhash64("node", F.lit(99)), F.lit(3)) == 0
    kids = F.when(both & (c(0) != c(1)), F.array(child(0), child(1))).otherwise(F.array(child(0)))
    large = placed.filter("chunks > 1").dropDuplicates(["node", "id"]).join(comps, "id", "left")
    return large.select(F.explode(kids).alias("node"), "id", "sk", "n_shingles", F.coalesce("comp", "id").alias("lab"))


def near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Component of each linked representative: (id, comp)."""
    comps = None
    for trees in BATCHES:
        known = reps.withColumn("lab", F.col("id")) if comps is None else reps.join(comps, "id", "left").withColumn("lab", F.coalesce("comp", "id"))
        rows = known.select(F.explode(F.array(*[F.col("keys")[t] for t in trees])).alias("node"), "id", "sk", "n_shingles", "lab")
        while True:
            placed = saved(_placed(rows))
            links = confirmed(saved(marked(placed)), docs)
            comps = components(links if comps is None else links.unionByName(comps.toDF("a", "b")))
            if placed.filter("chunks > 1").isEmpty():
                break
            rows = _branched(placed, comps)
    return comps


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    return settled(lambda: _near_dedup(docs, id_col, text_col))


def _near_dedup(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = saved(sketches(base))
    # one set an id, and one id a set
    ids = saved(known.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("th", "digest"))["digest"].alias("digest")))
    classes = saved(ids.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = known.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).select(F.col("doc_id").alias("id"), "keys", "sk", "n_shingles").dropDuplicates(["id"])
    comps = near_links(base.filter("doc_id is not null"), saved(reps))
    of = ids.join(classes, "digest").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    out = known.select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns of ``docs``; rows without an id go."""
    names = docs.columns
    at = [i for i, c in enumerate(names) if c == id_col] or [i for i, c in enumerate(names) if c.lower() == id_col.lower()]
    kept = near_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"))
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    k = f"__c{at[0]}"
    return plain.join(kept.distinct(), plain[k].cast("long") == F.col("__id"), "left_semi").dropDuplicates([k]).toDF(*names)
