"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A merge list decides each prefix's encoding by its last token: a token that ends at a position is the last
one if it may follow the last token of the prefix before it, that is if merging the two tokens' bytes gives
these two tokens again. The transducer goes through a piece byte by byte and keeps, for each
position, that one token. No token is longer than ``lookahead`` bytes, the merge list's sufficient
lookahead, so whatever follows starts from one of that many last positions; tokens that the paths
of all of them share are stable and are emitted. The state is these positions and what isn't stable yet.
Pieces come from the pre-tokenizer, which needs two characters of lookahead itself. Words
that recur take the transducer's earlier output from a bounded memory.

Decoding maps ids to bytes and runs an incremental byte-to-text machine that holds at most the bytes of
one unfinished character; bytes that are no UTF-8 become U+FFFD.

Null texts count as empty and give no tokens; every row gives one row, repeated ones too; an
empty table gives an empty result. Texts of any length are worked on in parts of ``PART`` characters: a part's ids are
hashed and decoded as they are emitted, so no text's ids are held unless the caller asks for them. A piece longer than
a part goes through the transducer by itself, and its ids leave in batches. Other columns of the table are left out, so their names can't clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import regex
from pyspark.sql import DataFrame

from .common import pick

PART, REMEMBERED, LONG = 1 << 16, 1_000_000, 48
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memory(dict):
    """The transducer's packed output for pieces that recur, bounded."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.merges.piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Merges:
    """Vocabulary and merge list of a byte-level tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("unk_token") or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files are supported")
        raw = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take more than their own text aren't supported")
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *special.values()]))
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.special = special
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.rank = {}
        for r, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[self.ids[a], self.ids[b]] = (r, self.ids[a + b])
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = max(map(len, self.ids))
        self.suffixes = {t[k:] for t in self.ids for k in range(len(t))}
        self.follows: dict[int, bool] = {}
        self.width = len(self.bytes_of)
        self.memory = _Memory(self)

    def merged(self, text: bytes) -> list[int]:
        """The merge list applied as it is defined: the lowest rank first, from the left."""
        ids, rank = [self.byte_id[b] for b in text], self.rank
        while True:
            best, at, new = 1 << 60, -1, 0
            for i in range(len(ids) - 1):
                r = rank.get((ids[i], ids[i + 1]))
                if r is not None and r[0] < best:
                    best, at, new = r[0], i, r[1]
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can come right after a; a = -1 is the piece's start."""
        key = (a + 1) * self.width + b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 2 * REMEMBERED:
                self.follows.clear()
            want = [b] if a < 0 else [a, b]
            known = self.follows[key] = self.merged(b"".join(self.bytes_of[x] for x in want)) == want
        return known

    def piece(self, data: bytes) -> Iterator[int]:
        """The transducer: ids of one piece, each as soon as it is stable."""
        ids, suffixes, follows, width = self.ids, self.suffixes, self.follows, self.width
        last, before, base, done = [-1], [0], 0, -1  # for positions base, base + 1, ...; done: the token before base
        for end in range(1, len(data) + 1):
            start, found = end - 1, -1
            # the longest token that fits is the last one of this prefix
            lowest = base
            candidates = []
            while start >= lowest:
                t = data[start:end]
                if t not in suffixes:
                    break
                if t in ids:
                    candidates.append((ids[t], start))
                start -= 1
            for t, s in reversed(candidates):
                a = last[s - base] if s > base else done
                known = follows.get((a + 1) * width + t)
                if known or (known is None and self.may_follow(a, t)):
                    found = t
                    last.append(t)
                    before.append(s)
                    break
            if found < 0:
                raise AssertionError("a byte-level vocabulary encodes everything")
            if end - base >= 4 * self.lookahead:
                # paths of all positions that a later token can start from, walked back until they meet
                live = set(range(max(base, end - self.lookahead), end + 1))
                while len(live) > 1:
                    p = max(live)
                    live.discard(p)
                    live.add(before[p - base] if p > base else base)
                meet = live.pop()
                if meet > base:
                    yield from self._path(last, before, base, meet)
                    done, base, last, before = last[meet - base], meet, last[meet - base :], before[meet - base :]
        yield from self._path(last, before, base, len(data))

    @staticmethod
    def _path(last: list[int], before: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = before[end - base]
        return out[::-1]

    def _plain(self, text: str, at: int, stop: int) -> Iterator[bytes]:
        """Packed ids of a stretch without special tokens, by parts."""
        part = PART
        while at < stop:
            end = min(at + part, stop)
            pieces = PIECES.findall(text, at, end)
            if end < stop:
                if len(pieces) < 3:
                    part *= 2
                    continue
                # what comes next can still change the last two pieces
                end -= len(pieces.pop()) + len(pieces.pop())
            if part > PART:
                for p in pieces:
                    ids = self.piece(p.encode("utf-8", "surrogatepass"))
                    while batch := array("I", islice(ids, PART)):
                        yield batch.tobytes()
            else:
                yield b"".join(map(self.memory.__getitem__, pieces))
            at, part = end, PART

    def stream(self, text: str) -> Iterator[bytes]:
        """The text's ids in native 32-bit integers, by parts, as they get stable; special tokens in it count as such."""
        at = 0
        for m in self.splitter.finditer(text) if self.splitter else ():
            yield from self._plain(text, at, m.start())
            yield struct.pack("=I", self.special[m[0]])
            at = m.end()
        yield from self._plain(text, at, len(text))

    def encode(self, text: str) -> array:
        """All ids of the text."""
        return array("I", b"".join(self.stream(text)))

    def decode(self, ids: array) -> Iterator[str]:
        """The text in parts."""
        return self.decode_stream(ids[k : k + PART] for k in range(0, len(ids), PART))

    def decode_stream(self, parts: Iterator[array]) -> Iterator[str]:
        """The text of each part of ids, but for an unfinished character, which the next part or the end completes."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for ids in parts:
            yield machine.decode(b"".join(map(table.__getitem__, ids)))
        yield machine.decode(b"", True)


_loaded: dict[str, Merges] = {}


def merges_of(content: str) -> Merges:
    """One copy for a worker's whole life."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Merges(content)
    return _loaded[key]


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content. Its size doesn't depend on the data; it goes to the executors once."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and ids (binary, little-endian) if asked for."""
    import sys

    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def row(m: Merges, text: str) -> tuple:
        hashed, decoded, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []

        def parts():
            nonlocal n
            for packed in m.stream(text):
                ids = array("I", packed)
                n += len(ids)
                yield ids
                if sys.byteorder == "big":
                    ids.byteswap()
                    packed = ids.tobytes()
                hashed.update(packed)
                if with_ids:
                    kept.append(packed)

        for part in m.decode_stream(parts()):
            decoded.update(part.encode("utf-8"))
        return (n, hashed.hexdigest(), decoded.hexdigest(), *([b"".join(kept)] * with_ids))

    def run(batches):
        import pyarrow as pa

        m = merges_of(content.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                cut = batch.slice(k, 512)
                rows = [row(m, text.as_py() or "") for text in cut.column(1)]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([cut.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns) + 1])

    texts = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
