"""Secret scan: fixed patterns, and a battery of randomness tests on what else looks like a key.

Null texts count as empty and every row gives one row. Positions are code points, ends exclusive. A match
of a pattern that is too short is dropped after matching, so it still uses up its characters. Everything
is a projection of the scan: no shuffle, no user function, and texts without any candidate cost one
regular-expression search.

The battery takes runs of 20 or more key characters, infers an encoding (hexadecimal, base 32, base 36, base 64)
and tests the run against a uniform draw from that alphabet: chi-squared for the letters' counts, the runs test above and
below the alphabet's middle, and the lag-one serial correlation. The smallest of the three p-values, times three,
is the run's; one under ``STRAY`` isn't random and goes. Names that are put together from words pass this battery when they are short, so
a second runs test has them as its null hypothesis: the number of changes between small and capital letters, digits and signs,
against that of identifiers (``word_null``, fitted for each encoding). Within a text the Benjamini-Hochberg rule on these p-values, with
weights by length, bounds the share of names among what is reported at ``FDR``: long runs, whose tests are strong, use
more of the allowed errors. What passes and carries at least ``MIN_BITS`` bits is reported as kind ``random``, unless a
pattern's span holds it already. Texts of any length are scanned whole, an empty table gives an empty result, and other columns
of the table are left out, so their names can't clash.
"""

from __future__ import annotations

import random
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

# The patterns of the base kinds and the least lengths.
ASSIGN = """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # a shorter run has no longer one inside, so the length can be asked for at once
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6

RUN = "[A-Za-z0-9+/_-]{20,}"
MIN_BITS, FDR, STRAY = 80.0, 0.05, 0.001
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": ("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    "HEX": ("^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": ("^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Places between two characters of different classes.
CHANGE = "|".join(f"(?<=[{c}])(?![{c}])(?!$)" for c in ("a-z", "A-Z", "0-9", "+/_-"))
#: Words of made-up names, and those that hexadecimal digits can write.
WORDS = "account address backup batch build cache client cluster config connection content controller counter database date default device document error event export factory field file filter first frame global group handler header image import index input instance item key label last layer list load local manager message method model module name network number object option order output page parent parser path port process project provider query queue reader record region release report request response result route schema server service session source stage status storage stream string system table target task template test thread time type update user value version view window worker".split()
HEX_WORDS = "add added bad bed beef cab cafe dad dead deaf decade face facade fade fed feed".split()
#: Sorts by start, then kind as listed.
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def _spans(t: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """(start, end, kind, text of the group) of all matches: lengths of the gaps and matches, summed up."""

    def place(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + F.length(x["gap"])
            e = s + F.length(x["m"])
            one = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["g"].alias("v"))
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        return F.aggregate(parts, zero, step, lambda a: a["out"])

    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found))
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("m"), groups.alias("g"))
    return F.when(t.rlike(pattern), let(parts, place)).otherwise(F.array().cast(SPAN))


def _tail(z: Column) -> Column:
    """P(Z > z) of a normal Z, by the logistic fit with a cubic term (error under 0.0002)."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(x * 1.5976 + x * x * x * 0.07056))


@cache
def word_null(seed: int = 5, names: int = 4000) -> dict[str, tuple[float, float]]:
    """For each encoding the mean rate of class changes in made-up names and their variance a place."""
    rng = random.Random(seed)

    def name(kind: str) -> str:
        words, out, least = HEX_WORDS if kind.lower() == "hex" else WORDS, "", rng.randrange(20, 41)
        digits = "234567" if kind == "base32" else "0123456789"
        join = rng.choice(["", "", "_", "-"]) if kind == "base64" else ""
        while len(out) < least:
            w = rng.choice(words)
            w = w.upper() if kind in ("HEX", "base32") else w.capitalize() if kind == "base64" and not (join and rng.random() < 0.5) else w
            out += (join if out else "") + w
            if rng.random() < 0.2:
                out += "".join(rng.choice(digits) for _ in range(rng.randrange(1, 5)))
        return out

    fitted = {}
    for kind in ALPHABETS:
        made = [name(kind) for _ in range(names)]
        counts = [(len(re.findall(CHANGE, x)), len(x) - 1) for x in made]
        rate = sum(c for c, _ in counts) / sum(n for _, n in counts)
        fitted[kind] = rate, sum((c - rate * n) ** 2 / n for c, n in counts) / names
    return fitted


def _p_word(v: Column, letters: Column) -> Column:
    """That of at least the run's class changes in a made-up name."""
    n = (F.length(v) - 1).cast("double")
    by_kind = lambda i: F.coalesce(*[F.when(letters == abc, F.lit(word_null()[k][i])) for k, (_, abc) in ALPHABETS.items()])
    return _tail((F.regexp_count(v, F.lit(CHANGE)) - by_kind(0) * n - 0.5) / F.sqrt(by_kind(1) * n))


def _encoding(v: Column) -> Column:
    out = F.lit("")
    for _, (pattern, letters) in reversed(ALPHABETS.items()):
        out = F.when(v.rlike(pattern), F.lit(letters)).otherwise(out)
    return out


def _p_value(v: Column, letters: Column) -> Column:
    """That of the run ``v`` under a uniform draw from ``letters``."""
    url = F.translate(v, "-_", "+/")
    n, a = F.length(v).cast("double"), F.length(letters).cast("double")
    codes = F.transform(F.split(url, "(?!$)", -1), lambda c: (F.instr(letters, c) - 1).cast("double"))
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, x: s + f(x))

    def battery(x: Column) -> Column:
        squares = total(F.array_distinct(x), lambda c: F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0)))
        chi = squares * a / n - n
        z1 = (chi - (a - 1)) / F.sqrt((a - 1) * 2 * (n - 1) / n)
        high = F.transform(x, lambda c: c * 2 >= a - 1)
        n1 = total(high, lambda b: b.cast("double"))
        following = F.sequence(F.lit(1), F.size(x) - 1)
        turns = total(following, lambda i: (high[i] != high[i - 1]).cast("double")) + 1
        mu = n1 * 2 * (n - n1) / n + 1
        z2 = (turns - mu) / F.sqrt(F.greatest(F.lit(1e-9), (mu - 1) * (mu - 2) / (n - 1)))
        mean = total(x, lambda c: c) / n
        spread = F.greatest(F.lit(1e-9), total(x, lambda c: (c - mean) * (c - mean)))
        r = total(following, lambda i: (x[i] - mean) * (x[i - 1] - mean)) / spread
        z3 = (r + 1 / n) * F.sqrt(n)
        least = F.least(_tail(z1), _tail(F.abs(z2)) * 2, _tail(F.abs(z3)) * 2)
        return F.least(F.lit(1.0), least * 3)

    return let(codes, battery)


def _random_runs(t: Column) -> Column:
    """Spans of the runs that the battery calls random, with the false-discovery rule over the text's runs against names."""
    runs = _spans(t, RUN, KINDS.index("random"))
    coded = F.filter(F.transform(runs, lambda r: F.struct(r.alias("r"), _encoding(r["v"]).alias("abc"))), lambda x: x["abc"] != "")
    tested = F.transform(coded, lambda x: F.struct(x["r"].alias("r"), x["abc"].alias("abc"), _p_value(x["r"]["v"], x["abc"]).alias("p"), _p_word(x["r"]["v"], x["abc"]).alias("name")))

    def control(runs: Column) -> Column:
        m = F.size(runs)
        lengths = F.aggregate(runs, F.lit(0.0), lambda s, x: s + F.length(x["r"]["v"]))
        weighted = F.transform(runs, lambda x: x["name"] * lengths / (F.length(x["r"]["v"]) * m))
        ranked = F.sort_array(weighted)
        passed = F.filter(F.transform(ranked, lambda p, i: F.when(p <= (i + 1) * F.lit(FDR) / m, p).otherwise(F.lit(-1.0))), lambda p: p >= 0)
        limit = F.coalesce(F.array_max(passed), F.lit(-1.0))
        bits = lambda x: F.length(x["r"]["v"]) * F.log2(F.length(x["abc"]))
        stays = F.filter(runs, lambda x, i: (weighted[i] <= limit) & (x["p"] >= STRAY) & (bits(x) >= MIN_BITS))
        return F.transform(stays, lambda x: x["r"])

    return F.when(t.rlike(RUN), let(tested, control)).otherwise(F.array().cast(SPAN))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, found (span structs)."""
    t = F.col("t")
    assign = F.filter(_spans(t, ASSIGN, 0, 2), lambda x: F.length(x["v"]) >= ASSIGN_LEAST)
    texts = pick(docs, doc_id=id_col, t=text_col).select("doc_id", F.coalesce("t", F.lit("")).alias("t"))
    found = texts.select("doc_id", assign.alias("a"), _spans(t, ACCESS, 1).alias("c"), _spans(t, HEX, 2).alias("h"), _random_runs(t).alias("r"))
    base = found.withColumn("base", F.sort_array(F.concat("a", "c", "h")))
    new = F.filter("r", lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))
    full = base.withColumn("new", new).withColumn("found", F.sort_array(F.concat("base", "new")))
    count = lambda c: F.size(c).cast("long")
    return full.select("doc_id", count("a").alias("n_assign"), count("c").alias("n_access"), count("h").alias("n_hex"), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("found")).alias("spans"), count("new").alias("n_random"), F.transform("found", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), F.array(*[F.lit(k) for k in KINDS])[x["k"]].alias("kind"))).alias("found"))
