"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Null texts count as empty. A text without words has zeros everywhere and fails. Ratios are written as
products, so nothing is divided by zero. Every row gives one row, repeated ones too; an empty table
gives an empty result. Very long texts are sorted within their row, by 64-bit hashes of their windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, pick, words_of

SYMBOLS = "[#*$%&|<>]"
#: Frequent short words of the corpus's languages.
STOP_WORDS = "the of and to in is that it for de la le et les des que el en los un der die und das den von zu a".split()


COUNTS = ("n_words", "word_chars", "n_symbols", "n_exclaim", "n_letters", "n_upper", "n_lines", "n_dup_lines", "n_distinct", "n_stop", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``left > limit / 100 * right`` (or ``<`` with ``below``), for texts of ``from_words`` words and more."""

    name: str
    left: str
    limit: int
    right: str
    from_words: int = 0
    below: bool = False


#: The threshold table: counts are fields of ``counts_of``; limits are per cent.
RULES = (
    Rule("symbols", "n_symbols", 40, "n_words"),
    Rule("shouting", "n_upper", 50, "n_words", 10),
    Rule("exclaiming", "n_exclaim", 50, "n_words", 10),
    Rule("repeated lines", "n_dup_lines", 45, "n_lines"),
    Rule("short words", "word_chars", 200, "n_words", 10, below=True),
    Rule("long words", "word_chars", 3000, "n_words"),
    Rule("few letters", "n_letters", 25, "word_chars", 10, below=True),
    Rule("few different words", "n_distinct", 10, "n_words", 50, below=True),
    Rule("nothing but stop words", "n_stop", 95, "n_words", 20),
)


def counts_of(t: Column) -> Column:
    """Struct of all counts of a non-null text."""
    size = lambda c: F.size(c).cast("long")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    stops = F.array(*[F.lit(x) for x in STOP_WORDS])

    def with_words(w: Column) -> Column:
        # element by element: slice() would copy the whole array for each window
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[w[i + k] for k in range(5)]))
        repeated = lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), _covered(win)).otherwise(0)
        return F.struct(
            size(w).alias("n_words"),
            F.when(F.size(w) >= 6, let(windows, repeated)).otherwise(0).cast("long").alias("n_repeat_words"),
            size(F.array_distinct(w)).alias("n_distinct"),
            size(F.filter(w, lambda x: F.array_contains(stops, x))).alias("n_stop"),
        )

    def joined(a: Column) -> Column:
        return let(
            F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            lambda lines: F.struct(
                *[a[c].alias(c) for c in ("n_words", "n_repeat_words", "n_distinct", "n_stop")],
                F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
                count(SYMBOLS).alias("n_symbols"),
                count("!").alias("n_exclaim"),
                F.length(F.regexp_replace(t, "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
                count("(?<![^\\x20\\x09-\\x0D])\\p{Lu}{2}[^\\p{Ll}\\x20\\x09-\\x0D]*+(?![^\\x20\\x09-\\x0D])").alias("n_upper"),
                size(lines).alias("n_lines"),
                (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
            ),
        )

    return let(let(words_of(t), with_words), joined)


def _covered(win: Column) -> Column:
    """Words in windows that occur twice or more: the windows' starts, sorted, each cover up to five words."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: s[a]["h"] == s[b]["h"]
        twice = F.filter(s, lambda x, k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k)) | ((k < last) & same(k, F.least(k + 1, last))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def cover(at: Column) -> Column:
        last = F.size(at) - 1
        steps = F.transform(at, lambda x, k: F.when(k < last, F.least(at[F.least(k + 1, last)] - x, F.lit(5))).otherwise(5))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, starts), cover)


def verdict_of(c: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column, Column]:
    """base_failed, broken (the first rule that rejects, or null) and kept, of a struct of counts."""

    def bad(rule: Rule) -> Column:
        left, right = c[rule.left] * 100, c[rule.right] * rule.limit
        return (left < right if rule.below else left > right) & (c["n_words"] >= rule.from_words)

    base = (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)
    broken = F.coalesce(*[F.when(bad(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string"))
    return base, broken, ~base & broken.isNull()


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document with its counts and the verdict."""
    row = let(counts_of(F.col("t")), lambda c: F.struct(*[c[n].alias(n) for n in COUNTS], *[v.alias(n) for n, v in zip(("base_failed", "broken", "kept"), verdict_of(c, rules), strict=True)]))
    return pick(docs, doc_id=id_col, t=text_col).select("doc_id", F.coalesce("t", F.lit("")).alias("t")).select("doc_id", F.inline(F.array(row)))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``; one filter, and the texts aren't shuffled."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    t = F.coalesce(F.col(f"__c{names.index(text_col)}"), F.lit(""))
    return plain.filter(let(t, lambda t: let(counts_of(t), lambda c: verdict_of(c, rules)[2]))).toDF(*names)
