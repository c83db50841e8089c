"""Scalar functions as Columns; the two that Spark lacks are Arrow UDFs for distinct labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(x: Column) -> Column:
    """Trims all white space, also what is not ASCII."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def slug_text(label: str | None) -> str | None:
    if label is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c)).lower()
    out, gap = [], False
    for c in plain:
        if c.isascii() and c.isalnum():
            if gap and out:
                out.append("-")
            out.append(c)
            gap = False
        else:
            gap = True
    return "".join(out)


@F.pandas_udf(T.StringType())
def slug_udf(labels: pd.Series) -> pd.Series:
    seen = {x: slug_text(x) for x in labels.unique()}
    return labels.map(lambda x: seen[x], na_action="ignore")


def slug(label: Column) -> Column:
    """Letters without marks, lower case, other runs as one hyphen. ASCII stays in the JVM."""
    ascii_slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(label.rlike("^[\\x00-\\x7F]*$"), ascii_slug).otherwise(slug_udf(label))


def node_id(kind: str, *parts: Column) -> Column:
    """``kind:part:part``; null and empty parts are left out."""
    return F.concat_ws(":", F.lit(kind), *[F.when(p != "", p) for p in parts])


def market_id(x: Column) -> Column:
    return node_id("market", x)


def event_id(x: Column) -> Column:
    return node_id("event", x)


def outcome_id(market: Column, label: Column) -> Column:
    return F.concat(F.lit("outcome:"), market, F.lit(":"), slug(label))


def slugged_id(kind: str, *labels: Column) -> Column:
    """Ids of teams, competitions, stages, groups, rounds, matches and constraints: ``kind`` and the labels' slugs."""
    return node_id(kind, *[slug(x) for x in labels])


def match_local_id(a: Column, b: Column, date: Column | None = None) -> Column:
    """``match:a-vs-b`` and the date, if there is one."""
    base = F.concat(slug(a), F.lit("-vs-"), slug(b))
    return node_id("match", base if date is None else F.concat_ws("-", base, date))


def json_list(x: Column) -> Column:
    """JSON text to array<string>; blank, malformed and other JSON give null, also with anything after the list. A null in it is written ``None``."""
    whole = F.from_json(F.concat(F.lit('{"v":'), x, F.lit(',"end":1}')), "v array<string>, end int")
    read = F.when(x.rlike("(?s)^\\s*\\[.*\\]\\s*$") & (whole["end"] == 1), whole["v"])
    return F.transform(read, lambda e: F.coalesce(e, F.lit("None")))


def iso_utc(ts: Column) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def to_epoch(x: Column) -> Column:
    """ISO text with or without offset (none: UTC) to seconds; unreadable text gives null."""
    return F.unix_seconds(F.try_to_timestamp(strip(x)))


def event_teams(title: Column) -> Column:
    """Sorted pair of the two sides of ``A vs. B - more``, else null."""
    head = F.replace(F.split(title, " - ", 2)[0], F.lit(" vs "), F.lit(" vs. "))
    sides = F.transform(F.split(head, " vs\\. "), strip)
    return F.when((F.size(sides) == 2) & (F.array_min(F.transform(sides, F.length)) > 0), F.array_sort(sides))


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(x, pattern, group)), F.lit(""))


def match_title(title: Column) -> Column:
    """struct(a, b, category) of ``A vs. B[ - category]``; all null if it is no such title."""
    # Fixed value: the pattern of match titles.
    pattern = "(?i)^(.+?)\\s+vs\\.\\s+(.+?)(?:\\s+-\\s+(.+))?$"
    a, b = (_part(strip(title), pattern, i) for i in (1, 2))
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, a).alias("a"), F.when(both, b).alias("b"), F.when(both, _part(strip(title), pattern, 3)).alias("category"))


def group_of_title(title: Column) -> Column:
    return F.upper(_part(strip(title), "(?i)^World Cup Group ([A-L]) Winner$"))


def elimination_team(title: Column) -> Column:
    return _part(strip(title), "(?i)^World Cup:\\s+(.+?)\\s+Stage of Elimination$")


def winner_team(question: Column) -> Column:
    """The team that a question ``Will T win the ... World Cup?`` asks about."""
    return _part(question, "^Will (.+?) win the .+ World Cup\\?$")


def is_draw(title: Column) -> Column:
    return F.coalesce(title.rlike("(?i)^Draw\\s*\\("), F.lit(False))


def slug_date(x: Column) -> Column:
    """The first date in a slug, as its text."""
    return _part(x, "(\\d{4}-\\d{2}-\\d{2})")


def slug_codes(x: Column) -> Column:
    """struct(a, b): the two team codes at the front of a match slug, in lower case."""
    pattern = "(?i)^fifwc-([a-z]{2,3})-([a-z]{2,3})-"
    return F.struct(F.lower(_part(x, pattern, 1)).alias("a"), F.lower(_part(x, pattern, 2)).alias("b"))


def match_alias(x: Column) -> Column:
    """The slug of a match without what follows its date; a slug without codes or date stays."""
    codes = slug_codes(x)
    return F.coalesce(F.concat(F.lit("fifwc-"), codes["a"], F.lit("-"), codes["b"], F.lit("-"), slug_date(x)), F.nullif(x, F.lit("")))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, or null."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None).cast("string")


def canonical_name(name: Column, aliases: dict[str, str]) -> Column:
    """The alias table's name for a name, or the name."""
    return F.coalesce(lookup(aliases, name), name)


def code_aliases(code: Column, team: Column, codes: dict[str, str], aliases: dict[str, str]) -> Column:
    """Aliases that a code gives a team: the code itself; the mapped name and its slug only where the code stands for this very team."""
    mapped = lookup(codes, F.lower(code))
    own = slug(canonical_name(mapped, aliases)) == slug(team)
    return F.when(code.isNull(), F.array().cast("array<string>")).when(own, F.array(code, canonical_name(mapped, aliases), slug(canonical_name(mapped, aliases)))).otherwise(F.array(code))


def dated_match(match_id: Column) -> Column:
    """struct(teams, day) of a match id that ends in a calendar date; both null for others."""
    pattern = "^(match:.+)-(\\d{4}-\\d{2}-\\d{2})$"
    day = F.try_to_date(F.nullif(F.regexp_extract(match_id, pattern, 2), F.lit("")), "yyyy-MM-dd")
    return F.struct(F.when(day.isNotNull(), F.regexp_extract(match_id, pattern, 1)).alias("teams"), day.alias("day"))


def more_specific(candidate: Column, current: Column) -> Column:
    """Whether one match id goes on where another ends, as a dated one does after one without date."""
    return current.startswith("match:") & candidate.startswith(F.concat(current, F.lit("-")))


def near_date(a: Column, b: Column, days: int = 1) -> Column:
    """Whether two dated match ids are of the same teams, at most ``days`` apart."""
    x, y = dated_match(a), dated_match(b)
    return F.coalesce((x["teams"] == y["teams"]) & (F.abs(F.datediff(x["day"], y["day"])) <= days), F.lit(False))


def may_bind(existing: Column, candidate: Column) -> Column:
    """Whether two match ids may be one fixture."""
    other = ~existing.startswith("match:") | ~candidate.startswith("match:")
    return other | (existing == candidate) | more_specific(candidate, existing) | more_specific(existing, candidate) | near_date(existing, candidate)


def upgrade_target(existing: Column, existing_method: Column, candidate: Column, method: Column) -> Column:
    """The match id that replaces an existing one, or null: the more specific; near dates go to the official, else to the later."""
    official = F.lit("official_bracket")
    later = dated_match(candidate)["day"] >= dated_match(existing)["day"]
    near = F.when(method == official, candidate).when(existing_method == official, None).when(later, candidate)
    return F.when(candidate == existing, None).when(more_specific(candidate, existing), candidate).when(near_date(existing, candidate), near)


def preferred_method(existing: Column, incoming: Column) -> Column:
    official, some = F.lit("official_bracket"), lambda x: F.nullif(x, F.lit(""))
    return F.when((existing == official) | (incoming == official), official).otherwise(F.coalesce(some(existing), some(incoming), F.lit("unknown")))


def kickoff_date(x: Column) -> Column:
    return F.when(F.length(x) >= 10, F.substring(x, 1, 10))


def chunk_tokens(n_markets: Column, most: int, each: int = 120, slack: float = 1.5) -> Column:
    """Output tokens allowed for a chunk: an estimate a market with some slack, up to a limit."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n_markets * each * slack))).cast("int")


def compact_json(*cols: str | Column) -> Column:
    """One JSON object of the columns, with nulls, without white space."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def path_safe(x: Column) -> Column:
    # Fixed value: the pattern of ids that may be file names. \\z, as $ would let a line end pass.
    return x.rlike("^(?!.*__)[A-Za-z0-9._-]+\\z") & ~x.isin(".", "..")


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def proposition_key(p: Column) -> Column:
    """``[!]predicate(k=v,...)`` with sorted arguments, then the comparator, value, unit and times that are set."""
    args = F.transform(F.array_sort(F.map_entries(p["arguments"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    tail = F.concat_ws("|", *[F.concat(F.lit(f"{n}="), p[c].cast("string")) for n, c in (("cmp", "comparator"), ("val", "value"), ("unit", "unit"), ("start", "time_start"), ("end", "time_end"))])
    base = F.concat(F.when(p["polarity"], "").otherwise("!"), p["predicate"], F.lit("("), F.array_join(args, ","), F.lit(")"))
    return F.concat(base, F.when(tail != "", F.concat(F.lit("|"), tail)).otherwise(""))


def token_sort(a: str, b: str) -> float:
    """200 * longest common subsequence / total length, of the sorted words."""
    x, y = (" ".join(sorted(t.split())) for t in (a, b))
    if not x and not y:
        return 100.0
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    return pd.Series([seen[p] if p in seen else seen.setdefault(p, token_sort(*p)) for p in zip(a, b, strict=True)])
