"""Operator 6, URL filters with rules indexed by their rarest literal token.

A rule has a regular expression and the literal tokens that any URL it fits
must hold. Its index token is the one that the fewest URLs hold, counted over
the whole table. A URL's own tokens then fetch the rules of those tokens, and
only these expressions are run. All of it is one projection with built-in
functions: no shuffle beyond the token counts, whose number is bounded by the
rule list. A list of more than LITERAL rules is a table of its own instead:
tokens meet its index tokens in a join, and each URL's best fit is joined back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import table
from loomseq.sources.shared import cut

#: Rules up to this number are constants of the plan; beyond it they are a table.
LITERAL = 200


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and all its subdomains, where the URL's path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def host_pattern(self) -> str:
        return rf"(?s)\A(.*\.)?{re.escape(self.host)}\z"

    @property
    def pattern(self) -> str:
        """Of the path."""
        return rf"\A{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Host labels (h:) and whole path segments (p:)."""
        return sorted({f"h:{x}" for x in self.host.split(".") if x} | {f"p:{x}" for x in self.path.split("/")[1:-1] if x})


@dataclass(frozen=True)
class PatternRule:
    """A blocking expression over the lower-cased URL, with literal words that every match holds whole (between non-alphanumerics).

    A rule of alternatives without a common word is several entries of one name.
    """

    name: str
    pattern: str
    words: tuple[str, ...]
    host_pattern = ""  # any host
    action = "block"

    @property
    def tokens(self) -> list[str]:
        return sorted(f"w:{x}" for x in self.words)


#: The contract's rules.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: Pages that a training corpus leaves out; they decide where no host rule fits.
PATTERN_RULES = (
    PatternRule("spam-host", r"://([^/?#]*[.-])?spam([.-][^/?#]*)?([/?#]|$)", ("spam",)),
    PatternRule("pills", r"[^a-z0-9]cheap[^a-z0-9]+pills([^a-z0-9]|$)", ("cheap", "pills")),
    PatternRule("casino", r"[^a-z0-9](online|free|best)[^a-z0-9]+casino([^a-z0-9]|$)", ("casino",)),
    PatternRule("adult", r"[^a-z0-9]xxx([^a-z0-9]|$)", ("xxx",)),
    PatternRule("adult", r"[^a-z0-9]porn([^a-z0-9]|$)", ("porn",)),
    PatternRule("login", r"/login([/?#.]|$)", ("login",)),
    PatternRule("login", r"/signin([/?#.]|$)", ("signin",)),
    PatternRule("login", r"/logout([/?#.]|$)", ("logout",)),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column, host: Column, path: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    words = F.transform(F.split(low, "[^a-z0-9]+"), lambda x: F.concat(F.lit("w:"), x))
    return F.array_distinct(F.concat(labels, segments, words))


def _rarest(rule, count: dict[str, int]) -> str:
    """The rule's index token: the one that the fewest URLs hold; empty for a rule without literals, which meets every URL."""
    return min(rule.tokens, key=lambda t: (count.get(t, 0), t)) if rule.tokens else ""


def _counts(rules: list, held: DataFrame) -> dict[str, int]:
    """How many URLs hold each token of the rules: as many rows as the rules have tokens, at most. held: a column `tokens` for each URL."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    if len(rules) <= LITERAL:
        each = held.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("t"))
    else:
        each = held.select(F.explode("tokens").alias("t")).join(held.sparkSession.createDataFrame([(t,) for t in wanted], "t string"), "t")
    return {r[0]: r[1] for r in each.groupBy("t").count().collect()}


def _entry(rule, rank: int) -> tuple:
    return (rank, rule.name, rule.action, rule.host_pattern, rule.pattern)


_ENTRY = ("rank", "name", "action", "host_pattern", "pattern")


def _fits(r, host: Column, text: Column) -> Column:
    return F.rlike(host, r["host_pattern"]) & F.rlike(text, r["pattern"])


def _best(rows: DataFrame, out: str, rules: list[tuple[str, tuple]], text: Column) -> DataFrame:
    """rows with `out`, the smallest entry that fits host and text among those whose index token the row holds. rules: (index token, entry)."""
    keyed: dict[str, list[tuple]] = {}
    for token, entry in rules:
        keyed.setdefault(token, []).append(entry)
    shape = lambda e: F.struct(*(F.lit(x).alias(n) for n, x in zip(_ENTRY, e, strict=True)))
    always = F.array(*map(shape, keyed.pop("", []))) if "" in keyed else None
    if len(rules) <= LITERAL:
        parts = [] if always is None else [always]
        if keyed:
            of = F.create_map(*[x for t, es in keyed.items() for x in (F.lit(t), F.array(*map(shape, es)))])
            mine = F.array_intersect("tokens", F.array(*map(F.lit, keyed)))
            parts.append(F.flatten(F.transform(mine, lambda t: of[t])))
        if not parts:
            return rows.withColumn(out, F.lit(None).cast("struct<name:string,action:string>"))
        return rows.withColumn(out, F.array_min(F.filter(F.concat(*parts), lambda r: _fits(r, F.col("host"), text))))
    listed = rows.sparkSession.createDataFrame([(t, *e) for t, es in keyed.items() for e in es], "t string, rank int, name string, action string, host_pattern string, pattern string")
    cand = rows.select("__row", "host", text.alias("__text"), F.explode("tokens").alias("t")).join(listed, "t")
    entry = F.struct(*_ENTRY)
    found = cand.where(F.rlike("host", F.col("host_pattern")) & F.rlike("__text", F.col("pattern"))).groupBy("__row").agg(F.min(entry).alias(out))
    got = rows.join(found, "__row", "left")
    if always is not None:
        got = got.withColumn(out, F.array_min(F.concat(F.filter(always, lambda r: _fits(r, F.col("host"), text)), F.filter(F.array(out), lambda r: r.isNotNull()))))
    return got


def filter_urls(pages: DataFrame, *, keep: list[str], url: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """Columns `keep`, then host, path, rule (the longest host rule that fits, or null), pattern (the first fitting pattern rule, or null) and verdict.

    A null or malformed URL (no ://) has an empty host and path, fits no host
    rule, and is allowed unless a pattern fits. Host rules decide before
    patterns. Equal lengths: the smaller name wins. Repeated rows are judged
    each. White space and line ends are characters like any other. Without
    rules every URL is allowed.
    """
    u = F.col(url).cast("string")
    rows = pages.select(*keep, u.alias("__url")).withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    rows = rows.withColumn("tokens", _tokens(F.col("__url"), F.col("host"), F.col("path")))
    every = [*host_rules, *pattern_rules]
    if max(len(host_rules), len(pattern_rules)) > LITERAL:
        rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "urls")  # the number of a row is fixed once written
    count = _counts(every, rows.select("tokens"))
    place: dict[str, int] = {}
    for r in pattern_rules:
        place.setdefault(r.name, len(place))
    low = F.lower(F.coalesce("__url", F.lit("")))
    rows = _best(rows, "__h", [(_rarest(r, count), _entry(r, -len(r.name))) for r in host_rules], F.col("path"))
    rows = _best(rows, "__p", [(_rarest(r, count), _entry(r, place[r.name])) for r in pattern_rules], low)
    return rows.select(*keep, "host", "path", F.col("__h.name").alias("rule"), F.col("__p.name").alias("pattern"), F.coalesce("__h.action", "__p.action", F.lit("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "pattern")


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS cut_at FROM pages),
r AS (SELECT page_id, url, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, lower(url) AS low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
        FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
pat AS (SELECT *, CASE
    WHEN regexp_matches(low, '://([^/?#]*[.-])?spam([.-][^/?#]*)?([/?#]|$)') THEN 'spam-host'
    WHEN regexp_matches(low, '[^a-z0-9]cheap[^a-z0-9]+pills([^a-z0-9]|$)') THEN 'pills'
    WHEN regexp_matches(low, '[^a-z0-9](online|free|best)[^a-z0-9]+casino([^a-z0-9]|$)') THEN 'casino'
    WHEN regexp_matches(low, '[^a-z0-9](xxx|porn)([^a-z0-9]|$)') THEN 'adult'
    WHEN regexp_matches(low, '/(login|signin|logout)([/?#.]|$)') THEN 'login' END AS pattern FROM h)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern
FROM pat LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (page_id)
"""
