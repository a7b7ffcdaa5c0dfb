"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
(runs of a-z and 0-9) that every match must contain whole. One pass over all
URLs counts in how many each rule token occurs; each rule is filed under its
rarest token. A URL's tokens then fetch the few rules filed under them, and
only those run their expression.

Host/path rules (``org/``, ``example.org/es/``) are patterns of this form that
fit the host and its subdomains, if the path starts with the rule's; the longest
that fits decides. If none fits, the other patterns decide: blocked if a
blocking one matches, else allowed.

The rule list is a parameter and its size is checked (``MOST_RULES``), as it is
sent to every task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST_RULES = 1_000_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``tokens``: literals that are whole tokens of every URL that matches."""
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(rule: str, verdict: str) -> Rule:
    """A host/path rule. The path's last token may go on in a URL, so only the
    others are index tokens, unless a separator ends it."""
    host, slash, path = rule.partition("/")
    host = host.lower()
    tokens = _TOKEN.findall(host) + _TOKEN.findall(re.sub(r"[a-z0-9]+$", "", path.lower()))
    return Rule(rule, verdict, r"(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), tuple(tokens), True)


def pattern_rule(pattern: str, verdict: str, *tokens: str) -> Rule:
    """A regular expression over host + path, matched from the start."""
    return Rule(pattern, verdict, pattern, tuple(tokens), False)


#: The contract's rules (fixed values).
SITE_RULES = (site_rule("org/", "allow"), site_rule("example.org/es/", "block"), site_rule("example.org/en/1", "block"),
              site_rule("com/fr/", "allow"), site_rule("com/de/", "block"))
#: The method's own patterns: advertising, tracking and account pages.
PATTERN_RULES = (
    pattern_rule(r"(?:[^/]*\.)?ads-track\.[^/]+(?:/.*)?$", "block", "ads", "track"),
    pattern_rule(r"(?:[^/]*\.)?ads?\d*\.[^/]+/.*\bbanner\b", "block", "banner"),
    pattern_rule(r"[^/]*/(?:.*/)?wp-login\.php$", "block", "wp", "login", "php"),
    pattern_rule(r"[^/]*/(?:.*/)?cgi-bin/", "block", "cgi", "bin"),
    pattern_rule(r"(?:[^/]*\.)?casino(?:\.[^/]+)+(?:/.*)?$", "block", "casino"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by the token that the fewest URLs hold; a rule without tokens is
    filed under '' and tried on every URL. ``urls`` has host and path."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if wanted:
        tokens = F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))
        counts = {r["t"]: r["n"] for r in urls.select(F.explode(tokens).alias("t")).where(F.col("t").isin(wanted))
                  .groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def judge(pages: DataFrame, url_column: str = "url", site_rules: tuple[Rule, ...] = SITE_RULES,
          pattern_rules: tuple[Rule, ...] = PATTERN_RULES) -> DataFrame:
    """Every row with host, path, rule (the site rule that decided, else null)
    and verdict (allow or block). Input columns of these names are replaced.
    Null URLs and URLs without ``://`` have an empty host and path, which no
    rule fits: they are allowed. Rows are kept as they are; an empty table
    gives an empty result."""
    rules = (*site_rules, *pattern_rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be sent to every task")
    made = ["host", "path", "rule", "verdict"]
    rest = [c for c in pages.columns if c not in made]
    url = F.col(f"`{url_column}`").cast("string")
    inner = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    index = {k: [(r, re.compile(r.pattern, re.S)) for r in v] for k, v in rarest_tokens(inner.select("host", "path"), rules).items()}

    def judged(batches):
        for b in common.slices(batches, 4096):
            rule_out, verdict_out = [], []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
                at = h + p
                tokens = {*_TOKEN.findall(at.lower()), ""} & index.keys()
                found = [r for t in tokens for r, x in index[t] if x.match(at)] if h else []
                site = max((r for r in found if r.site), key=lambda r: (len(r.name), r.name), default=None)
                rule_out.append(site and site.name)
                verdict_out.append(site.verdict if site else "block" if any(r.verdict == "block" for r in found) else "allow")
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("host"), b.column("path"),
                                              pa.array(rule_out, pa.string()), pa.array(verdict_out, pa.string())], ["row", *made])

    kind = inner.schema["row"].dataType.simpleString()
    out = common.map_arrow(inner, judged, f"row {kind}, host string, path string, rule string, verdict string")
    return out.select("row.*", *made)
