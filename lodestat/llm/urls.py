"""URL filters: pattern rules, indexed by their rarest literal token. DataFrame functions only.

A rule is a regular expression with an action and the literal tokens (runs of ASCII letters and digits) that
any url it matches must contain. How many distinct urls have each token is counted over the whole table, for
the tokens that rules have; each rule is filed under its rarest one. A url's tokens fetch the candidate rules
by an equi-join, and only those run their regular expression. A rule without a literal token is filed under the
empty one, which every url has. Of the rules that match, the one with the highest rank decides. Work is per
distinct url, so that a url of very many pages is judged once.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no host rule; equal
urls are judged alike; without rules every url is allowed; extra columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import ascii_lower
from lodestat.sources.shared import cut_lineage

#: An index up to this many rules is broadcast (some 200 bytes each); a larger one is joined by shuffling.
BROADCAST_RULES = 50_000


class Rule(NamedTuple):
    """rank: the highest of the matching rules decides; then the name that sorts first does."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(sorted(set(re.findall("[a-z0-9]+", text.lower()))))


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the url's path starts with `path`; a longer rule ranks higher.

    Tokens of the path that the url may continue ("/en" in "/english") aren't literal tokens.
    """
    literal = re.sub("[A-Za-z0-9]+$", "", path)
    authority = f"(?:[^/?#]*\\.)?{_quoted(host, True)}" if host else "[^/?#]*"
    # the first "://" ends the scheme
    return Rule(host + path, action, f"(?s)^(?:(?!://).)*://{authority}(?=[/?#]|\\z){_quoted(path, False)}", _tokens(host) + tuple(t for t in _tokens(literal) if t not in _tokens(host)), 1000 + len(host + path))


def _quoted(text: str, either_case: bool) -> str:
    """A literal for a pattern; of a host, ASCII letters match in both cases."""
    return "".join(f"[{c.lower()}{c.upper()}]" if either_case and c.isascii() and c.isalpha() else re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", c) for c in text)


def word_rule(word: str, where: str = "host") -> Rule:
    """Blocks urls that have a word between separators: in the host, or in the path."""
    before = "://(?:[^/?#]*[.-])?" if where == "host" else "://[^/?#]*/(?:[^?#]*[^A-Za-z0-9?#])?"
    name = f"*{word}*" if where == "host" else f"*/{word}*"
    return Rule(name, "block", f"(?s)^(?:(?!://).)*{before}{_quoted(word, True)}(?![A-Za-z0-9])", _tokens(word), 0)


# The listed host rules; words of hosts and of paths, and a pattern of hosts, that the method blocks
# where no host rule fits.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BLOCKED_WORDS = (
    "ads", "adserver", "adult", "affiliate", "bet", "bets", "betting", "bingo", "cam", "casino", "cheap", "clickbank",
    "coupon", "coupons", "dating", "doubleclick", "erotic", "escort", "escorts", "gambling", "hentai", "jackpot",
    "loans", "lottery", "malware", "nude", "payday", "phishing", "pills", "poker", "popup", "porn", "proxy", "roulette",
    "sex", "slots", "spam", "telemetry", "torrent", "torrents", "track", "tracker", "viagra", "warez", "webcam", "xxx",
)
BLOCKED_PATHS = ("adclick", "captcha", "cgi-bin", "checkout", "logout", "signin", "signup", "unsubscribe", "wp-admin", "wp-login")
#: Hosts that are numbers.
NUMERIC_HOST = r"[0-9]+(?:\.[0-9]+){3}"

DEFAULT_RULES = (
    *(host_rule(*r) for r in HOST_RULES),
    *(word_rule(w) for w in BLOCKED_WORDS),
    *(word_rule(w, "path") for w in BLOCKED_PATHS),
    Rule("*numeric host*", "block", rf"(?s)^(?:(?!://).)*://{NUMERIC_HOST}(?=[:/?#]|\z)", (), 0),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return ascii_lower(host)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules as a table, from literals of a plan."""
    kind = "array<struct<name:string,action:string,pattern:string,tokens:array<string>,rank:int>>"
    listed = [
        F.struct(F.lit(r.name), F.lit(r.action), F.lit(r.pattern), F.array(*(F.lit(t) for t in r.tokens)).cast("array<string>"), F.lit(r.rank))
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*listed).cast(kind)))


def _url_tokens(urls: DataFrame) -> DataFrame:
    """(url, token): a row for each distinct token of each url, and one for the empty token."""
    found = F.regexp_extract_all(ascii_lower(F.col("url")), F.lit("([a-z0-9]+)"), F.lit(1))
    return urls.select("url", F.explode(F.array_union(found, F.array(F.lit("")))).alias("token"))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, name, action, pattern, rank): each rule under its token that the fewest urls have, then the one that sorts first; under the empty one if it has none."""
    wanted = rules.select("name", "pattern", F.explode_outer("tokens").alias("token")).na.fill("", ["token"])
    known = _bounded(wanted.select("token").where("token != ''").distinct(), BROADCAST_RULES)
    sizes = _url_tokens(urls).join(known, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    size = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")
    rarest = wanted.join(sizes, "token", "left").groupBy("name", "pattern").agg(F.min(size).alias("r"))
    return rules.join(rarest, ["name", "pattern"]).select(F.col("r.token").alias("token"), "name", "action", "pattern", "rank")


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """With a broadcast hint where the table is proven to have at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row of `pages`: id_col, host, path, rule (the name of the deciding rule) and verdict (its action, else `default`)."""
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("url"))
    urls = rows.where("url is not null").select("url").distinct()
    index = _bounded(cut_lineage(rule_index(urls, rules)), BROADCAST_RULES)
    candidates = _url_tokens(urls).join(index, "token")
    fits = candidates.where(F.rlike("url", F.col("pattern")))
    first = F.struct((-F.col("rank")).alias("rank"), F.col("name"), F.col("action"))
    decided = fits.groupBy("url").agg(F.min(first).alias("best")).select("url", F.col("best.name").alias("rule"), F.col("best.action").alias("action"))
    # A table of its own, so that Spark can split a url of very many pages in the join.
    decided = cut_lineage(decided)
    out = rows.join(decided, "url", "left")
    return out.select(F.col("__id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
