"""URL filters: host rules, and pattern rules found by their rarest literal token.

A host rule (host and path) fits its host and all subdomains if the path starts with the rule's; the longest one that fits decides. Where
none does, pattern rules decide: each names the literal tokens that its pattern cannot match without, and is indexed by the one of
them that is rarest among the tokens of all given urls. The tokens of a url fetch candidate rules, and only those run their regular expressions; the
first in the list that matches decides, and without one the url is allowed.

Token counts are taken over all urls and summed before the shuffle; rules are part of the program (``MOST_RULES`` at most), so that the index
goes to the tasks with the code. Nothing else is shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no host rule, and is judged by the patterns
as the empty or the whole text; repeated rows come back as often.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import table

MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path). Fixed values.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@dataclass(frozen=True)
class Pattern:
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def _words(verdict: str, *tokens: str) -> Pattern:
    """The tokens one after the other, as whole tokens."""
    return Pattern(verdict, "(^|[^a-z0-9])" + "[^a-z0-9]+".join(tokens) + "([^a-z0-9]|$)", tokens)


PATTERN_RULES = [
    _words("allow", "responsible", "gambling"),
    *[_words("block", t) for t in ("casino", "poker", "jackpot", "porn", "xxx", "viagra", "escort", "warez", "torrent")],
    *[_words("block", *t) for t in (("free", "bets"), ("cheap", "pills"), ("online", "pharmacy"), ("payday", "loans"), ("hot", "singles"), ("work", "from", "home"))],
    Pattern("block", r"(^|[^a-z0-9])slots?([^a-z0-9][^/]*)?/([^?#]*[^a-z0-9])?bonus([^a-z0-9]|$)", ("bonus",)),
    Pattern("block", r"[?&](aff|affiliate|ref)_id=[0-9]+", ("id",)),
]


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(url: Column) -> Column:
    return F.split(lower(url), "[^a-z0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def index(urls: DataFrame, url: str, patterns: list[Pattern]) -> dict[str, list[int]]:
    """Rule numbers by each rule's rarest token among all urls; of equally rare ones the longest, then the first."""
    if len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} pattern rules")
    literal = sorted({t for p in patterns for t in p.tokens})
    found = urls.select(F.explode(tokens(F.col(url))).alias("token")).where(F.col("token").isin(literal)).groupBy("token").count().collect()  # as many rows as rule tokens at most
    often = {r["token"]: r["count"] for r in found}
    out: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        out.setdefault(min(p.tokens, key=lambda t: (often.get(t, 0), -len(t), t)), []).append(i)
    return out


def pattern_verdict(urls: DataFrame, url: str, patterns: list[Pattern]) -> Column:
    by_token = index(urls, url, patterns)

    @F.pandas_udf("string")
    def judge(s):  # noqa: ANN001, ANN202
        compiled: dict[int, re.Pattern] = {}
        split = re.compile("[^a-z0-9]+")

        def one(text: str | None) -> str:
            low = (text or "").translate(str.maketrans(UPPER, LOWER))
            for i in sorted({i for t in set(split.split(low)) for i in by_token.get(t, ())}):
                if i not in compiled:
                    compiled[i] = re.compile(patterns[i].regex)
                if compiled[i].search(low):
                    return patterns[i].verdict
            return "allow"

        return s.map(one)

    return judge(F.col(url))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = HOST_RULES, patterns: list[Pattern] = PATTERN_RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of each row."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    named = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    named = named.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("other", pattern_verdict(urls, "url", patterns))
    return named.select("page_id", "host", "path", "rule", F.coalesce("verdict", "other").alias("verdict"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    by_length = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})" for _, h, p in by_length]
    rule = " ".join(f"WHEN {f} THEN {quoted(h + p)}" for f, (_, h, p) in zip(fits, by_length, strict=True))
    verdict = " ".join(f"WHEN {f} THEN {quoted(v)}" for f, (v, _, _) in zip(fits, by_length, strict=True))
    other = " ".join(f"WHEN regexp_matches(low, {quoted(p.regex)}) THEN {quoted(p.verdict)}" for p in PATTERN_RULES)
    return f"""
WITH r AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {other} ELSE 'allow' END AS verdict FROM h"""


ORACLE = _oracle()
