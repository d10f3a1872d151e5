import re

import duckdb
import pandas as pd

from marquee.llm import urls

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=1#y", "https://a.example.com/en/2", "https://example.com/de/3", "http://x.net/es/1", "http://net/fr/", "http://x.net/en/",
        "http://notnet/es/", "http://a.b.org/casino", "http://cheap-pills.example.net/", "http://free.bets.org/x", "http://freebets.org/", "a://b://c.com/", "http://a.com?x/y", "http://a.com#f", "http://é.com/ü",
        "http://slots.org/get-bonus/", "http://responsible-gambling.org/casino", "http://x.org/?ref_id=12", "http://x.org/\ncasino", "http://x.com:80/", "http://big-casinos.org/", "http://CASINO.org/", "http://casino.org/" + "a" * 5000]


def rows():
    return list(enumerate(URLS)) + [(None, "http://x.com/"), (3, "http://"), (3, "http://")]


def test_rows_equal_sql(spark):
    pages = pd.DataFrame({"page_id": pd.array([r[0] for r in rows()], "Int64"), "url": [r[1] for r in rows()]})
    con = duckdb.connect()
    con.register("pages", pages)
    want = sorted((tuple(r) for r in con.execute(urls.ORACLE).fetchall()), key=str)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows()], "page_id long, url string, host string, other string")
    assert sorted((tuple(r) for r in urls.judged(df).collect()), key=str) == want
    assert {w[4] for w in want} == {"allow", "block"} and len({w[3] for w in want}) >= 5


def test_a_pattern_never_matches_without_its_tokens():
    for p in urls.PATTERN_RULES:
        for url in filter(None, URLS):
            low = url.lower()
            if re.search(p.regex, low):
                assert set(p.tokens) <= set(re.split("[^a-z0-9]+", low))


def test_rules_are_indexed_by_their_rarest_token(spark):
    df = spark.createDataFrame([("http://free.org/free",), ("http://pills.org/",), ("http://pills.org/cheap/pills",), (None,)], "url string")
    by = urls.index(df, "url", [urls._words("block", "free", "bets"), urls._words("block", "cheap", "pills")])
    assert by == {"bets": [0], "cheap": [1]}


def test_empty_table(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []
