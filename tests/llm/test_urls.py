"""URL rules against brute force, and the method's accuracy on labelled URLs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import url_filter as U
from parley.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"
URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://Example.COM/en/x", "http://example.com/en", "http://example.com/en/", "http://www.example.com/en/a?b=http://c.net/es/", "http://awww.example.com/en/", "http://wwwexample.com/en/a",
    "http://a.www.example.com/en/?q", "http://net/es/", "http://x.net/es/#", "http://x.net/fr/y", "http://x.net/FR/y", "http://x.net/es", "http://x.net?/es/", "http://x.net#/es/", "http://xnet/es/", "http://x.net./es/", "http://.net/es/", "a://b://c.net/es/", "http://u:p@x.net:80/es/", "http://É.net/fr/", "http://x.net/es/" + "a/" * 50_000,
    "http://" + "a." * 20_000 + "net/fr/", "http://x.net\n/fr/", "http:///es/", "http://KelvinK.com/",
]


def split(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(url, rules):
    host, path = split(url)
    fits = []
    for text, verdict in rules:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(text), len(h), text, verdict))
    best = max(fits, default=(0, 0, None, None))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("inline", [2_000, 0])
def test_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(U, "INLINE_RULES", inline)
    rules = [*URL_RULES, ("b.c/", "allow"), ("c/x/", "block"), ("É.net/fr/", "allow"), ("net", "block")]
    urls = [*URLS, *URLS[:9], "http://a.b.c/x/y", "http://b.c/x", "http://c/x/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("Host", F.lit("mine"))
    got = {r["page_id"]: (r["host_"], r["path"], r["rule"], r["verdict"]) for r in U.ruled(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert U.ruled(df.where("false"), rules).count() == 0 and U.ruled(df, []).where("rule is null and verdict is null").count() == len(urls)


def test_query_judges_every_page(spark):
    rows = QUERIES["op11_url_filter"](spark, SF).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute(pages[r["page_id"]], URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["blocked"] > 0.5 else "allow")) and 0 <= r["blocked"] <= 1
    again = QUERIES["op11_url_filter"](spark, SF).collect()
    assert sorted(again) == sorted(rows)


def labelled(n: int, seed: int) -> list:
    """Blocked URLs are of a few endings, or long with digits and many parameters."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdeorst") for _ in range(k))
    out = []
    for _ in range(n):
        bad = rng.random() < 0.3
        if bad and rng.random() < 0.5:
            out.append((f"http://{word(6)}.spam.{rng.choice(['biz', 'top'])}/{word(5)}", True))
        elif bad:
            out.append((f"http://{word(4)}{rng.randrange(10**6)}.org/{word(3)}/{rng.randrange(10**9)}?" + "&".join(f"{word(2)}={rng.randrange(10**5)}" for _ in range(rng.randrange(3, 9))), True))
        else:
            out.append((f"https://{word(7)}.{rng.choice(['org', 'com', 'net'])}/{word(5)}/{word(8)}" + rng.choice(["", "?page=2", ".html"]), False))
    return out


def test_method_learns_from_labelled_urls(spark):
    model = U.fit(spark.createDataFrame([*labelled(1500, 1), (None, True), ("http://x.org", None)], "url string, blocked boolean"))
    held = labelled(800, 2)
    got = model.blocked(pa.array([u for u, _ in held])) > 0.5
    assert np.mean(got == np.array([y for _, y in held])) >= 0.97


def test_edges(spark):
    df = spark.createDataFrame(labelled(200, 3), "url string, blocked boolean")
    model = U.fit(df, sample_rows=40)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("blocked", F.lit("mine"))
    got = U.judge(pages, URL_RULES, model).collect()
    assert len(got) == len(URLS) and all(0 <= r["blocked_"] <= 1 and r["blocked"] == "mine" and r["verdict"] in ("allow", "block") for r in got)
    assert U.fit(df.where("false")) is None
    assert {r["verdict"] for r in U.judge(pages.drop("blocked"), [], None).collect()} == {"allow"}
    one = U.fit(df.where("blocked"))
    assert one.blocked(pa.array(["http://a.b/c"]))[0] > 0.9
    assert U.judge(pages.where("false"), URL_RULES, model).count() == 0


def test_features_of_a_url():
    row = dict(zip(U.FEATURES, U.features(pa.array(["x", "https://ab.c1-d.org/p%20/q.html?a=1&b=22#f"]), U.Odds())[1], strict=True))
    want = {"length": 42, "host_length": 11, "path_length": 12, "query_length": 11, "depth": 2, "labels": 3, "longest_label": 4, "digit_run": 2, "hyphens": 1, "dots": 1, "escapes": 1, "parameters": 2, "values": 2, "fragment": 1, "secure": 1, "numeric_host": 0, "file_ending": 1}
    assert {k: row[k] for k in want} == want
