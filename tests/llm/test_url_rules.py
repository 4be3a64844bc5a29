from __future__ import annotations

import random

from secflow.llm import url_rules
from secflow.llm.registry import PAGE_RULES

RULES = "host string, path string, verdict string"
LOWER = str.maketrans(url_rules.UPPER, url_rules.LOWER)


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return rest[:cut].translate(LOWER), path


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, default)))


def pages(spark, urls):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return frame.select("*", F.lit(1).alias("key"), F.lit(2).alias("bucket"), F.lit(3).alias("host"))


def check(spark, urls, rules):
    got = url_rules.judge(pages(spark, urls), spark.createDataFrame(rules, RULES)).collect()
    assert sorted(r[0] for r in got) == list(range(len(urls)))
    for page_id, *rest in got:
        assert tuple(rest) == brute(urls[page_id], rules), urls[page_id]


def test_stated_rules_and_odd_urls(spark):
    check(spark, ["http://a.example.org/es/x?q", "https://EXAMPLE.ORG/en/15#t", "http://org/", "http://xorg/", "ftp://b.com/de/",
                  "no scheme", None, "", "http://", "://org/", "http://b.com?x=/de/", "http://É.org/ü", "a://b://org/",
                  "http://example.org/en/1", "http://example.org/en/", "http://com/fr/" + "y" * 5000], PAGE_RULES)


def test_random_nested_rules_against_all_pairs(spark):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(0, 5)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(80)]
    urls = [f"http://{host()}{path()}" for _ in range(500)] + ["http://a.b.c/x/y"] * 300  # one address is hot
    check(spark, urls, rules)


def test_empty_tables_and_useless_rules(spark):
    assert url_rules.judge(pages(spark, []), spark.createDataFrame(PAGE_RULES, RULES)).count() == 0
    none = [(None, "/", "block"), ("", "/", "block"), ("org", "/", None)]
    got = url_rules.judge(pages(spark, ["http://x.org/"]), spark.createDataFrame(none, RULES), "block").collect()
    assert [tuple(r) for r in got] == [(0, "x.org", "/", None, "block")]
