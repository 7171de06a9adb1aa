import random
import re

from hopline.llm import urlrules

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"), ("block", "a.com", "/f"), ("allow", "b.a.com", "/f"), ("allow", "org", ""), ("block", "org", "/")]


def judged(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2])
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, default)
    return host, path, best[2], best[3]


def check(spark, urls, partitions=8):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, html string, rule string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, rules).collect())
    assert got == [(i, *judged(u, RULES)) for i, u in enumerate(urls)]


def test_against_every_rule_tried(spark):
    rng = random.Random(1)
    hosts = ["org", "example.org", "www.example.org", "EXAMPLE.org", "notexample.org", "a.com", "b.a.com", "x.b.a.com", "com", "é.com", "a..com", ".com"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12?x#y", "/fr/", "/fr", "/f#/de/", "/de/\n", "?q=/es/", "#/es/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c.org/", "http://com/" + "x" * 5000]
    check(spark, urls + ["http://example.org/es/same"] * 400)


def test_repeated_rows_and_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://x.org/")] * 3 + [(None, None)] * 2, "page_id bigint, url string")
    assert urlrules.judge(pages, rules).count() == 5
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_ranges_of_a_hot_key():
    limits = ["b", "m", "m", "m", "x"]
    assert urlrules.ranges_of_key(limits, "a") == (0, 0)
    assert urlrules.ranges_of_key(limits, "m") == (2, 4)
    assert urlrules.ranges_of_key(limits, "n") == (4, 4)
    assert set(range(2, 5)) <= set(urlrules.ranges_of_rule(limits, "m"))
