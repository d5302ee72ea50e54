import random

import pytest

from taskweave.llm import url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


URLS = [None, "", "no scheme/net/", "http://", "http://NET", "https://Example.NET/en/x?y#z", "ftp://a.example.net/en", "http://a.example.net?q=/en/", "x://net/",
        "http://badexample.com/de/", "http://www.example.com/de/1", "http://example.com/DE/1", "http://org/fr/", "http://a..net/x", "http://.net/", "http://net./x",
        "http://É.Net/ü/", "http://a.net:80/x", "http://u@b.net/x", "http://a.b.c.d.e.org/fr/#", "http://a://b.net/", "http://net\n/x"]


@pytest.mark.parametrize("part_hosts", [2, 1000])
def test_equals_brute_force(spark, part_hosts):
    r = random.Random(4)
    labels = ["a", "b", "c", "net", "org"]
    urls = URLS + ["http://" + ".".join(r.choice(labels) for _ in range(r.randint(1, 5))) + "/" + "/".join(r.choice(labels) for _ in range(r.randint(0, 3))) for _ in range(300)]
    rules = url_filter.RULES + [(".".join(r.choice(labels) for _ in range(r.randint(1, 4))), "/" + r.choice(["", "a", "a/b", "net/"]), r.choice(["allow", "block"])) for _ in range(25)]
    rules += [(None, "/", "block"), ("a.net", None, "block"), rules[5]]
    pages = spark.createDataFrame([(i, u, "html", "clash", 1) for i, u in enumerate(urls)] + [(None, URLS[5], "", "", 0)] * 2, "page_id long, url string, html string, host string, rules int")
    got = sorted(((r.page_id is None, r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(
        spark, pages, url_filter.rules_frame(spark, rules), part_hosts=part_hosts).collect()), key=str)
    want = sorted(((i is None, i, *brute(u, rules)) for i, u in [*enumerate(urls), (None, URLS[5]), (None, URLS[5])]), key=str)
    assert got == want


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    assert url_filter.judge_urls(spark, pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_filter.judge_urls(spark, pages, rules.limit(0)).collect()] == [(1, "a.net", "/", None, "allow")]
