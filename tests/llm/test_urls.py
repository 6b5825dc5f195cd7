from __future__ import annotations

import pytest

from nearfield.llm import urls
from nearfield.llm.queries import RULES
from nearfield.llm.urls import filter_urls

URLS = {
    "http://WWW.Example.com/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
    "https://example.com/en": ("example.com", "/en", "com/", "allow"),
    "https://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
    "https://a.net/de/1": ("a.net", "/de/1", None, "allow"),
    "https://com": ("com", "", None, "allow"),
    "https://notexample.com?u=/en/": ("notexample.com", "", None, "allow"),
    "x://y.com:80/en/": ("y.com:80", "/en/", None, "allow"),
    "a://b://c/en": ("b:", "//c/en", None, "allow"),
    "no scheme.com/en/": ("", "", None, "allow"),
    "://.com/x": (".com", "/x", "com/", "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


@pytest.mark.parametrize("size", [urls.BYTES, 0])
def test_verdicts(spark, monkeypatch, size):
    monkeypatch.setattr(urls, "BYTES", size)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i % 5, u, "r", "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, rule string, host string")
    rows = filter_urls(pages, rules).collect()
    assert sorted(map(str, rows)) == sorted(str(r) for r in (pages.sparkSession.createDataFrame([(i % 5, *v) for i, v in enumerate(URLS.values())] * 2, "page_id long, host string, path string, rule string, verdict string").collect()))
    assert filter_urls(pages.where("false"), rules).count() == 0


def test_no_rules_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.b/cc")], "page_id long, url string")
    kind = "host string, path string, verdict string"
    assert filter_urls(pages, spark.createDataFrame([], kind), "block").first()["verdict"] == "block"
    rules = spark.createDataFrame([("b", "/c", "allow"), ("b", "/c", "block"), ("b", "/cc", "allow"), ("a.b", "/", "block"), (None, "/", "block")], kind)
    assert tuple(filter_urls(pages, rules).first())[3:] == ("a.b/", "block")


def test_host_and_path_are_told_apart(spark):
    kind = "host string, path string, verdict string"
    rules = spark.createDataFrame([("example", ".com", "block"), ("x.y", "", "allow")], kind)
    pages = spark.createDataFrame([(1, "http://example.com"), (2, "http://example.com/"), (3, "http://x.y")], "page_id long, url string")
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()) == [(1, None, "allow"), (2, None, "allow"), (3, "x.y", "allow")]


def test_a_very_long_url(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    url = "http://" + "a." * 20_000 + "example.com/en/" + "x/" * 50_000
    row = filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), rules).first()
    assert (row["rule"], row["verdict"], len(row["host"])) == ("example.com/en/", "block", 40_011)
