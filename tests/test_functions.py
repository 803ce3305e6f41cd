"""Scalar functions: expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crawlweave.functions import columns as C
from crawlweave.functions.classify import classify


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://Example.com/path/?utm_source=x&a=1#frag", "http://example.com/path?a=1"),
        ("//Example.com/path/?utm_source=x&a=1#frag", "https://example.com/path?a=1"),
        ("http://localhost:8000/path", "http://localhost:8000/path"),
        ("https://example.com:443//a//b/", "https://example.com/a/b"),
        ("https://example.com/tool-removes-Camloc®-cloc", "https://example.com/tool-removes-Camloc%C2%AE-cloc"),
        ("https://example.com", "https://example.com/"),
        (None, None),
        ("http://[bad", None),
    ],
)
def test_normalize(url, want):
    assert C.normalize_one(url) == want


def test_normalize_relative():
    assert C.normalize_one("../b?z=1&a=2", "https://example.com/x/y/") == "https://example.com/x/b?a=2&z=1"
    assert C.normalize_one("http://example.com/a", "https://example.com/") == "https://example.com/a"


def test_url_columns(spark):
    x = F.col("x")
    assert values(spark, ["https://www.Example.com:8080/Services/a?q=1#f", ""], C.host(x), C.path(x), C.first_segment(x), C.query(x)) == [("www.example.com", "/Services/a", "services", "q=1"), ("", "/", "", "")]
    assert values(spark, ["www.Alpha.com", "https://a.b.co.uk/x"], C.reversed_labels(C.domain_of(x))) == ["com.alpha", "uk.co.b.a"]
    assert values(spark, ["https://e.com/a.PDF?x=1", "https://e.com/a"], C.binary_asset(x)) == [True, False]


def test_scope(spark):
    x = F.col("x")
    hosts = ["example.com", "www.example.com", "blog.example.com", "other.com"]
    assert values(spark, hosts, C.in_scope(x, "www.example.com")) == [True, True, False, False]
    assert values(spark, hosts, C.in_scope(x, "example.com", "host_only")) == [True, False, False, False]
    assert values(spark, hosts, C.in_scope(x, "example.com", "all_subdomains")) == [True, True, True, False]
    assert values(spark, hosts, C.in_scope(x, "example.com", "custom_allowlist", ["https://other.com/x"])) == [True, True, False, True]
    assert values(spark, hosts, C.in_scope(x, "example.com", "host_only", redirect_host="Other.com")) == [True, False, False, True]


def test_policy(spark):
    urls = [f"https://e.com{u}" for u in ("/product?add-to-cart=123", "/export?download=csv", "/page?preview=1", "/catalog?sort=price", "/list?color=red&size=1", "/a?color=red", "/")]
    assert values(spark, urls, C.url_policy(F.col("x"))) == ["never_enqueue", "fetch_headers_only", "crawl_once_diagnostic", "canonical_candidate_duplicate", "crawl_sampled", "crawl_normally", "crawl_normally"]


def test_numbers_and_directives(spark):
    x = F.col("x")
    assert values(spark, ["12", " 7 ", "abc", ""], C.safe_int(x, -1)) == [12, 7, -1, -1]
    assert values(spark, ["max-snippet:20, MAX-SNIPPET: 5, nosnippet", "max-snippet:-1", ""], C.strictest_number(x, "max-snippet")) == [5, -1, None]
    assert values(spark, ['["b", " a ", "b", ""]', "{", '"x"'], C.json_strings(x)) == [["b", "a"], [], []]
    assert values(spark, ['{"a": {"b": 3}}', "no"], C.json_value(x, "$.a.b", "int")) == [3, None]


def test_text(spark):
    x = F.col("x")
    same = values(spark, ["Hello   World", " hello world ", "", None], C.content_hash(x))
    assert same[0] == same[1] != "" and same[2:] == ["", ""]
    assert values(spark, ["One, two-three é"], F.size(C.visible_words(x))) == [4]


def test_dates(spark):
    x = F.col("x")
    as_of = F.lit("2026-03-01 00:00:00").cast("timestamp")
    assert values(spark, ["2025-02-25", "2026-02-28T12:00:00Z", "nonsense", ""], C.age_days(C.lastmod(x), as_of)) == [369, 0, None, None]
    assert values(spark, ["120", "Sun, 01 Mar 2026 00:01:00 GMT"], C.retry_after_seconds(x, as_of)) == [120.0, 60.0]


def test_age_counts_fractions_of_a_second(spark):
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    stamps = ["2024-05-30 00:00:00.000001", "2024-05-30 00:00:00", "2024-05-29 23:59:59.999999", "2024-06-01 00:00:00.5", "2024-06-02 00:00:00.000001", "0001-01-01 00:00:00.000001"]
    assert values(spark, stamps, C.age_days(C.lastmod(F.col("x")), as_of)) == [1, 2, 2, -1, -2, 739036]


@pytest.mark.parametrize(
    "url, title, h1, want",
    [
        ("https://e.com/", "x", "y", "homepage"),
        ("https://e.com/contact", "Contact us", "Get in touch", "contact"),
        ("https://e.com/blog/2024/a", "News", "An insight", "article"),
        ("https://e.com/services/x", "Our service", "What we do", "service"),
        ("https://e.com/privacy", "Privacy", "Terms", "legal"),
        ("https://e.com/locations/x", "City", "Near me", "location"),
        ("https://e.com/login", "", "", "utility"),
        ("https://e.com/abc", "Anything", "Else", "other"),
        ("https://e.com/abc", "service industry", "sector solution", "other"),
    ],
)
def test_classify(spark, url, title, h1, want):
    df = spark.createDataFrame([(url, title, h1)], "u string, t string, h string")
    assert df.select(classify(F.col("u"), F.col("t"), F.col("h"))["page_type"]).first()[0] == want
