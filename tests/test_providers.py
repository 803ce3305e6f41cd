"""Recorded provider payloads, visibility adapters, findings about runs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from crawlweave.plans import visibility
from crawlweave.sources import providers

PSI = {"lighthouseResult": {"categories": {"performance": {"score": 0.83}, "seo": {"score": 1}}, "audits": {"largest-contentful-paint": {"numericValue": 1200.5}}}}
CRUX = {"record": {"key": {"origin": "https://e.com"}, "metrics": {"largest_contentful_paint": {"percentiles": {"p75": 2100}}}}}
GSC = {"inspectionResult": {"indexStatusResult": {"verdict": "NEUTRAL", "coverageState": "Crawled - currently not indexed"}}}
ROWS = {"rows": [{"keys": ["https://e.com/a", "q"], "clicks": 3, "impressions": 10, "ctr": 0.3, "position": 2}]}


def test_payloads(spark, tmp_path):
    for provider, name, payload in (("psi", "a", PSI), ("psi", "b", {"error": {"message": "quota exceeded"}}), ("crux", "a", CRUX), ("gsc_inspection", "a", GSC), ("gsc_analytics", "a", ROWS)):
        (tmp_path / provider).mkdir(exist_ok=True)
        (tmp_path / provider / f"{name}.json").write_text(json.dumps({"url": f"https://e.com/{name}", "payload": payload}))
    p = providers.recorded(spark, str(tmp_path))
    assert sorted(map(tuple, p.select("provider", "url").collect())) == sorted(map(tuple, providers.from_files(spark, str(tmp_path)).select("provider", "url").collect()))
    a, b = providers.page_speed(p).orderBy("url").collect()
    assert (a["performance_score"], a["seo_score"], a["lcp"], a["status"]) == (83, 100, 1200.5, "success")
    assert (b["performance_score"], b["status"], b["error_message"]) == (None, "failed", "quota exceeded")
    c = providers.field_data(p).first()
    assert (c["query_scope"], c["lcp_p75"], c["status"]) == ("origin", 2100.0, "success")
    assert providers.inspections(p).first()["state"] == "not_indexed"
    assert tuple(providers.search_rows(p, ["page", "query"]).first()) == ("https://e.com/a", "q", 3.0, 10.0, 2.0)


def test_adapters(spark):
    pages = spark.createDataFrame([("u", 10.0), ("v", 20.0)], "normalized_url string, potential double")
    metrics = spark.createDataFrame([("u", 2.0, 5.0)], "normalized_url string, clicks double, impressions double")
    out = visibility.with_evidence(pages, [("search", visibility.search_adapter(metrics)), ("broken", lambda df: df.select("nothing"))])
    rows = {r["normalized_url"]: r for r in out.collect()}
    assert rows["u"]["clicks"] == 2 and rows["v"]["clicks"] == 0
    assert rows["u"]["adapters"] == ["search"] and rows["u"]["errors"][0].startswith("broken")
    assert tuple(visibility.observed(out).first()) == (15.0, 1, 2)


def test_run_findings(spark):
    entries = spark.createDataFrame([("url", "https://e.com/a"), ("url", "https://e.com/b"), ("sitemap_index", "x")], "entry_kind string, url string")
    pages = spark.createDataFrame([("https://e.com/a", 200, "text/html"), ("https://e.com/c", 200, "text/html")], "normalized_url string, status_code int, content_type string")
    got = {r["issue_code"]: json.loads(r["evidence"]) for r in visibility.sitemap_findings(entries, pages, "r", "e.com").collect()}
    assert got == {"SITEMAP_URL_NOT_CRAWLED": {"n": 1, "sample": ["https://e.com/b"]}, "CRAWLED_URL_NOT_IN_SITEMAP": {"n": 1, "sample": ["https://e.com/c"]}}
    psi = spark.createDataFrame([("r", "u", "failed"), ("r", "v", "success")], "run_id string, url string, status string")
    assert [(r["url"], r["issue_code"]) for r in visibility.outcome_findings({"performance_metrics": psi}).collect()] == [("u", "PERFORMANCE_PROVIDER_ERROR")]
    assert visibility.outcome_findings({}) is None
    assert psi.where(F.col("status") == "x").count() == 0
