"""Sources, sinks, read side, queue selections and state."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from crawlweave.functions import columns
from crawlweave.operators import webgraph as W
from crawlweave.plans import insights, queue, resolution
from crawlweave.sources import html, robots, sitemaps, tables
from crawlweave.streaming import state

HTML = """<html lang="en"><head><title>Sample  Service Page</title><meta name="description" content="About it"><meta name="robots" content="noindex, nofollow">
<link rel="canonical" href="/service?utm_source=x"><link rel="alternate" hreflang="DE" href="/de"><script type="application/ld+json">{"@graph":[{"@type":["Service","Thing"]}]}</script><script>var a="<p>";</script></head>
<body><nav><a href="/a">A</a></nav><main><h1>Service <b>Page</b></h1><p>Four visible words here</p><img src="x.png" alt="x"><img src="y.png"><a href="https://www.example.com/b" rel="nofollow">B</a><a href="https://other.org/">O</a><a href="#top">t</a><a href="mailto:x@y.z">m</a></main></body></html>"""


def test_html_facts():
    p = html.parse(HTML, "https://example.com/service")
    assert (p["title"], p["h1"], p["h1_count"], p["language"]) == ("Sample Service Page", "Service Page", 1, "en")
    assert p["canonical_url"] == "https://example.com/service" and p["hreflang"] == [{"lang": "de", "href": "https://example.com/de"}]
    assert (p["internal_links_out"], p["external_links_out"], p["image_count"], p["is_noindex"], p["is_nofollow"]) == (2, 1, 2, 1, 1)
    assert p["schema_types"] == ["Service", "Thing"] and p["script_count"] == 2
    assert [x["region"] for x in p["links"]] == ["nav", "main", "main"]
    assert p["word_count"] == 11
    assert html.parse(None, None)["word_count"] == 0 and html.parse("<p>a<b>c</p></div><h1>x", "http://e.com")["h1_count"] == 0


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "https://example.com/service", HTML), (2, None, None)], "id int, url string, html string")
    facts = html.extract(pages, "id", "url", "html")
    assert {r["id"]: r["title"] for r in facts.collect()} == {1: "Sample Service Page", 2: ""}
    assert html.edges(facts).where("is_internal = 1").count() == 2
    assert {r["id"]: r["images"] for r in html.image_scores(facts, "id").collect()} == {1: 2, 2: 0}
    assert facts.limit(0).count() == 0


def test_robots(spark):
    text = "# c\nUser-agent: *\nDisallow: /private # x\nCrawl-delay: 2\nUser-agent: MyBot\nAllow: /private/ok\nDisallow: /private\nCrawl-delay: 5\nSitemap: https://e.com/s.xml\n"
    found = robots.rules(spark.createDataFrame([("e.com", text)], "site string, text string"), "site", "text")
    assert [tuple(r)[2:] for r in found.orderBy("pos").collect()] == [("*", "disallow", "/private"), ("*", "crawl-delay", "2"), ("MyBot", "allow", "/private/ok"), ("MyBot", "disallow", "/private"), ("MyBot", "crawl-delay", "5"), ("MyBot", "sitemap", "https://e.com/s.xml")]
    urls = spark.createDataFrame([("/private/ok/1",), ("/private/x",), ("/",)], "path string")
    ask = lambda agent: [r["allowed"] for r in robots.allowed_by_rules(urls, "path", found, agent).orderBy("path").collect()]
    assert ask("mybot/1.0") == [True, True, False] and ask("other") == [True, False, False]
    assert robots.crawl_delay(found, "MyBot/2.1 (x)").first()[0] == 5 and robots.crawl_delay(found, "z").first()[0] == 2


SITEMAP = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://i" xmlns:xhtml="http://x"><url><loc>https://e.com/a/</loc><lastmod>2024-01-01</lastmod><image:image><image:loc>x.png</image:loc></image:image><xhtml:link rel="alternate" hreflang="DE" href="https://e.com/de"/></url><url><loc>https://e.com/b</loc></url><url><lastmod>x</lastmod></url></urlset>"""
INDEX = """<sitemapindex><sitemap><loc>https://e.com/1.xml</loc></sitemap><sitemap><loc>https://e.com/index.xml</loc></sitemap></sitemapindex>"""


def test_sitemaps(spark):
    maps = spark.createDataFrame([("https://e.com/index.xml", INDEX), ("https://e.com/1.xml", SITEMAP), ("https://e.com/bad.xml", "<urlset")], "sitemap_url string, xml string")
    found = sitemaps.expand(maps, ["https://e.com/index.xml"])
    urls = [r for r in found.where("entry_kind = 'url'").orderBy("url").collect()]
    assert [r["url"] for r in urls] == ["https://e.com/a", "https://e.com/b"]
    assert urls[0]["images"] == [{"loc": "x.png"}] and urls[0]["hreflang"][0]["lang"] == "de"
    assert sitemaps.entries(maps.where("sitemap_url like '%bad%'")).count() == 0
    pages = spark.createDataFrame([("https://e.com/a",), ("https://e.com/c",)], "normalized_url string")
    d = sitemaps.deltas(found, pages, "2026-01-01").first()
    assert (d["sitemap_urls"], d["discovered_urls"], d["not_crawled"], d["not_in_sitemap"], d["sitemap_images"], d["missing_lastmod"], d["stale_lastmod"]) == (2, 2, 1, 1, 1, 1, 1)


def test_web_graph(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Vertex_ID,Host,n_hosts\n1,com.Alpha,999\n2,com.beta,100\n3,com.gamma,1\n9,com.target,5\nx,bad,1\n")
    (tmp_path / "r.csv").write_text("id,harmonicc_val,pr\n1,9.0,.001\n2,10.0,.0001\n3,10.0,.0002\n")
    (tmp_path / "e.csv").write_text("src,dst\n1,9\n2,9\n3,9\n3,9\n9,1\n")
    files = {k: [str(tmp_path / f"{k[0]}.csv")] for k in ("vertices", "ranks", "edges")}
    root = str(tmp_path / "cache")
    assert tables.release_state(spark, root, "CC-1") == "cold"
    tables.materialise_release(spark, root, "CC-1", files, "1")
    assert tables.release_state(spark, root, "CC-1") == "warm_edges"
    v, r, e = (spark.read.parquet(f"{root}/release=CC-1/{k}") for k in ("vertices", "ranks", "edges"))
    rows = W.rank_buckets(W.linking_domains(e, v, r, "com.target", 10)).orderBy("place").collect()
    assert [x["domain"] for x in rows] == ["com.gamma", "com.beta", "com.alpha"] and rows[0]["rank_bucket"] == "top_10"
    a = W.referrer_aggregates(W.linking_domains(e, v, r, "com.target", 10)).first()
    assert a["referring"] == 3 and a["weighted_score"] == pytest.approx(29_000 + 1300)
    assert {x["name"]: x["harmonic_centrality_gap"] for x in W.rank_gaps(v, r, "com.alpha", ["com.beta"]).collect()} == {"beta.com": 1.0}
    with pytest.raises(ValueError):
        tables.pick(["a"], ["b"])


def test_tables_round_trip(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = spark.createDataFrame([("r1", "u", "high", "X"), ("r2", "u", "low", "Y")], "run_id string, url string, severity string, issue_code string")
    tables.write(rows, root, "issues")
    assert tables.read(spark, root, "issues", "r1").select("issue_code").first()[0] == "X"
    assert tables.read(spark, root, "links").count() == 0
    tables.replace_run(rows.where("run_id = 'r1'").withColumn("issue_code", F.lit("Z")), root, "issues")
    assert {r["issue_code"] for r in tables.read(spark, root, "issues").collect()} == {"Y", "Z"}
    tables.export_csv(tables.read(spark, root, "links"), str(tmp_path / "links.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "links.csv")).columns[0] == "run_id"
    one = spark.createDataFrame([("k", 1), ("l", 1)], "key string, v int")
    tables.upsert(spark, one, root, "kv", ["key"], 0)
    assert sorted(map(tuple, tables.upsert(spark, one.where("key = 'k'").withColumn("v", F.lit(5)), root, "kv", ["key"], 1).collect())) == [("k", 5), ("l", 1)]


RUNS = [("run-001", "2026-04-09 00:00:00"), ("run-002", "2026-04-09 00:30:00")]


@pytest.fixture(scope="module")
def audit(spark):
    runs = spark.createDataFrame(RUNS, "run_id string, started_at string")
    pages = spark.createDataFrame([(r, f"https://e.com{u}", k, 200, d, "t", "h") for r, _ in RUNS for u, k, d in (("/", "homepage", 0), ("/service", "service", 1))], "run_id string, normalized_url string, page_type string, status_code int, crawl_depth int, title string, h1 string")
    issues = spark.createDataFrame([("run-001", "https://e.com/", "high", "NOINDEX", "t", "d"), ("run-001", "https://e.com/service", "medium", "ORPHAN_RISK", "t", "d"), ("run-002", "https://e.com/", "low", "LOW_INTERNAL_LINKS", "t", "d")], "run_id string, url string, severity string, issue_code string, title string, description string")
    scores = spark.createDataFrame([("run-001", "https://e.com/", 82), ("run-001", "https://e.com/service", 67), ("run-002", "https://e.com/", 86), ("run-002", "https://e.com/service", 82)], "run_id string, url string, overall_score int")
    links = spark.createDataFrame([("run-001", "https://e.com/", "https://e.com/service", 1)], "run_id string, source_url string, normalized_target_url string, is_internal int")
    metrics = spark.createDataFrame([("run-001", "https://e.com/", 0.21, 0.02, 0.41, 1, 0), ("run-001", "https://e.com/service", 0.01, 0.22, 0.14, 2, 1)], "run_id string, url string, internal_pagerank double, betweenness double, closeness double, community_id int, bridge_flag int")
    return {"runs": runs, "pages": pages, "issues": issues, "scores": scores, "links": links, "metrics": metrics}


def test_read_side(audit):
    a = audit
    assert insights.newest_run(a["runs"]) == "run-002"
    s = insights.summary(a["pages"], a["issues"], a["scores"], "run-001")
    assert s["pages"].first()[0] == 2 and s["issues"].first()[0] == 2 and {r["severity"]: r["n"] for r in s["severities"].collect()}["high"] == 1
    rows, total = insights.list_issues(a["issues"], a["pages"], a["scores"], "run-001", severity="HIGH")
    assert [r["issue_code"] for r in rows.collect()] == ["NOINDEX"] and total.first()[0] == 1
    rows, total = insights.list_pages(a["pages"], a["scores"], a["issues"], "run-001", page_type="service")
    assert [(r["url"], r["issue_count"]) for r in rows.collect()] == [("https://e.com/service", 1)]
    rows, _ = insights.list_pages(a["pages"], a["scores"], a["issues"], "run-001", sort_by="score", descending=False)
    assert [r["overall_score"] for r in rows.collect()] == [67, 82]
    c = insights.compare_runs(a["issues"], a["scores"], "run-001", "run-002")
    assert c["summary"].first()[:2] == (2, 9.5)
    with pytest.raises(ValueError):
        insights.compare_runs(a["issues"], a["scores"], "x", "x")
    arch = insights.architecture(a["pages"], a["metrics"], a["scores"], a["links"], "run-001")
    assert arch["nodes"].count() == 2 and arch["overloaded_hubs"].count() == 1 and arch["weak_support"].count() == 1
    d = insights.url_detail({"pages": a["pages"], "issues": a["issues"], "scores": a["scores"], "links": a["links"]}, "run-001", "https://e.com/service")
    assert d["issues"].count() == 1 and d["incoming"].count() == 1 and d["outgoing"].count() == 0


def test_adhoc(spark, audit):
    rows = insights.adhoc(spark, {"issues": audit["issues"]}, "SELECT issue_code, count(*) AS n FROM issues WHERE run_id = :run_id GROUP BY issue_code;", 10, "run-001")
    assert rows.count() == 2
    assert "NOINDEX,1" in insights.export_csv(rows)
    for bad in ("", "DELETE FROM issues", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) DROP TABLE x", "SELECT " + "1" * 7000):
        with pytest.raises(ValueError):
            insights.checked_sql(bad)


def test_queue(spark):
    jobs = spark.createDataFrame(
        [("a", "queued", 1, "d1", 0), ("b", "queued", 5, "d2", 0), ("c", "queued", 9, "d3", 0), ("r", "running", 0, "d3", 1), ("x", "queued", 9, "d4", 9)], "job_id string, state string, priority int, domain_key string, required_tokens int"
    ).withColumns({"submitted_at": F.lit("2026-01-01").cast("timestamp"), "next_eligible_at": F.lit(None).cast("timestamp"), "cancel_requested": F.lit(0), **{c: F.lit(0) for c in ("render_heavy", "provider_heavy", "offsite_heavy")}})
    assert [r["job_id"] for r in queue.next_jobs(jobs, "2026-01-02", {"required_tokens": 4}).collect()] == ["b", "a"]
    urls = spark.createDataFrame([("u1", 5.0, 1, "k"), ("u2", 9.0, 2, "k"), ("u3", 1.0, 3, "z"), ("u1", 5.0, 4, "k")], "url string, priority double, seq int, cluster_key string")
    assert [r["url"] for r in queue.frontier(urls).collect()] == ["u2", "u1", "u3"]
    assert [r["url"] for r in queue.frontier(urls, budget=1).collect()] == ["u2", "u3"]


def test_measurement_status(spark):
    urls = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    rows = [("u", "no_data", "", 1), ("u", "success", "", 2), ("v", "failed_http", "HTTP 500", 3), ("v", "no_data", "", 4), ("x", "failed_http", "RuntimeError: worker failure", 5), ("v", "skipped_missing_key", "", 6)]
    evidence = queue.field_evidence(spark.createDataFrame(rows, "url string, status string, error_message string, seq int"))
    got = {r["url"]: (r["status"], r["family"]) for r in queue.measurement_status(urls, evidence).collect()}
    assert got == {"u": ("ok", "none"), "v": ("provider_error", "http"), "w": (queue.NOT_ATTEMPTED, "not_attempted_policy"), "x": ("provider_runtime_error", "runtime")}


def test_targets(spark):
    page = lambda i, kind, **more: Row(**({"page_id": i, "normalized_url": f"https://e.com/{i}", "page_type": kind, "status_code": 200, "content_type": "text/html", "title": "T", "h1": "H", "h1_count": 1, "canonical_url": "c", "word_count": 500, "internal_links_out": 5, "crawl_depth": 2, "render_gap_score": 0, "shell_score": 0} | more))
    pages = spark.createDataFrame([page(1, "article"), page(2, "homepage", crawl_depth=0), page(3, "service", render_gap_score=95), page(4, "service", crawl_depth=1), page(5, "service", status_code=404), page(6, "other", shell_score=50, word_count=10), page(7, "tag", shell_score=30, word_count=60, title="", h1="", h1_count=0)])
    assert [r["page_id"] for r in queue.measurement_targets(pages, 9).collect()] == [2, 4, 1, 6, 7, 3]
    got = [(r["page_id"], r["stage"], r["escalation"]) for r in queue.render_targets(pages, 9).collect()]
    assert got == [(6, 0, 55), (7, 0, 51), (2, 1, 10), (3, 1, 10), (1, 1, 0), (4, 1, 10)]
    assert [r["page_id"] for r in queue.render_targets(pages, 3).collect()] == [6, 7, 2]


def test_state(spark):
    old = spark.createDataFrame([("a", "h1", 2), ("b", "h2", 0)], "k string, v string, not_modified_streak int")
    seen = spark.createDataFrame([("a", "h1"), ("c", "h3")], "k string, v string")
    assert sorted(map(tuple, state.advanced(old, seen, "k", "v").collect())) == [("a", "h1", 0, 3), ("b", "h2", 0, 0), ("c", "h3", 1, 0)]
    worked = []
    cache = spark.createDataFrame([("a", "A")], "k string, out string")
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    got = state.memoised(rows, cache, "k", lambda m: (worked.append(m.count()), m.select("k", F.upper("k").alias("out")))[1])
    assert sorted(map(tuple, got.collect())) == [("a", "A"), ("b", "B")] and worked == [1]


def test_streams(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.stream_counts(stream, ["event_type"], "running_counts", str(tmp_path / "c1"))
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("running_counts").select("event_type", "n").collect())) == sorted(map(tuple, events.groupBy("event_type").count().collect()))
    q = state.stream_merge(stream, ["user_id"], "event_id", str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination()
    last = sorted(p.name for p in (tmp_path / "out").iterdir())[-1]
    got = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()}
    assert got == {r["user_id"]: r["e"] for r in events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}


def one(df, column):
    return [tuple(r[0]) if hasattr(r[0], "__fields__") else r[0] for r in df.select(column).collect()]


def test_effective_facts_and_canonicals(spark):
    c = F.col
    df = spark.createDataFrame([("a", "b", True), ("a", "", True), ("a", "b", False), ("", "", True), (None, None, None)], "raw string, rendered string, used boolean")
    assert one(df, resolution.effective(c("raw"), c("rendered"), c("used"), "raw_fallback")) == [("b", "rendered"), ("a", "raw_fallback"), ("a", "raw"), ("", "raw_fallback"), ("", "raw")]
    rows = [("r", ["a"], "p", True), ("p", ["a", "p"], "p", True), ("a", ["a", "b"], "p", True), ("r", ["a", "b"], "p", True), ("r", ["a"], "p", False), ("", [], "p", True), ("a", ["a"], "p", True)]
    df = spark.createDataFrame(rows, "raw string, many array<string>, url string, used boolean")
    assert one(df, resolution.resolve_canonical(c("raw"), c("many"), c("url"), c("used"))) == [
        ("a", "resolver:rendered_single", 1, 0), ("p", "resolver:rendered_self_match", 0, 0), ("a", "resolver:raw_agreement_fallback", 0, 0), ("", "resolver:rendered_multiple_unresolved", 1, 1), ("r", "raw", 0, 0), ("", "unresolved", 0, 0), ("a", "resolver:rendered_single", 0, 0),
    ]


def test_render_gap_and_escalation(spark):
    c = F.col
    rows = [(50, 400, "A", "B", "x", "y", 1, 2, 1, 30, True), (500, 520, "A", "A", "", "y", 1, 1, 10, 30, True), (50, 400, "A", "B", "x", "y", 1, 2, 1, 30, False)]
    df = spark.createDataFrame(rows, "w int, rw int, t string, rt string, k string, rk string, h int, rh int, l int, rl int, done boolean")
    gap = resolution.render_gap({"words": c("w"), "title": c("t"), "canonical": c("k"), "h1_count": c("h"), "links": c("l")}, {"words": c("rw"), "title": c("rt"), "canonical": c("rk"), "h1_count": c("rh"), "links": c("rl")}, c("done"))
    assert one(df, gap) == [
        (100, "raw thin but rendered rich; title mismatch; canonical mismatch; h1 mismatch; rendered links much richer"),
        (0, "raw and rendered signals are aligned"),
        (0, "render not available"),
    ]


def test_index_states_and_families(spark):
    c = F.col
    rows = [("", "URL is not indexed", "", "", ""), ("", "Submitted and indexed", "BLOCKED_BY_ROBOTS_TXT", "", ""), ("", "Excluded by noindex tag", "", "", ""), ("", "Submitted URL blocked by robots.txt", "", "", ""), ("PASS", "", "INDEXING_ALLOWED", "", ""), ("PASS", "", "INDEXING_ALLOWED", "", "BLOCKED_4XX"), ("NEUTRAL", "", "", "", ""), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "v string, c string, i string, r string, f string")
    assert one(df, resolution.index_state(c("v"), c("c"), c("i"), c("r"), c("f"))) == ["not_indexed", "indexed", "not_indexed", "not_indexed", "indexed", "not_indexed", "unknown", "unknown"]
    df = spark.createDataFrame([("RuntimeError: x",), ("Read timed out",), ("HTTP 429",), ("no CrUX record",), ("missing key",), ("HTTP 500",), (None,)], "m string")
    assert one(df, resolution.error_family(c("m"))) == ["runtime", "timeout", "quota", "no_fcp", "not_attempted_policy", "http", "http"]
    df = spark.createDataFrame([("Timeout 30s",), ("Playwright import failed",), ("navigation error",), ("render failure: x",), ("odd",), ("",)], "m string")
    assert one(df, resolution.render_error_family(c("m"))) == ["timeout", "environment", "navigation", "render_failure", "runtime", ""]


def test_platforms(spark):
    rows = [("<script src='/_next/static/x'></script><script id='__NEXT_DATA__'></script>", "e.com", {}), ("cdn.shopify.com shopify-section", "a.myshopify.com", {"server": "cloudflare", "cf-ray": "1"}), ("", "e.com", {"server": "cloudflare"}), ("wp-json", "wp.e.com", {}), ("wp-json wordpress", "e.com", {}), (None, None, None)]
    df = spark.createDataFrame(rows, "h string, host string, headers map<string,string>")
    assert one(df, resolution.platform(F.col("h"), F.col("host"), F.col("headers"))) == [("nextjs", 75), ("shopify", 99), ("cloudflare", 55), None, ("wordpress", 50), None]


def test_citation_and_governance(spark):
    rows = [Row(page_id=1, page_type="service", title="T", h1_count=1, word_count=400, internal_links_out=5, is_noindex=0, governance_bingbot_allowed=1, max_snippet_directive="", schema_validation_score=90, has_nosnippet_directive=0), Row(page_id=2, page_type="other", title="", h1_count=0, word_count=10, internal_links_out=0, is_noindex=1, governance_bingbot_allowed=0, max_snippet_directive="0", schema_validation_score=50, has_nosnippet_directive=1)]
    got = resolution.citation(resolution.governance(spark.createDataFrame(rows))).orderBy("page_id").collect()
    assert (got[0]["citation_score"], got[0]["citation_reasons"]) == (100, ["answer_like_visible_content"])
    assert (got[1]["citation_score"], got[1]["citation_reasons"]) == (0, ["noindex", "bingbot_blocked", "nosnippet", "max_snippet_non_positive", "weak_internal_prominence", "schema_validation_weak"])
    summary = resolution.governance_summary(spark.createDataFrame(rows)).first()
    assert (summary["total"], summary["bingbot_blocked"], summary["googlebot_blocked"], summary["preview_restricted_diagnostic_pages"], summary["preview_restricted_pages"]) == (2, 1, 0, 1, 0)


def test_scoped_directives(spark):
    rows = [(["index, nofollow"], ["noindex"], ["googlebot: nosnippet, max-image-preview:none", "bingbot: noarchive", "max-image-preview: standard"])]
    df = spark.createDataFrame(rows, "r array<string>, s array<string>, h array<string>")
    applied = columns.applied_directives(F.col("r"), F.col("s"), F.col("h"), "googlebot")
    assert one(df, F.array_join(applied, "|")) == ["index|max-image-preview: standard|max-image-preview:none|nofollow|noindex|nosnippet"]
    assert one(df, columns.strictest_preview(applied)) == ["none"]
    assert one(df, F.array_join(columns.applied_directives(F.col("r"), F.col("s"), F.col("h"), "generic"), "|")) == ["index|max-image-preview: standard|nofollow"]


def test_image_scores(spark):
    page = """<h2>Gallery</h2><img src="/a/red-door.png" alt="A red door" width="1600"><img src="/a/red-door.png" alt="img"><img src="/photo1.bmp"><img alt="no source">"""
    facts = html.extract(spark.createDataFrame([(1, "https://e.com/x", page), (2, "https://e.com/y", "")], "id int, url string, html string"), "id", "url", "html")
    got = {r["id"]: r for r in html.image_scores(facts, "id").collect()}
    # 2/3 texts, 1/3 descriptive, 2/3 names, 2/3 formats, all under a heading, 1/3 large, 2/3 reused.
    assert (got[1]["images"], got[1]["discoverability"]) == (3, round(25 * 2 / 3 + 10 / 3 + 20 * 2 / 3 + 15 * 2 / 3 + 10 + 10 / 3 + 10 * 2 / 3))
    assert (got[2]["images"], got[2]["discoverability"]) == (0, 70)


MARKED = """<html><head><title>T</title><meta property="og:video" content="/v.mp4"><script type="application/ld+json">{"@graph":[{"@type":"http://schema.org/Article","headline":"Shown Words","author":{"name":"A"},"image":[]},{"@type":["VideoObject"],"name":"Clip","contentUrl":"c.mp4"}]}</script>
<script type="application/ld+json"> </script><script type="application/ld+json">{no</script></head><body><p>shown words here</p><div itemscope itemtype="https://schema.org/Organization"><b itemprop="name">Hidden <i>Org</i></b><a itemprop="url" href="/o">o</a><a itemprop="url" href="/p">p</a>
<div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="name">Town</span></div><div itemscope><i itemprop="name">nobody's</i></div></div><div typeof="schema:DataVocabulary"><span property="schema:label">x</span></div><iframe src="https://www.youtube.com/e"></iframe><iframe src="https://x.com/?youtube"></iframe></body></html>"""


def test_schema_nodes():
    p = html.parse(MARKED, "https://e.com/")
    nodes = {n["types"][0]: n["fields"] for n in p["schema_nodes"] if n["types"]}
    assert nodes["Article"] == {"headline": "Shown Words", "author": "A"} and nodes["VideoObject"]["contentUrl"] == "c.mp4"
    assert nodes["Organization"] == {"name": "Hidden Org", "url": "/o", "address": "Town"} and nodes["PostalAddress"] == {"name": "Town"}
    assert nodes["DataVocabulary"] == {"label": "x"} and p["schema_parse_error_count"] == 1
    assert sorted(v["kind"] for v in p["videos"]) == ["embed", "metadata", "schema"]
    assert html.parse("<div itemscope itemtype=A><p itemprop=b>open", "")["schema_nodes"] == [{"types": ["A"], "fields": {"b": "open"}}]


def test_schema_validation(spark):
    from crawlweave.plans.schema import validated

    facts = html.extract(spark.createDataFrame([(1, "https://e.com/", MARKED), (2, "https://e.com/x", None)], "id int, url string, html string"), "id", "url", "html").withColumn("page_type", F.lit("Product"))
    got = {r["id"]: r for r in validated(facts, "id").collect()}
    assert got[1]["recognized_types"] == ["Article", "DataVocabulary", "Organization", "PostalAddress", "VideoObject"]
    assert got[1]["eligible_features"] == ["google:article_rich_results", "google:organization_knowledge"] and got[1]["deprecated_features"] == ["google:legacy_vocab"]
    assert got[1]["missing_required_by_feature"] == {"google:video_rich_results": ["thumbnailUrl"]}
    assert got[1]["missing_recommended_by_feature"]["google:article_rich_results"] == ["datePublished", "image"]
    assert got[1]["visible_content_mismatches"] == ["VideoObject.name"]
    # Faults: Article 10, VideoObject 15 + 15 + 5, Organization 10, DataVocabulary 10. Features: 64, 21, 64 and 35.
    assert got[1]["engine_feature_scores"] == {"google": 46} and got[1]["score"] == 40
    assert (got[2]["score"], got[2]["recognized_types"], got[2]["engine_feature_scores"]) == (100, [], {})
    assert [tuple(r)[1:] for r in html.video_scores(facts, "id", F.lit(1)).orderBy("id").collect()] == [(4, 1, 1, 0, 1, 1, 85), (1, 0, 0, 0, 0, 1, 15)]
