"""Read side: summaries, lists with filters and pages, one URL, comparison of runs, architecture, ad-hoc SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R

# Orders of labels, and limits of ad-hoc queries and exports.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
REACHES = ["", "single_page", "template_cluster", "sitewide"]
MOST_SQL, MOST_ROWS, MOST_EXPORT = 6000, 1000, 10_000
MUTATING = "insert|update|delete|drop|alter|create|replace|attach|detach|pragma|vacuum|reindex|truncate|merge|grant|revoke"
MONEY = ["homepage", "service", "location", "product"]


def checked_sql(sql: str) -> str:
    """A single SELECT or WITH statement without words that change data; anything else is an error. Registered views are the boundary, not this check."""
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        raise ValueError("empty query")
    if len(text) > MOST_SQL:
        raise ValueError("query too long")
    if ";" in text:
        raise ValueError("one statement only")
    if not re.match(r"(select|with)\b", text, re.IGNORECASE):
        raise ValueError("only SELECT or WITH")
    if re.search(rf"\b({MUTATING})\b", text, re.IGNORECASE):
        raise ValueError("read-only")
    return text


def adhoc(spark: SparkSession, tables: dict[str, DataFrame], sql: str, limit: int = 200, run_id: str | None = None) -> DataFrame:
    """Rows of a checked query over the given tables alone; :run_id is bound if the query uses it."""
    text = checked_sql(sql)
    limit = max(1, min(MOST_ROWS, limit))
    args = {"run_id": run_id} if ":run_id" in text else None
    views = {name: "{" + name + "}" for name in tables}
    # Tables are passed as parameters of the statement, so that no view outlives it.
    for name, mark in views.items():
        text = re.sub(rf"\b{re.escape(name)}\b(?!\s*\.)(?=(?:[^']*'[^']*')*[^']*$)", mark, text) if re.search(rf"\b(from|join)\s+{re.escape(name)}\b", text, re.IGNORECASE) else text
    return spark.sql(f"SELECT * FROM ({text}) AS q LIMIT {limit}", args=args, **{n: t for n, t in tables.items() if views[n] in text})


def newest_run(runs: DataFrame) -> str | None:
    row = runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("r")).first()
    return row["r"]


def of_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("run_id") == run_id)


def summary(pages: DataFrame, issues: DataFrame, scores: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """Counts, severities, top codes and score statistics of a run, each a small table."""
    s = of_run(scores, run_id)
    x = F.col("overall_score")
    return {
        "pages": of_run(pages, run_id).agg(F.count("*").alias("n")),
        "issues": of_run(issues, run_id).agg(F.count("*").alias("n")),
        "severities": of_run(issues, run_id).groupBy("severity").agg(F.count("*").alias("n")),
        "codes": R.top_counts(of_run(issues, run_id), ["issue_code"], 15),
        "scores": s.agg(F.round(F.avg(x), 2).alias("average"), F.percentile(x, F.lit(0.5)).cast("int").alias("median"), F.min(x).alias("minimum"), F.max(x).alias("maximum")),
    }


def list_pages(pages: DataFrame, scores: DataFrame, issues: DataFrame, run_id: str, *, page_type: str | None = None, status: int | None = None, max_depth: int | None = None, min_score: int | None = None, severity: str | None = None, search: str | None = None, sort_by: str = "score", descending: bool = True, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """One page of pages with score and number of issues, and the number of rows in all."""
    p = of_run(pages, run_id).withColumnRenamed("normalized_url", "url")
    p = R.filtered(p, [F.col("page_type") == page_type if page_type else None, F.col("status_code") == status if status is not None else None, F.coalesce("crawl_depth", F.lit(999)) <= max_depth if max_depth is not None else None])
    p = R.text_search(p, [c for c in ("url", "title", "h1") if c in p.columns], search)
    p = p.join(of_run(scores, run_id).select("url", "overall_score"), "url", "left")
    i = of_run(issues, run_id)
    if severity:
        p = p.join(i.where(F.lower("severity") == severity.lower()).select("url"), "url", "left_semi")
    if min_score is not None:
        p = p.where(F.coalesce("overall_score", F.lit(0)) >= min_score)
    p = R.with_match_count(p, i.select(F.col("url").alias("issue_url")), {"url": "issue_url"}, "issue_count")
    keys = {"url": F.col("url"), "score": F.coalesce("overall_score", F.lit(0)), "depth": F.coalesce("crawl_depth", F.lit(999)), "status": F.coalesce("status_code", F.lit(0)), "issues": F.col("issue_count")}
    key = keys.get(sort_by, keys["score"])
    return R.page_of(p, [key.desc() if descending else key.asc(), F.col("url")], page, page_size), p.agg(F.count("*").alias("total"))


def list_issues(issues: DataFrame, pages: DataFrame, scores: DataFrame, run_id: str, *, severity: str | None = None, code: str | None = None, page_type: str | None = None, certainty: str | None = None, min_priority: int | None = None, search: str | None = None, sort_by: str = "priority", descending: bool = True, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """One page of issues with facts of their pages, and the number of rows in all."""
    i = of_run(issues, run_id)
    for name, default in (("priority_score", 0), ("certainty_state", ""), ("reach", "single_page"), ("confidence_score", 0)):
        if name not in i.columns:
            i = i.withColumn(name, F.lit(default))
    if "seq" not in i.columns:
        i = i.withColumn("seq", F.xxhash64("url", "issue_code"))
    i = R.filtered(i, [F.lower("severity") == severity.lower() if severity else None, F.col("issue_code") == code.upper() if code else None, F.col("certainty_state") == certainty if certainty else None, F.coalesce("priority_score", F.lit(0)) >= min_priority if min_priority is not None else None])
    i = R.text_search(i, ["url", "title", "description"], search)
    p = of_run(pages, run_id).select(F.col("normalized_url").alias("url"), "page_type", "status_code")
    i = i.join(p, "url", "left").join(of_run(scores, run_id).select("url", "overall_score"), "url", "left")
    if page_type:
        i = i.where(F.col("page_type") == page_type)
    severities, reach = R.ranks(F.col("severity"), SEVERITIES), R.ranks(F.col("reach"), REACHES, 1)
    keys = {"priority": F.col("priority_score"), "severity": severities, "reach": reach, "code": F.col("issue_code"), "url": F.col("url"), "confidence": F.col("confidence_score"), "certainty": F.col("certainty_state"), "score": F.coalesce("overall_score", F.lit(0))}
    key = keys.get(sort_by, keys["priority"])
    order = [key.desc() if descending else key.asc(), F.col("priority_score").desc(), severities.desc(), reach.desc(), F.col("url"), F.col("seq")]
    return R.page_of(i, order, page, page_size), i.agg(F.count("*").alias("total"))


def url_detail(tables: dict[str, DataFrame], run_id: str, url: str) -> dict[str, DataFrame]:
    """All that is known of one URL."""
    at = lambda name, column="url": of_run(tables[name], run_id).where(F.col(column) == url)
    out = {"page": at("pages", "normalized_url"), "issues": at("issues"), "scores": at("scores"), "outgoing": at("links", "source_url").limit(250), "incoming": at("links", "normalized_target_url").where("is_internal = 1").limit(250)}
    return out | {n: at(n) for n in ("performance_metrics", "crux_metrics") if n in tables}


def compare_runs(issues: DataFrame, scores: DataFrame, left: str, right: str) -> dict[str, DataFrame]:
    """Scores of URLs in both runs by size of change (at most 100), their mean change, and counts of issue codes."""
    if left == right:
        raise ValueError("two different runs are needed")
    changes = R.compare_values(of_run(scores, left), of_run(scores, right), "url", "overall_score", 100)
    return {
        "scores": changes,
        "summary": changes.agg(F.count("*").alias("shared_urls"), F.round(F.avg("delta"), 2).alias("average_delta"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("declined")),
        "codes": R.compare_counts(of_run(issues, left), of_run(issues, right), "issue_code"),
    }


def architecture(pages: DataFrame, metrics: DataFrame, scores: DataFrame, links: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """nodes; important pages with weak support; overloaded hubs; communities apart from the largest."""
    m = of_run(metrics, run_id)
    p = of_run(pages, run_id).select(F.col("normalized_url").alias("url"), "page_type", "crawl_depth")
    into = of_run(links, run_id).where("is_internal = 1").select(F.col("normalized_target_url").alias("target"))
    nodes = R.with_match_count(m.join(p, "url", "left").join(of_run(scores, run_id).select("url", "overall_score"), "url", "left"), into, {"url": "target"}, "inlinks")
    cut = m.agg(F.percentile(F.when(F.col("internal_pagerank") > 0, F.col("internal_pagerank")), F.lit(0.25)).alias("weak"), F.percentile(F.when(F.col("betweenness") > 0, F.col("betweenness")), F.lit(0.9)).alias("hub")).first()
    weak = nodes.where(F.col("page_type").isin(MONEY) & (F.col("internal_pagerank") > 0) & (F.col("internal_pagerank") <= F.lit(cut["weak"] or 0.0)) & ((F.col("inlinks") <= 1) | (F.col("closeness") < 0.18)))
    hubs = nodes.where((F.col("bridge_flag") == 1) & (F.col("betweenness") >= F.lit(max(0.05, cut["hub"] or 0.0))))
    sizes = nodes.where("community_id > 0").groupBy("community_id").agg(F.count("*").alias("size"))
    typed = nodes.where("community_id > 0").groupBy("community_id", "page_type").agg(F.count("*").alias("n"))
    dominant = typed.groupBy("community_id").agg(F.max_by("page_type", F.struct("n", "page_type")).alias("dominant_type"))
    primary = sizes.agg(F.max_by("community_id", F.struct("size", "community_id")).alias("primary"))
    sample = nodes.withColumn("__r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.col("internal_pagerank").desc(), "url"))).where("__r <= 3")
    samples = sample.groupBy("community_id").agg(F.array_sort(F.collect_list("url")).alias("samples"))
    first = primary.first()["primary"]
    apart = sizes.where((F.col("size") >= 2) & (F.col("community_id") != F.lit(first if first is not None else 0))).join(dominant, "community_id").join(samples, "community_id")
    return {"nodes": nodes, "weak_support": weak, "overloaded_hubs": hubs, "disconnected": apart, "communities": sizes.join(dominant, "community_id")}


# Counters of a provider's summary, and of a crawl.
PROVIDER_COUNTERS = ["attempts", "http_attempts", "retries", "timeouts", "success", "no_data", "failed_http", "skipped_missing_key"]
CRAWL_COUNTERS = ["fetched", "fetch_retries_total", "fetch_retry_wait_ms_total", "fetch_retry_after_used", "fetch_retryable_status_total", "fetch_network_retries_total", "fetch_retry_budget_exhausted", "reused_from_cache", "not_modified", "reparsed", "rerendered"]


def provider_telemetry(events: DataFrame) -> DataFrame:
    """event_id, provider and its counters from the JSON of provider summaries; what is missing or no number is 0."""
    detail = F.from_json("detail_json", ", ".join(f"{c} string" for c in [*PROVIDER_COUNTERS, "wait_seconds"]))
    rows = events.where("event_type = 'provider_summary'").withColumn("d", detail)
    counters = [F.coalesce(F.col(f"d.{c}").try_cast("int"), F.lit(0)).alias(c) for c in PROVIDER_COUNTERS]
    return rows.select("event_id", F.col("stage").alias("provider"), *counters, F.coalesce(F.col("d.wait_seconds").try_cast("double"), F.lit(0.0)).alias("wait_seconds"))


def crawl_counters(increments: DataFrame) -> DataFrame:
    """One row: the sum of each counter over rows (stat, n), 0 where there is none."""
    return increments.agg(*[F.coalesce(F.sum(F.when(F.col("stat") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in CRAWL_COUNTERS])


def export_csv(df: DataFrame) -> str:
    """CSV text of at most MOST_EXPORT rows."""
    return df.limit(MOST_EXPORT).toPandas().to_csv(index=False)
