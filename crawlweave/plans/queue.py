"""Selections of a crawl: which jobs and URLs are next. State transitions are not Spark's; what to pick is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from . import policy as P

READY = ["queued", "retry_wait"]


def active_load(jobs: DataFrame) -> DataFrame:
    """Sums over running jobs: one row."""
    running = F.col("state").isin("leased", "running")
    load = lambda c: F.coalesce(F.sum(F.when(running, F.col(c))), F.lit(0)).alias(f"load_{c}")
    return jobs.agg(*[load(c) for c in ("required_tokens", "render_heavy", "provider_heavy", "offsite_heavy")])


def next_jobs(jobs: DataFrame, now: str, limits: dict[str, int], exclusive_domains: bool = True, limit: int = 100) -> DataFrame:
    """Jobs that may start, best first: by priority, then age. A limit holds for a job's own needs on top of what runs."""
    load = F.broadcast(active_load(jobs))
    ready = jobs.where(F.col("state").isin(READY) & (F.coalesce("cancel_requested", F.lit(0)) == 0) & (F.coalesce("next_eligible_at", "submitted_at") <= F.lit(now).cast("timestamp")))
    if exclusive_domains:
        ready = ready.join(jobs.where(F.col("state").isin("leased", "running")).select("domain_key").distinct(), "domain_key", "left_anti")
    ready = ready.join(load, how="cross")
    for column, most in limits.items():
        ready = ready.where(F.col(f"load_{column}") + F.coalesce(column, F.lit(0)) <= most)
    return ready.orderBy(F.col("priority").desc(), "submitted_at", "job_id").limit(limit).select(*jobs.columns)


def latest_attempts(attempts: DataFrame) -> DataFrame:
    return R.latest_per_key(attempts, ["job_id"], ["attempt_no", "attempt_id"])


def expired(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs whose lease has run out."""
    return jobs.where(F.col("state").isin("leased", "running") & (F.col("lease_expires_at") < F.lit(now).cast("timestamp")))


def frontier(urls: DataFrame, budget: int | None = None, most: int | None = None) -> DataFrame:
    """URLs by falling priority, first come first of equal ones; at most `budget` of a cluster and `most` in all."""
    rows = R.first_per_key(urls, ["url"], ["seq"])
    if budget:
        rows = R.within_budget(rows, ["cluster_key"], [F.col("priority").desc(), F.col("seq")], budget).drop("rank")
    rows = rows.orderBy(F.col("priority").desc(), "seq")
    return rows.limit(most) if most else rows


def crawl_plan(urls: DataFrame, state: DataFrame) -> DataFrame:
    """URLs in the order of a recrawl: changed ones first, then by unchanged streak, then by name; unknown ones count as changed."""
    joined = urls.join(state.select(F.col("normalized_url").alias("url"), "changed", "not_modified_streak"), "url", "left")
    joined = joined.withColumns({"changed": F.coalesce("changed", F.lit(1)), "not_modified_streak": F.coalesce("not_modified_streak", F.lit(0))})
    return joined.orderBy(F.col("changed").desc(), "not_modified_streak", "url")


# Which page types are measured first; from which render gap on a page is measured late; statuses by rank.
MEASURE_ORDER = {"homepage": 0, "service": 1, "contact": 2, "about": 3, "location": 4, "article": 5, "industry": 6, "other": 7}
UNSTABLE_GAP = 90
STATUS_RANK = {"measurement_not_attempted_by_policy": 1, "skipped": 1, "provider_unavailable_data": 2, "no_field_data": 2, "runtime_error": 3, "provider_runtime_error": 4, "provider_error": 5, "ok": 6}
NOT_ATTEMPTED, NOT_ATTEMPTED_FAMILY = "measurement_not_attempted_by_policy", "not_attempted_policy"


def _first_by(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows by order, each URL once."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("normalized_url").orderBy(*order))).where("__r = 1").drop("__r")
    return first.orderBy(*order).limit(k)


def measurement_targets(pages: DataFrame, k: int) -> DataFrame:
    """The k pages to measure, of those that work: homepages, then stable ones, by type, depth, links out and words; each URL once."""
    p = P.completed(pages).where(P.actionable() & (F.col("fetch_error") == "") & (F.col("normalized_url") != ""))
    kind = F.coalesce(F.nullif(F.col("page_type"), F.lit("")), F.lit("other"))
    depth = F.coalesce(F.nullif(F.col("crawl_depth"), F.lit(0)), F.lit(99))
    order = [kind != "homepage", F.col("render_gap_score") >= UNSTABLE_GAP, P.looked_up(MEASURE_ORDER, kind, 99), depth, F.coalesce("internal_links_out", F.lit(0)).desc(), F.col("word_count").desc(), F.col("normalized_url")]
    return _first_by(p, order, k)


def render_targets(pages: DataFrame, k: int, least: int = 35, seq: str = "page_id") -> DataFrame:
    """The k pages to render, with their stage and escalation: first those that need it, the neediest first; then a sample of the others.

    The sample: a homepage (else the first page), the service or industry page with most links, an article, the shortest thin
    page, then pages by links and length.
    """
    from .resolution import render_escalation

    rows = P.completed(pages).where(P.actionable() & (F.col("fetch_error") == "") & (F.col("normalized_url") != "")).withColumn("escalation", render_escalation()["score"])
    kind, links, words = F.col("page_type"), F.coalesce("internal_links_out", F.lit(0)), F.col("word_count")
    # Whole-table orders: of each kind of the sample only the first page counts, so these are small top-k reads.
    picks = [
        (0, rows.orderBy(kind != "homepage", seq)),
        (1, rows.where(kind.isin("service", "industry")).orderBy(links.desc(), seq)),
        (2, rows.where(kind == "article").orderBy(seq)),
        (3, rows.where(words < 120).orderBy(words, seq)),
    ]
    marked = None
    for place, ordered in picks:
        one = ordered.limit(1).select(F.col("normalized_url"), F.lit(place).alias("place"))
        marked = one if marked is None else marked.unionByName(one)
    marked = marked.groupBy("normalized_url").agg(F.min("place").alias("place"))
    rows = rows.join(F.broadcast(marked), "normalized_url", "left").withColumn("stage", F.when(F.col("escalation") >= least, 0).otherwise(1))
    depth = F.coalesce(F.nullif(F.col("crawl_depth"), F.lit(0)), F.lit(99))
    needy = lambda c: F.when(F.col("stage") == 0, c)
    rest = lambda c: F.when(F.col("stage") == 1, c)
    order = [F.col("stage"), needy(-F.col("escalation")), needy((kind != "homepage").cast("int")), needy(depth), needy(-links), needy(F.col("normalized_url")), rest(F.coalesce("place", F.lit(4))), rest(-links), rest(words), F.col(seq)]
    return _first_by(rows, order, k)


def measurement_status(urls: DataFrame, evidence: DataFrame) -> DataFrame:
    """url, status, family of every URL: the evidence of the highest rank, the last of equals; not attempted where there is none.

    evidence: url, status, family, seq.
    """
    none = urls.select("url", F.lit(NOT_ATTEMPTED).alias("status"), F.lit(NOT_ATTEMPTED_FAMILY).alias("family"), F.lit(-1).cast("long").alias("seq")).distinct()
    rows = none.unionByName(evidence.where("trim(url) <> ''").select("url", "status", "family", F.col("seq").cast("long").alias("seq")))
    best = F.max_by(F.struct("status", "family"), F.struct(P.looked_up(STATUS_RANK, F.col("status"), 0), F.col("seq")))
    return rows.groupBy("url").agg(best.alias("b")).select("url", "b.status", "b.family")


def field_evidence(rows: DataFrame) -> DataFrame:
    """Evidence of field-data responses: url, their status, error_message, seq."""
    from .resolution import error_family

    family = error_family(F.col("error_message"))
    found = F.lower(F.trim("status"))
    failed = found == "failed_http"
    status = F.when(found == "success", "ok").when(found == "no_data", "provider_unavailable_data").when(failed & (family == "runtime"), "provider_runtime_error").when(failed, "provider_error").when(found == "skipped_missing_key", NOT_ATTEMPTED)
    kind = F.when(found == "success", "none").when(found == "no_data", "no_fcp").when(failed, family).when(found == "skipped_missing_key", NOT_ATTEMPTED_FAMILY)
    return rows.select("url", status.alias("status"), kind.alias("family"), "seq").where("status IS NOT NULL")


def changed_only(pages: DataFrame, incremental: bool, versions_changed: bool) -> DataFrame:
    """Pages that rendering is chosen from: all, or in an incremental crawl under unchanged rules those that have changed."""
    return pages.where(F.coalesce("changed_since_last_run", F.lit(0)) == 1) if incremental and not versions_changed else pages


def recent_urls(rows: DataFrame, seq: str, limit: int, url: str = "url") -> DataFrame:
    """URLs of the last `limit` rows by seq, newest first, each once, blanks left out."""
    last = rows.orderBy(F.col(seq).desc()).limit(max(1, limit)).select(F.trim(F.coalesce(url, F.lit(""))).alias("url"), F.col(seq).alias("seq"))
    return last.where("url <> ''").groupBy("url").agg(F.max("seq").alias("seq")).orderBy(F.col("seq").desc())
