"""Visibility evidence: adapters as DataFrame transforms that add to it, and findings about runs rather than pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Adapter = Callable[[DataFrame], DataFrame]


def with_evidence(pages: DataFrame, adapters: Sequence[tuple[str, Adapter]]) -> DataFrame:
    """pages with columns adapters and errors: names of the adapters that were applied, messages of those that could not be planned."""
    done, errors, out = [], [], pages
    for name, adapter in adapters:
        try:
            out = adapter(out)
            out.schema  # noqa: B018  analyses the plan, so that a fault shows here
            done.append(name)
        except Exception as e:  # an adapter's fault is evidence, not the run's end
            errors.append(f"{name}: {str(e).splitlines()[0][:200]}")
    text = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return out.withColumn("adapters", text(done)).withColumn("errors", text(errors))


def search_adapter(metrics: DataFrame) -> Adapter:
    """Clicks and impressions by normalized_url, 0 where unknown."""
    return lambda pages: pages.join(metrics.select("normalized_url", "clicks", "impressions"), "normalized_url", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("clicks", "impressions")})


def observed(pages: DataFrame) -> DataFrame:
    """Mean potential and number of pages with any observed signal; adapters counted."""
    signal = (F.coalesce("clicks", F.lit(0.0)) > 0) | (F.coalesce("impressions", F.lit(0.0)) > 0)
    return pages.agg(F.bround(F.avg("potential"), 2).alias("avg_potential"), F.count_if(signal).alias("observed_pages"), F.count("*").alias("pages"))


#: What a page's visibility payload holds.
PAYLOAD = "struct<potential:struct<score:string,reasons:array<string>>,observed_evidence:map<string,string>,adapters_applied:array<string>,adapter_errors:array<string>>"


def merged_payload(payload: Column, adapters: Column, errors: Column, score: Column) -> Column:
    """struct(score, adapters, errors): a payload with a new score where one is given, adapters it lacks and all errors appended; blanks are left out."""
    none, p = F.array().cast("array<string>"), F.from_json(payload, PAYLOAD)
    clean = lambda a: F.filter(F.transform(F.coalesce(a, none), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    kept = F.coalesce(p["adapters_applied"], none)
    old = F.coalesce(p["potential"]["score"].try_cast("int"), F.lit(0))
    return F.struct(
        F.when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(old).cast("int").alias("score"),
        F.concat(kept, F.filter(F.array_distinct(clean(adapters)), lambda v: ~F.array_contains(kept, v))).alias("adapters"),
        F.concat(F.coalesce(p["adapter_errors"], none), clean(errors)).alias("errors"),
    )


def payload_counts(pages: DataFrame, payload: str, score: str) -> tuple[DataFrame, DataFrame]:
    """One row (mean potential, pages with an observed signal, pages), and the number of pages by adapter."""
    p = F.from_json(F.coalesce(F.col(payload), F.lit("{}")), PAYLOAD)
    number = lambda k: F.coalesce(F.try_element_at(p["observed_evidence"], F.lit(k)).try_cast("int"), F.lit(0))
    value = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col(score).cast("int"), p["potential"]["score"].try_cast("int"), F.lit(0))))
    signal = (number("gsc_impressions") > 0) | (number("gsc_clicks") > 0) | (number("chatgpt_referrals") > 0)
    total = pages.agg(F.bround(F.coalesce(F.avg(value), F.lit(0.0)), 2).alias("avg_potential"), F.count_if(signal).alias("observed_pages"), F.count("*").alias("pages"))
    names = pages.select(F.explode(F.coalesce(p["adapters_applied"], F.array().cast("array<string>"))).alias("name")).select(F.trim("name").alias("adapter")).where("adapter <> ''")
    return total, names.groupBy("adapter").agg(F.count("*").alias("n"))


# Discovery modes in which rendering is to find links.
RENDER_DISCOVERY = ["hybrid", "browser_first"]


def blind_spot(pages: DataFrame, stats: DataFrame, mode: str, run_id: str, domain: str) -> DataFrame:
    """DISCOVERY_BLIND_SPOT where shells were seen and rendering has found nothing. stats: one row of checks, successes, enqueued."""
    shells = pages.agg(F.count_if(F.coalesce("likely_js_shell", F.lit(0)) == 1).alias("shell_like_pages"))
    found = shells.join(F.broadcast(stats.select("checks", "successes", "enqueued")), how="cross")
    blind = F.lit(mode in RENDER_DISCOVERY) & (F.col("shell_like_pages") > 0) & ((F.col("checks") == 0) | ((F.col("successes") == 0) & (F.col("enqueued") == 0)))
    evidence = F.to_json(F.struct("shell_like_pages", "checks", "successes", "enqueued"))
    return found.where(blind).select(F.lit(run_id).alias("run_id"), F.lit(domain).alias("url"), F.lit("DISCOVERY_BLIND_SPOT").alias("issue_code"), F.lit("medium").alias("severity"), F.lit("both").alias("provenance"), evidence.alias("evidence"))


def sitemap_findings(entries: DataFrame, pages: DataFrame, run_id: str, domain: str, samples: int = 20) -> DataFrame:
    """SITEMAP_URL_NOT_CRAWLED and CRAWLED_URL_NOT_IN_SITEMAP: a row each if there are such URLs, with their number and the first few."""
    from . import policy as P

    urls = entries.where("entry_kind = 'url'").select("url").distinct()
    crawled = P.completed(pages).where(P.actionable()).select(F.col("normalized_url").alias("url")).distinct()
    out = None
    for code, missing in (("SITEMAP_URL_NOT_CRAWLED", urls.join(crawled, "url", "left_anti")), ("CRAWLED_URL_NOT_IN_SITEMAP", crawled.join(urls, "url", "left_anti"))):
        first = missing.orderBy("url").limit(samples).agg(F.array_sort(F.collect_list("url")).alias("sample"))
        row = missing.agg(F.count("*").alias("n")).where("n > 0").withColumn("__k", F.lit(0)).join(first.withColumn("__k", F.lit(0)), "__k")
        row = row.select(F.lit(run_id).alias("run_id"), F.lit(domain).alias("url"), F.lit(code).alias("issue_code"), F.lit("medium").alias("severity"), F.lit("both").alias("provenance"), F.to_json(F.struct("n", "sample")).alias("evidence"))
        out = row if out is None else out.unionByName(row)
    return out


# Findings about outcomes of providers: code, severity, table, condition.
OUTCOMES = [
    ("RENDER_UNAVAILABLE", "medium", "render_sessions", "status = 'failed'"),
    ("PERFORMANCE_PROVIDER_ERROR", "low", "performance_metrics", "status = 'failed'"),
    ("CRUX_PROVIDER_ERROR", "low", "crux_metrics", "status = 'failed'"),
    ("LIGHTHOUSE_BUDGET_FAIL", "medium", "lighthouse_metrics", "status = 'success' AND (performance_score < 70 OR seo_score < 70)"),
    ("GSC_INDEX_STATE_NOT_INDEXED", "high", "index_state_history", "state = 'not_indexed'"),
]


def outcome_findings(tables: dict[str, DataFrame]) -> DataFrame | None:
    """A row for each page and outcome that is one; None if no table is given."""
    out = None
    for code, severity, name, condition in OUTCOMES:
        if name in tables:
            rows = tables[name].where(condition).select("run_id", "url").distinct().select("run_id", "url", F.lit(code).alias("issue_code"), F.lit(severity).alias("severity"), F.lit("both").alias("provenance"), F.lit(None).cast("string").alias("evidence"))
            out = rows if out is None else out.unionByName(rows)
    return out
