"""A run's report: small aggregates, one for each section, put together as Markdown on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_segment
from ..operators import relational as R
from . import policy as P

MOST_LINES = 50


# First segments of paths that make a page part of a track or of a performance group.
UTILITY_SEGMENTS = ["tag", "category", "gallery", "team", "gva_header", "footer", "author", "search"]
MONEY_SEGMENTS = ["fasteners", "service", "services", "product", "products", "portfolio", "contact", "quote"]
MONEY_TYPES = ["homepage", "service", "contact", "location"]


def track(page_type: Column, url: Column) -> Column:
    """utility, money or other: the part of a site that a page belongs to."""
    kind, segment = F.lower(F.coalesce(page_type, F.lit(""))), first_segment(url)
    return F.when((kind == "utility") | segment.isin(UTILITY_SEGMENTS), "utility").when(kind.isin(MONEY_TYPES) | segment.isin(MONEY_SEGMENTS), "money").otherwise("other")


def template_group(page_type: Column, url: Column) -> Column:
    """home, service, product, blog, taxonomy or other: the group that performance is reported by."""
    kind, segment = F.lower(F.coalesce(page_type, F.lit(""))), first_segment(url)
    return (
        F.when((kind == "homepage") | (segment == ""), "home")
        .when((kind == "service") | segment.isin("service", "services"), "service")
        .when(segment.isin("fasteners", "product", "products", "portfolio"), "product")
        .when((kind == "article") | segment.isin("news", "blog"), "blog")
        .when((kind == "utility") | segment.isin(UTILITY_SEGMENTS), "taxonomy")
        .otherwise("other")
    )


def sections(pages: DataFrame, issues: DataFrame, scores: DataFrame, performance: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the report; each has few rows."""
    p = P.completed(pages).withColumn("kind", P.page_type(True))
    i = issues.drop("kind", "page_type").join(p.select(F.col("normalized_url").alias("url"), "kind", "page_type").dropDuplicates(["url"]), "url", "left").withColumn("kind", F.coalesce("kind", F.lit("global"))).withColumn("track", F.when(F.col("kind") == "global", "global").otherwise(track(F.col("page_type"), F.col("url"))))
    band = R.bucketed(F.coalesce("confidence", F.lit(0)), [(85, "high"), (70, "medium")], "low")
    out = {
        "Totals": p.agg(F.count("*").alias("pages"), F.count_if(P.actionable()).alias("actionable"), F.count_if(F.col("is_noindex") == 1).alias("noindex"), F.round(F.coalesce(F.avg("word_count"), F.lit(0.0)), 2).alias("avg_words"), F.countDistinct("community_id").alias("communities"), F.coalesce(F.sum("bridge_flag"), F.lit(0)).alias("bridges")),
        "Severities": R.top_counts(i, ["severity"], None),
        "Codes": R.top_counts(i, ["issue_code"], 15),
        "Confidence": i.groupBy(band.alias("confidence")).agg(F.count("*").alias("n")),
        "Tracks by severity": i.groupBy("track", "severity").agg(F.count("*").alias("n")),
        "Top codes by track": R.top_per_group(i, ["track"], "issue_code", 5),
        "Facets": R.histograms(p, {"kind": "other", "shell_state": "unknown", "canonical_resolution": "missing"}),
        "Duplicates": R.duplicate_clusters(p, F.col("content_hash")).select(F.lit("content").alias("by"), "*").unionByName(R.duplicate_clusters(p, F.lower("title")).select(F.lit("title").alias("by"), "*")).unionByName(R.duplicate_clusters(p, F.lower("meta_description")).select(F.lit("description").alias("by"), "*")),
        "Snippet controls": p.agg(F.count_if(F.col("has_nosnippet_directive") == 1).alias("nosnippet"), F.coalesce(F.sum("data_nosnippet_count"), F.lit(0)).alias("marked"), F.count_if(P.restriction() >= 4).alias("restrictive"), F.count_if(~P.snippet_eligible()).alias("not_eligible")),
        "Most marked pages": p.where("data_nosnippet_count >= 4").orderBy(F.col("data_nosnippet_count").desc(), "normalized_url").limit(10).select("normalized_url", "data_nosnippet_count"),
        "Highest priority": i.orderBy(F.col("priority_score").desc(), "url", "issue_code").limit(10).select("priority_score", "severity", "issue_code", "url"),
        "Render gaps": p.where("render_gap_score > 0").orderBy(F.col("render_gap_score").desc(), "normalized_url").limit(10).select("normalized_url", "render_gap_score"),
        "Architecture": p.agg(F.count_if(F.col("orphan_risk_flag") == 1).alias("orphans"), F.count_if(P.links_out() <= 1).alias("few_links_out"), F.count_if(F.col("crawl_depth").isNull()).alias("unreachable"), F.max("crawl_depth").alias("max_depth")),
        "Scores": scores.agg(F.round(F.avg("overall_score"), 2).alias("average"), F.percentile("overall_score", F.lit(0.5)).cast("int").alias("median"), F.min("overall_score").alias("minimum"), F.max("overall_score").alias("maximum")),
    }
    # The first few pages of each code.
    per = i.select("issue_code", "url").distinct()
    few = per.withColumn("r", F.row_number().over(Window.partitionBy("issue_code").orderBy("url"))).where("r <= 3")
    out["Examples"] = few.groupBy("issue_code").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("urls")).orderBy("issue_code")
    if performance is not None:
        out["Performance"] = performance_groups(performance, p).groupBy("template_group").agg(F.count("*").alias("rows"), F.count("performance_score").alias("scored"), F.round(F.avg("performance_score"), 2).alias("average"))
    return out


def performance_groups(performance: DataFrame, pages: DataFrame) -> DataFrame:
    """Performance rows with the template group of their page; by the URL alone where the page is unknown."""
    kinds = pages.select(F.col("normalized_url").alias("url"), "page_type").dropDuplicates(["url"])
    return performance.drop("page_type").join(kinds, "url", "left").withColumn("template_group", template_group(F.col("page_type"), F.col("url")))


def page_performance(performance: DataFrame) -> DataFrame:
    """url, performance_score: mean over strategies, missing and zero ones as 50, truncated."""
    score = F.coalesce(F.nullif(F.col("performance_score"), F.lit(0)), F.lit(50))
    return performance.groupBy("url").agg(F.avg(score).cast("int").alias("performance_score"))


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """Headings and tables, MOST_LINES rows of each."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(MOST_LINES).collect()
        out += ["", f"## {name}", ""]
        if not rows:
            out.append("None.")
            continue
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]
    return "\n".join(out) + "\n"
