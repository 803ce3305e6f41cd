"""Sitemap XML as entries, with image, video, news and language extensions, and indexes expanded level by level."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_one

ENTRY = "sitemap_url string, entry_kind string, url string, lastmod string, changefreq string, priority string, images array<map<string,string>>, videos array<map<string,string>>, news map<string,string>, hreflang array<struct<lang:string,href:string>>"
MOST_SITEMAPS = 30


def _name(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1].lower()


def _fields(node: ElementTree.Element) -> dict[str, str]:
    """Texts of a node's children by local name, nested ones as `parent_child`."""
    out: dict[str, str] = {}
    for child in node:
        if len(child):
            out |= {f"{_name(child)}_{k}": v for k, v in _fields(child).items()}
        elif (child.text or "").strip():
            out.setdefault(_name(child), child.text.strip())
    return out


def parse(sitemap_url: str, xml: str | None) -> list[dict]:
    """Entries of a sitemap or of an index; none for anything else."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    kind = {"urlset": ("url", "url"), "sitemapindex": ("sitemap", "sitemap_index")}.get(_name(root))
    out = []
    for node in root if kind else ():
        facts = _fields(node)
        if _name(node) != kind[0] or not facts.get("loc"):
            continue
        several = {k: [f for c in node if _name(c) == k and (f := _fields(c))] for k in ("image", "video", "news")}
        alternates = [c.attrib for c in node if _name(c) == "link" and c.attrib.get("rel", "").lower() == "alternate" and c.attrib.get("hreflang") and c.attrib.get("href")]
        out.append(
            {
                "sitemap_url": sitemap_url, "entry_kind": kind[1], "url": normalize_one(facts["loc"], sitemap_url), "lastmod": facts.get("lastmod", ""), "changefreq": facts.get("changefreq", ""), "priority": facts.get("priority", ""),
                "images": several["image"], "videos": several["video"], "news": several["news"][0] if several["news"] else {}, "hreflang": [{"lang": a["hreflang"].strip().lower(), "href": normalize_one(a["href"], sitemap_url)} for a in alternates],
            }
        )
    return out


def entries(sitemaps: DataFrame, url: str = "sitemap_url", xml: str = "xml") -> DataFrame:
    """Entries of all sitemaps of a table."""
    names = [f.strip().split(" ")[0] for f in ENTRY.replace("array<struct<lang:string,href:string>>", "x").replace("map<string,string>", "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([e for u, x in zip(frame["u"], frame["x"], strict=True) for e in parse(u, x)], columns=names)

    return sitemaps.select(F.col(url).alias("u"), F.col(xml).alias("x")).mapInPandas(run, ENTRY)


def expand(sitemaps: DataFrame, starts: list[str], most: int = MOST_SITEMAPS) -> DataFrame:
    """Entries of the given sitemaps and of all that their indexes lead to, each once, at most `most` sitemaps."""
    seen: list[str] = []
    level, found = list(dict.fromkeys(starts)), None
    while level and len(seen) < most:
        level = level[: most - len(seen)]
        seen += level
        got = entries(sitemaps.where(F.col("sitemap_url").isin(level)))
        found = got if found is None else found.unionByName(got)
        nested = got.where("entry_kind = 'sitemap_index'").select("url").distinct().orderBy("url").limit(most).collect()
        level = [r["url"] for r in nested if r["url"] not in seen]
    return found if found is not None else entries(sitemaps.limit(0))


def deltas(found: DataFrame, pages: DataFrame, as_of: str, stale_days: int = 365) -> DataFrame:
    """One row of measures: sizes of both url sets and of their differences, missing and stale lastmods, assets."""
    from ..functions.columns import age_days, lastmod

    e = found.where("entry_kind = 'url'")
    urls, crawled = e.select("url").distinct(), pages.select(F.col("normalized_url").alias("url")).distinct()
    stamp = lastmod(F.col("lastmod"))
    facts = e.agg(
        F.countDistinct("url").alias("sitemap_urls"),
        F.count_if(stamp.isNull()).alias("missing_lastmod"),
        F.count_if(age_days(stamp, F.lit(as_of).cast("timestamp")) >= stale_days).alias("stale_lastmod"),
        F.coalesce(F.sum(F.size("images")), F.lit(0)).alias("sitemap_images"),
        F.coalesce(F.sum(F.size("videos")), F.lit(0)).alias("sitemap_videos"),
    )
    counts = [facts, crawled.agg(F.count("*").alias("discovered_urls")), urls.join(crawled, "url", "left_anti").agg(F.count("*").alias("not_crawled")), crawled.join(urls, "url", "left_anti").agg(F.count("*").alias("not_in_sitemap"))]
    # Each of these is one row.
    out = counts[0].withColumn("__k", F.lit(0))
    for c in counts[1:]:
        out = out.join(c.withColumn("__k", F.lit(0)), "__k")
    return out.drop("__k")


# Buckets of pages by the first segment of their path.
BUCKETS = {"home": ["home", ""], "service": ["service", "services"], "article": ["blog", "news", "insights", "article", "articles"], "commercial": ["product", "products", "location", "locations"]}


def bucket(url: Column) -> Column:
    from ..functions.columns import first_segment

    segment, out = first_segment(url), None
    for name, segments in BUCKETS.items():
        out = F.when(segment.isin(segments), name) if out is None else out.when(segment.isin(segments), name)
    return out.otherwise("other")


def hreflang_pairs(rows: DataFrame, url: str, links: str = "hreflang") -> DataFrame:
    """Distinct (url, lang, href) of language links that have both."""
    exploded = rows.select(F.col(url).alias("url"), F.explode(links).alias("l")).select("url", F.lower(F.trim("l.lang")).alias("lang"), F.trim("l.href").alias("href"))
    return exploded.where("lang <> '' AND href <> ''").distinct()


def hreflang_mismatches(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, lang, href) that sitemaps give and pages don't."""
    return hreflang_pairs(entries.where("entry_kind = 'url'"), "url").subtract(hreflang_pairs(pages, "normalized_url"))


def extension_coverage(entries: DataFrame) -> DataFrame:
    """bucket, extension, n: url entries with images or videos by kind of page."""
    rows = entries.where("entry_kind = 'url'").select(bucket(F.col("url")).alias("bucket"), F.explode(F.filter(F.array(F.when(F.size("images") > 0, F.lit("image")), F.when(F.size("videos") > 0, F.lit("video"))), lambda x: x.isNotNull())).alias("extension"))
    return rows.groupBy("bucket", "extension").agg(F.count("*").alias("n"))


def measures(entries: DataFrame, pages: DataFrame, domain: str, as_of: str) -> DataFrame:
    """One row: `deltas` over the pages that work, on-page assets, language pairs on either side and those only sitemaps give, and entries outside the site."""
    from ..functions.columns import host, in_scope

    live = pages.where(F.col("status_code").between(200, 399))
    urls = entries.where("entry_kind = 'url'")
    parts = [
        deltas(entries, live, as_of),
        live.agg(F.coalesce(F.sum("image_count"), F.lit(0)).alias("page_images"), F.coalesce(F.sum(F.size("videos")), F.lit(0)).alias("page_videos")),
        urls.agg(F.count_if(~in_scope(host(F.col("url")), domain)).alias("scope_violations")),
        hreflang_pairs(urls, "url").agg(F.count("*").alias("sitemap_hreflang_pairs")),
        hreflang_pairs(live, "normalized_url").agg(F.count("*").alias("page_hreflang_pairs")),
        hreflang_mismatches(entries, live).agg(F.count("*").alias("hreflang_mismatches")),
    ]
    # Each of these is one row.
    out = parts[0].withColumn("__k", F.lit(0))
    for c in parts[1:]:
        out = out.join(c.withColumn("__k", F.lit(0)), "__k")
    return out.drop("__k")
