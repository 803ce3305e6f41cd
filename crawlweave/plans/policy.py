"""Fixed tables of the rule engine and the scores, and the page facts that both derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, first_segment, safe_int

# Fixed values.
IMPORTANCE = {"homepage": 1.40, "service": 1.30, "location": 1.30, "product": 1.30, "contact": 1.25, "about": 1.10, "industry": 1.05, "article": 0.85, "blog": 0.85, "category": 0.80, "tag": 0.75, "archive": 0.75, "search": 0.70, "utility": 0.70, "other": 1.00, "global": 1.00}
THIN = {"homepage": 220, "service": 220, "location": 220, "product": 220, "article": 170, "blog": 170, "industry": 170, "contact": 80, "about": 80, "tag": 70, "category": 70, "archive": 70, "utility": 70, "search": 70}
THIN_DEFAULT = 140
BANDS = {"homepage": (1, 3, 6), "service": (1, 3, 5), "location": (1, 3, 5), "product": (1, 3, 5), "article": (0, 2, 4), "blog": (0, 2, 4), "tag": (0, 2, 3), "category": (0, 2, 3), "archive": (0, 2, 3), "utility": (0, 2, 3), "search": (0, 2, 3), "contact": (0, 2, 3), "about": (0, 2, 3)}
BAND_DEFAULT = (1, 2, 4)
MONEY = ["homepage", "service", "location", "product"]
UTILITY = ["tag", "category", "archive", "utility", "search", "contact", "about", "legal", "privacy", "terms"]
SEGMENT_TYPES = {"service": ["service", "services"], "product": ["product", "products", "portfolio", "fasteners"], "location": ["location", "locations"], "article": ["blog", "news", "article", "articles"]}
# Template groups by page type and first segment of the path.
TEMPLATES = [
    ("service-template", ["service"], ["service", "services"]),
    ("commercial-template", ["product", "location"], ["product", "products", "location", "locations", "portfolio", "fasteners"]),
    ("content-template", ["article", "blog"], ["blog", "news", "article", "articles"]),
    ("utility-template", ["tag", "category", "archive", "utility", "search"], []),
]
SAME_TYPES = ["tag", "category", "archive", "search", "utility"]

#: Columns of a page that rules and scores read, with the value that stands for a missing one.
PAGE_DEFAULTS = {
    "normalized_url": "", "final_url": "", "content_type": "", "fetch_error": "", "page_type": "", "title": "", "effective_title": "", "meta_description": "", "effective_meta_description": "", "h1": "", "canonical_url": "", "effective_canonical": "",
    "raw_canonical": "", "rendered_canonical": "", "canonical_resolution": "", "canonical_cluster_key": "", "canonical_cluster_role": "", "shell_state": "", "effective_content_hash": "", "content_hash": "", "content_hash_source": "", "meta_robots": "", "rendered_meta_robots": "",
    "hreflang_links_json": "[]", "raw_hreflang_links_json": "[]", "redirect_chain_json": "[]", "schema_validation_json": "{}", "schema_types_json": "[]", "max_snippet_directive": "", "max_image_preview_directive": "", "max_video_preview_directive": "", "framework_guess": "", "rel_next_url": "", "rel_prev_url": "",
    "canonical_count": 0, "word_count": 0, "raw_word_count": 0, "status_code": 0, "robots_blocked_flag": 0, "in_sitemap_flag": 0, "is_noindex": 0, "used_render": 0, "render_checked": 0, "render_gap_score": 0, "likely_js_shell": 0, "shell_score": 0, "orphan_risk_flag": 0, "nav_linked_flag": 0, "inlinks": 0, "community_id": 0, "bridge_flag": 0,
    "schema_parse_error_count": 0, "data_nosnippet_count": 0, "rendered_data_nosnippet_count": 0, "has_nosnippet_directive": 0, "has_contact_signal": 0, "has_location_signal": 0, "has_local_schema": 0, "has_map": 0, "internal_pagerank": 0.0, "betweenness": 0.0, "closeness": 0.0,
    "governance_openai_allowed": 1, "governance_google_extended_allowed": 1, "governance_gptbot_allowed": 1, "governance_oai_adsbot_allowed": 1,
}
#: Columns that tell missing from zero.
PAGE_NULLABLE = {"crawl_depth": "int", "effective_h1_count": "int", "h1_count": "int", "effective_text_len": "int", "effective_internal_links_out": "int", "outlinks": "int", "internal_links_out": "int", "effective_canonical_count": "int"}


def completed(pages: DataFrame) -> DataFrame:
    """pages with every column that is read: absent columns and nulls get their defaults."""
    out = {c: F.coalesce(F.col(c).cast({str: "string", int: "int", float: "double"}[type(v)]), F.lit(v)) if c in pages.columns else F.lit(v) for c, v in PAGE_DEFAULTS.items()}
    out |= {c: F.col(c).cast(k) if c in pages.columns else F.lit(None).cast(k) for c, k in PAGE_NULLABLE.items()}
    return pages.withColumns(out)


def looked_up(table: dict[str, object], key: Column, default: object) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def page_type(infer: bool) -> Column:
    """The page's own type in lower case; else, where inferred, one from the URL's first segment; else other."""
    own = F.nullif(F.lower(F.trim("page_type")), F.lit(""))
    if not infer:
        return F.coalesce(own, F.lit("other"))
    segment = first_segment(F.coalesce(F.nullif(F.col("normalized_url"), F.lit("")), F.col("final_url")))
    guess = F.when(segment == "", "homepage")
    for kind, names in SEGMENT_TYPES.items():
        guess = guess.when(segment.isin(names), kind)
    return F.coalesce(own, guess.when(segment.isin(SAME_TYPES), segment).otherwise("other"))


def template_cluster(kind: Column | None = None, url: Column | None = None) -> Column:
    """The template group that findings about a page are counted by; global-template without a page."""
    kind, segment = page_type(False) if kind is None else kind, first_segment(F.col("normalized_url") if url is None else url)
    out = F.when((kind == "homepage") | (segment == ""), "home-template")
    for name, kinds, segments in TEMPLATES:
        out = out.when(kind.isin(kinds) | segment.isin(segments), name)
    return out.otherwise("other-template")


def importance(kind: Column) -> Column:
    return clamp(looked_up(IMPORTANCE, kind, 1.0), 0.5, 1.5)


def thin_threshold(kind: Column) -> Column:
    return looked_up(THIN, kind, THIN_DEFAULT)


def link_band(kind: Column, outlinks: Column) -> Column:
    """severe, weak, okay or strong by the number of links out and the type's bounds."""
    n = F.greatest(F.lit(0), outlinks)
    bound = lambda i: looked_up({k: v[i] for k, v in BANDS.items()}, kind, BAND_DEFAULT[i])
    return F.when(n <= bound(0), "severe").when(n <= bound(1), "weak").when(n <= bound(2), "okay").otherwise("strong")


def is_html() -> Column:
    return F.lower("content_type").contains("html") | (F.col("title") != "") | (F.col("h1") != "") | (F.col("word_count") != 0)


def is_system(url: Column) -> Column:
    """robots.txt, sitemaps and other XML."""
    name = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1))
    return name.isin("robots.txt", "sitemap.xml", "sitemap.xml.gz", "sitemap_index.xml") | name.endswith(".xml")


def actionable() -> Column:
    return is_html() & F.col("status_code").between(200, 399) & ~is_system(F.col("normalized_url"))


def text_length() -> Column:
    return F.coalesce(F.col("effective_text_len"), F.col("word_count"), F.lit(0))


def links_out() -> Column:
    return F.coalesce("effective_internal_links_out", "outlinks", "internal_links_out", F.lit(0))


def h1_missing() -> Column:
    return F.coalesce(F.col("effective_h1_count"), (F.col("h1") != "").cast("int")) == 0


def title_missing() -> Column:
    return (F.col("effective_title") == "") & (F.col("title") == "")


def canonical() -> Column:
    return F.coalesce(F.nullif(F.trim("effective_canonical"), F.lit("")), F.nullif(F.trim("canonical_url"), F.lit("")), F.lit(""))


def canonical_mismatch() -> Column:
    final = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("normalized_url"))
    bare = lambda c: F.regexp_replace(c, r"/$", "")
    return (canonical() != "") & (bare(canonical()) != bare(final))


def canonicals() -> Column:
    return F.coalesce(F.col("effective_canonical_count"), F.col("canonical_count"))


def restriction() -> Column:
    """How much preview directives restrict snippets, from 0."""
    snippet, video, image, marked = safe_int(F.col("max_snippet_directive")), safe_int(F.col("max_video_preview_directive")), F.lower(F.trim("max_image_preview_directive")), F.col("data_nosnippet_count")
    return (
        F.when(F.col("has_nosnippet_directive") == 1, 4).otherwise(0)
        + F.when(snippet == 0, 3).when(snippet.between(1, 50), 2).otherwise(0)
        + F.when(image == "none", 3).when(image == "standard", 1).otherwise(0)
        + F.when(video.between(0, 5), 1).otherwise(0)
        + F.when(marked >= 10, 2).when(marked >= 4, 1).otherwise(0)
    )


def snippet_eligible() -> Column:
    blocked = (F.col("is_noindex") == 1) | (F.col("has_nosnippet_directive") == 1) | (F.lower(F.trim("max_image_preview_directive")) == "none")
    return ~(blocked | F.coalesce(safe_int(F.col("max_snippet_directive")) == 0, F.lit(False)) | F.coalesce(safe_int(F.col("max_video_preview_directive")) == 0, F.lit(False)))
