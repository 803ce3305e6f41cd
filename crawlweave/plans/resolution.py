"""Facts of a page where raw and rendered versions meet: effective values with their source, shells, render gaps, governance, index states, search metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, normalize_url

# Crawlers whose access is recorded; ids that empty mount points have.
BOTS = ["googlebot", "bingbot", "oai-searchbot", "google-extended", "gptbot", "oai-adsbot", "chatgpt-user"]
MOUNTS = "root|app|__next|__nuxt"


def effective(raw: Column, rendered: Column, prefers_rendered: Column, otherwise: str = "raw") -> Column:
    """struct(value, source): the rendered value where the crawl's persona prefers it and it isn't empty, else the raw one.

    otherwise: what the source is called where rendering is preferred but gave nothing: raw for titles and descriptions,
    raw_fallback for language links and content hashes.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    use = F.coalesce(prefers_rendered.cast("boolean"), F.lit(False))
    takes = use & (text(rendered) != "")
    source = F.when(takes, "rendered").when(use, otherwise).otherwise("raw")
    return F.struct(F.when(takes, text(rendered)).otherwise(text(raw)).alias("value"), source.alias("source"))


def resolve_canonical(raw: Column, rendered: Column, rendered_url: Column, prefers_rendered: Column) -> Column:
    """struct(value, outcome, conflict, unresolved). raw: the raw canonical; rendered: array of canonicals after rendering; all normalised.

    One rendered canonical counts; of several the only one that is the page itself; else the raw one if it is among them.
    Without rendered ones the raw one counts.
    """
    raw, every = F.trim(F.coalesce(raw, F.lit(""))), F.array_distinct(F.coalesce(rendered, F.array().cast("array<string>")))
    use = F.coalesce(prefers_rendered.cast("boolean"), F.lit(False)) & (F.size(every) > 0)
    alone, itself = F.size(every) == 1, F.array_contains(every, rendered_url)
    picked = F.when(alone, F.get(every, 0)).when(itself, rendered_url)
    agrees = (raw != "") & F.array_contains(every, raw)
    outcome = (
        F.when(use & alone, "resolver:rendered_single")
        .when(use & itself, "resolver:rendered_self_match")
        .when(use & agrees, "resolver:raw_agreement_fallback")
        .when(use, "resolver:rendered_multiple_unresolved")
        .when(raw != "", "raw")
        .otherwise("unresolved")
    )
    value = F.when(use, F.coalesce(picked, F.when(agrees, raw), F.lit(""))).otherwise(raw)
    conflict = use & (raw != "") & F.when(picked.isNotNull(), raw != picked).otherwise(~agrees)
    return F.struct(value.alias("value"), outcome.alias("outcome"), conflict.cast("int").alias("conflict"), (outcome == "resolver:rendered_multiple_unresolved").cast("int").alias("unresolved"))


def shell_state(state: Column, score: Column, was_rendered: Column, raw_words: Column, rendered_words: Column, raw_links: Column, rendered_links: Column, changed: Column) -> Column:
    """The shell state once rendering is known: a possible shell is confirmed if rendering adds text or links or changes title or description."""
    known = ["raw_shell_unlikely", "raw_shell_possible", "raw_shell_confirmed_after_render"]
    before = F.when(F.trim(F.coalesce(state, F.lit(""))).isin(known), F.trim(state)).when(F.coalesce(score, F.lit(0)) >= 30, known[1]).otherwise(known[0])
    grows = (rendered_words >= F.greatest(F.lit(180), raw_words * 2)) | (rendered_links >= F.greatest(F.lit(4), raw_links + 3)) | changed
    return F.when(~was_rendered | (before == known[0]), before).when(F.coalesce(grows, F.lit(False)), known[2]).otherwise(known[1])


def shell(html: Column, words: Column, h1_count: Column, anchors: Column, title: Column, canonical: Column) -> Column:
    """struct(score 0..100, likely, state): signs that a page is an empty shell that scripts fill."""
    low = F.lower(F.coalesce(html, F.lit("")))
    scripts = F.regexp_count(low, F.lit(r"<script\b"))
    mount = low.rlike(rf"""<div[^>]+id=['"]({MOUNTS})['"][^>]*>\s*</div>""")
    marks = sum((low.contains(f'id="{m}"').cast("int") for m in MOUNTS.split("|")), F.lit(0))
    score = (
        F.when(words < 60, 30).when(words < 120, 15).otherwise(0)
        + F.when(h1_count == 0, 15).otherwise(0)
        + F.when(anchors <= 1, 15).otherwise(0)
        + F.least(F.lit(25), marks * 10)
        + F.when(scripts >= 6, 15).otherwise(0)
        + F.when(mount & (scripts >= 3), 18).otherwise(0)
        + F.when(low.rlike(r"<noscript[^>]*>[^<]*(enable|requires?)\s+javascript"), 18).otherwise(0)
        + F.when(F.regexp_count(low, F.lit(r"""<script[^>]+type=['"]module['"]""")) >= 2, 8).otherwise(0)
        + F.when(F.trim(title) == "", 8).otherwise(0)
        + F.when(F.trim(canonical) == "", 5).otherwise(0)
    )
    return F.struct(F.least(F.lit(100), score).alias("score"), (score >= 45).alias("likely"), F.when(score >= 30, "raw_shell_possible").otherwise("raw_shell_unlikely").alias("state"))


# Points of the render gap and of render escalation, and types of pages that are worth rendering.
GAP_POINTS = {"raw thin but rendered rich": 45, "title mismatch": 20, "canonical mismatch": 15, "h1 mismatch": 15, "rendered links much richer": 15}
GAP_NONE, GAP_UNKNOWN = "raw and rendered signals are aligned", "render not available"
HIGH_VALUE = ["homepage", "service", "contact", "location"]


def _scored(checks: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """Points of all conditions that hold, 100 at most, and their names in order."""
    held = [(F.coalesce(c, F.lit(False)), n, name) for c, n, name in checks]
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, _, name in held]), lambda x: x.isNotNull())
    return F.least(F.lit(100), sum((F.when(c, n).otherwise(0) for c, n, _ in held), F.lit(0))), reasons


def render_gap(raw: dict[str, Column], rendered: dict[str, Column], was_rendered: Column) -> Column:
    """struct(score 0..100, reasons): how much rendering changes. Facts by name: words, title, canonical, h1_count, links."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    number = lambda c: F.coalesce(c, F.lit(0))
    holds = [
        (number(raw["words"]) < 100) & (number(rendered["words"]) > 200),
        text(raw["title"]) != text(rendered["title"]),
        (text(raw["canonical"]) != "") & (text(raw["canonical"]) != text(rendered["canonical"])),
        number(raw["h1_count"]) != number(rendered["h1_count"]),
        number(rendered["links"]) > number(raw["links"]) * 2 + 10,
    ]
    score, reasons = _scored([(c, n, name) for c, (name, n) in zip(holds, GAP_POINTS.items(), strict=True)])
    said = F.when(F.size(reasons) == 0, GAP_NONE).otherwise(F.array_join(reasons, "; "))
    return F.struct(F.when(was_rendered, score).otherwise(0).alias("score"), F.when(was_rendered, said).otherwise(GAP_UNKNOWN).alias("reasons"))


def render_escalation() -> Column:
    """struct(score 0..100, reasons): how much a page needs rendering, from its raw facts as columns (`policy.completed`)."""
    c = F.col
    kind = F.lower("page_type")
    html = F.lower("content_type").contains("html") | (c("title") != "") | (c("h1") != "") | (c("word_count") > 0)
    works = c("status_code").between(200, 399) & html
    shell = (c("likely_js_shell") != 0) | (c("shell_score") >= 45) | F.trim("shell_state").isin("raw_shell_possible", "raw_shell_confirmed_after_render")
    checks = [
        (shell, 40, "shell_like_raw_html"),
        (~shell & (c("shell_score") >= 30), 20, "shell_signals_present"),
        (F.trim("framework_guess") != "", 20, "framework_detected"),
        (c("word_count") < 120, 15, "low_raw_text"),
        (F.coalesce(c("internal_links_out"), F.lit(0)) <= 1, 12, "sparse_raw_links"),
        (F.trim("title") == "", 8, "missing_title"),
        (F.coalesce(F.nullif(c("h1_count"), F.lit(0)), (c("h1") != "").cast("int")) == 0, 8, "missing_h1"),
        (F.trim("canonical_url") == "", 6, "missing_canonical"),
        (kind.isin(HIGH_VALUE), 10, "high_value_page"),
    ]
    score, reasons = _scored(checks)
    return F.struct(F.when(works, score).otherwise(0).alias("score"), F.when(works, reasons).otherwise(F.array(F.lit("non_actionable"))).alias("reasons"))


#: Crawlers of the governance matrix, and the flag of a page that says whether each may crawl it.
GOVERNED = {"googlebot": "governance_googlebot_allowed", "bingbot": "governance_bingbot_allowed", "oai_searchbot": "governance_openai_allowed", "google_extended": "governance_google_extended_allowed", "gptbot": "governance_gptbot_allowed", "oai_adsbot": "governance_oai_adsbot_allowed", "chatgpt_user": "governance_chatgpt_user_allowed"}
#: Types of pages whose previews are restricted on purpose unless they are important, and those where it always matters.
INTENTIONAL_PREVIEW, IMPORTANT_PREVIEW = ["utility", "search", "legal", "privacy", "terms"], ["homepage", "service", "location", "product", "article"]


def governance(pages: DataFrame) -> DataFrame:
    """Completed pages with blocked_bots (names), preview_score, preview_restricted, over_restrictive, bing_restrictive and visibility_mismatch."""
    from . import policy as P

    p = P.completed(pages)
    open_ = {bot: F.coalesce(F.col(flag).cast("int"), F.lit(1)) if flag in p.columns else F.lit(1) for bot, flag in GOVERNED.items()}
    blocked = F.filter(F.array(*[F.when(flag != 1, F.lit(bot)) for bot, flag in open_.items()]), lambda x: x.isNotNull())
    kind = P.page_type(True)
    weight, score, noindex = F.round(P.importance(kind), 2), P.restriction(), F.col("is_noindex") == 1
    judged = P.snippet_eligible() & ~(noindex | (kind.isin(INTENTIONAL_PREVIEW) & (weight < 1.10)))
    matters = (score >= 4) & ((weight >= 1.0) | kind.isin(IMPORTANT_PREVIEW))
    later = F.coalesce(F.col("rendered_is_noindex").cast("int"), F.col("is_noindex")) if "rendered_is_noindex" in p.columns else F.col("is_noindex")
    return p.withColumns({
        "blocked_bots": blocked, "preview_score": score, "over_restrictive": judged & (score >= 5), "bing_restrictive": judged & matters,
        "preview_restricted": judged & ((score >= 5) | matters), "visibility_mismatch": (F.col("is_noindex") != later) | (F.col("meta_robots") != F.col("rendered_meta_robots")),
    })


def governance_summary(pages: DataFrame) -> DataFrame:
    """One row: pages, pages closed to each crawler, and counts of restricted previews and mismatches."""
    g = governance(pages)
    each = [F.count_if(F.array_contains("blocked_bots", bot)).alias(f"{bot}_blocked") for bot in GOVERNED]
    return g.agg(F.count("*").alias("total"), *each, F.count_if("preview_restricted").alias("preview_restricted_pages"), F.count_if(F.col("preview_score") >= 4).alias("preview_restricted_diagnostic_pages"), F.count_if("over_restrictive").alias("over_restrictive_pages"), F.count_if("bing_restrictive").alias("bing_restrictive_pages"), F.count_if("visibility_mismatch").alias("raw_render_mismatch_pages"))


def governance_counts(pages: DataFrame, flags: Sequence[str], url: str = "normalized_url", samples: int = 10) -> DataFrame:
    """bot, blocked, sample: pages that are closed to each crawler, with the first few of them."""
    rows = pages.select(url, F.explode(F.array(*[F.struct(F.lit(f).alias("bot"), F.coalesce(F.col(f), F.lit(1)).alias("open")) for f in flags])).alias("b")).where("b.open = 0").select(F.col("b.bot").alias("bot"), url)
    from ..operators.relational import within_budget

    few = within_budget(rows, ["bot"], [F.col(url)], samples).groupBy("bot").agg(F.array_sort(F.collect_list(url)).alias("sample"))
    return rows.groupBy("bot").agg(F.count("*").alias("blocked")).join(few, "bot")


def index_state(verdict: Column, coverage: Column, indexing: Column, robots: Column, fetch: Column) -> Column:
    """indexed, not_indexed or unknown of an inspection: its coverage decides where it says anything, then indexing, fetch and robots states, then the verdict."""
    coverage, indexing, robots, fetch, verdict = (F.lower(F.coalesce(c, F.lit(""))) for c in (coverage, indexing, robots, fetch, verdict))
    against = coverage.contains("not indexed") | coverage.contains("excluded") | coverage.contains("blocked")
    refused = indexing.isin("indexing_not_allowed", "blocked_by_robots_txt") | fetch.contains("blocked") | robots.contains("blocked")
    return F.when(against, "not_indexed").when(coverage.contains("indexed"), "indexed").when(refused, "not_indexed").when((verdict == "pass") & (indexing == "indexing_allowed"), "indexed").otherwise("unknown")


def with_index_state(pages: DataFrame, states: DataFrame) -> DataFrame:
    """Pages with their last known state; unknown where there is none."""
    from ..operators.relational import latest_per_key

    last = latest_per_key(states.select("url", "state", "seq"), ["url"], ["seq"]).select(F.col("url").alias("normalized_url"), F.col("state").alias("index_state"))
    return pages.join(last, "normalized_url", "left").withColumn("index_state", F.coalesce("index_state", F.lit("unknown")))


def with_search_metrics(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages that search analytics know, with clicks and impressions summed over spellings of their URL."""
    sums = rows.groupBy(normalize_url("page").alias("normalized_url")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return pages.join(sums, "normalized_url")


def search_summary(rows: DataFrame) -> DataFrame:
    """clicks, impressions, ctr as a ratio of sums, unweighted mean position."""
    sums = rows.agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("position").alias("position"))
    return sums.select("clicks", "impressions", F.bround(F.coalesce(F.col("clicks") / F.nullif(F.col("impressions"), F.lit(0)), F.lit(0.0)), 6).alias("ctr"), F.bround("position", 4).alias("position"))


# What a message holds, by the family of the failure; the first family that fits.
ERROR_FAMILIES = {"runtime": ["runtimeerror", "worker failure", "exception"], "timeout": ["timeout", "timed out"], "quota": ["429", "quota", "rate limit"], "no_fcp": ["no_data", "missing performance category score", "no crux record"], "not_attempted_policy": ["missing key"]}
RENDER_FAMILIES = {"timeout": ["timeout"], "environment": ["playwright import failed", "browser unavailable"], "navigation": ["navigation"], "render_failure": ["render failure"]}


def _family(message: Column, families: dict[str, list[str]], other: str) -> Column:
    text, out = F.lower(F.trim(F.coalesce(message, F.lit("")))), None
    for name, parts in families.items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | text.contains(part)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def error_family(message: Column) -> Column:
    """What kind of failure a provider's message tells of."""
    return _family(message, ERROR_FAMILIES, "http")


def render_error_family(message: Column) -> Column:
    """What kind of failure a renderer's message tells of; empty without a message."""
    return F.when(F.trim(F.coalesce(message, F.lit(""))) == "", "").otherwise(_family(message, RENDER_FAMILIES, "runtime"))


def redacted(message: Column, secrets: Sequence[str]) -> Column:
    """A message without secrets, whole or as a `key=` parameter."""
    out = F.regexp_replace(message, r"(?i)(key|token|secret)=[^&\s]+", "$1=***")
    for s in secrets:
        if s:
            out = F.replace(out, F.lit(s), F.lit("***"))
    return out


# Signs of platforms (where, any of these texts, points), in the order in which they are tried; points that
# make a detection, and the most. header:x is a response header, host the host's name.
PLATFORM_SIGNS = {
    "shopify": [("html", ["cdn.shopify.com"], 45), ("html", ["shopify-section", "shopify-features"], 30), ("host", ["myshopify.com"], 35), ("header:server", ["shopify"], 15)],
    "wix": [("host", ["wix"], 20), ("html", ["static.wixstatic.com"], 45), ("html", ["wix-code", "wix-data"], 20), ("html", ["_wixcidx"], 25)],
    "wordpress": [("html", ["wp-content", "wp-includes"], 40), ("html", ["wp-json"], 25), ("html|header:x-generator", ["wordpress"], 25), ("host^", ["wp."], 5)],
    "nextjs": [("html", ["__next_data__"], 45), ("html", ["_next/static", "next-route-announcer"], 30), ("header:x-powered-by", ["next.js"], 35), ("header:server|host$", ["vercel", ".vercel.app"], 15)],
    "cloudflare": [("header:server", ["cloudflare"], 55), ("header?cf-ray", [], 35), ("header?cf-cache-status", [], 10)],
}
PLATFORM_LEAST, PLATFORM_MOST = 35, 99


def platform(html: Column, hosts: Column, headers: Column) -> Column:
    """struct(platform, confidence) of the platform that a page shows most of, the first of equals; null below PLATFORM_LEAST. headers: a map with lower-case names."""
    low, hosts = F.lower(F.coalesce(html, F.lit(""))), F.lower(F.coalesce(hosts, F.lit("")))
    header = lambda name: F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))

    def shows(where: str, parts: list[str]) -> Column:
        if where.startswith("header?"):
            return F.trim(header(where[7:])) != ""
        found = F.lit(False)
        for place, part in [(w, x) for w in where.split("|") for x in parts]:
            if place == "html":
                found = found | low.contains(part)
            elif place == "host":
                found = found | hosts.contains(part)
            elif place == "host^":
                found = found | hosts.startswith(part)
            elif place == "host$":
                found = found | (hosts.endswith(part) if part.startswith(".") else F.lit(False))
            else:
                found = found | (F.lower(header(place[7:])).contains(part) if not part.startswith(".") else F.lit(False))
        return found

    out = F.lit(None).cast("struct<platform:string,confidence:int>")
    for name, signs in reversed(PLATFORM_SIGNS.items()):
        points = F.least(F.lit(PLATFORM_MOST), sum((F.when(shows(where, parts), n).otherwise(0) for where, parts, n in signs), F.lit(0)))
        better = (points >= PLATFORM_LEAST) & (points >= F.coalesce(out["confidence"], F.lit(0)))
        out = F.when(better, F.struct(F.lit(name).alias("platform"), points.cast("int").alias("confidence"))).otherwise(out)
    return out


# Points that citation eligibility loses, and those that an answer-like page and valid markup add.
CITATION_LOSS = {"noindex": 70, "googlebot_blocked": 24, "bingbot_blocked": 24, "oai_searchbot_blocked": 24, "nosnippet": 30, "max_snippet_non_positive": 16, "weak_internal_prominence": 12, "schema_validation_weak": 10}


def citation(pages: DataFrame) -> DataFrame:
    """Adds citation_score (0..100) and citation_reasons to the pages of `governance`."""
    c = F.col
    number = lambda name: F.coalesce(c(name).cast("int"), F.lit(0)) if name in pages.columns else F.lit(0)
    valid = number("schema_validation_score")
    title = F.coalesce(F.nullif(F.trim("effective_title"), F.lit("")), F.trim("title")) != ""
    words = F.coalesce(c("effective_text_len"), c("word_count"), F.lit(0))
    headings = F.coalesce(c("effective_h1_count"), c("h1_count"), F.lit(0)) > 0
    # In hundredths, so that sums are exact.
    answer = F.when(title, 35).otherwise(0) + F.when(headings, 25).otherwise(0) + F.when(words >= 220, 40).when(words >= 120, 20).otherwise(0)
    loses = {
        "noindex": c("is_noindex") == 1,
        **{f"{bot}_blocked": F.array_contains("blocked_bots", bot) for bot in ("googlebot", "bingbot", "oai_searchbot")},
        "nosnippet": c("has_nosnippet_directive") == 1,
        "max_snippet_non_positive": F.lower(F.trim("max_snippet_directive")).isin("0", "-1"),
        "weak_internal_prominence": F.coalesce(c("effective_internal_links_out"), c("internal_links_out"), F.lit(0)) < 2,
        "schema_validation_weak": (valid > 0) & (valid < 70),
    }
    loss = sum((F.when(loses[k], n).otherwise(0) for k, n in CITATION_LOSS.items()), F.lit(0))
    gain = F.when(valid >= 70, 5).otherwise(0) + F.bround(answer / 10.0, 0).cast("int")
    reasons = [F.when(held, F.lit(k)) for k, held in loses.items()] + [F.when(answer >= 70, F.lit("answer_like_visible_content"))]
    return pages.withColumns({"citation_score": clamp(F.lit(100) - loss + gain).cast("int"), "citation_reasons": F.filter(F.array(*reasons), lambda x: x.isNotNull())})


# Types of pages whose equal titles and descriptions are no fault.
DUPLICATE_EXEMPT = ["utility", "search", "legal", "privacy", "terms", "tag", "category", "archive"]


def duplicate_metadata_candidate(value: Column, page_type: Column) -> Column:
    """Whether a title or description counts when duplicates are looked for: eight characters and two words at least, on a page of its own."""
    text = F.trim(F.coalesce(value, F.lit("")))
    exempt = F.lower(F.trim(F.coalesce(page_type, F.lit("")))).isin(DUPLICATE_EXEMPT)
    return ~exempt & (F.length(text) >= 8) & (F.regexp_count(text, F.lit(r"\S+")) >= 2)


def schema_audit(pages: DataFrame, column: str = "schema_validation_json") -> DataFrame:
    """One row: pages with valid markup (unless it says otherwise), with eligible features, deprecated markup and mismatches with what is shown."""
    v = F.from_json(F.coalesce(F.col(column), F.lit("{}")), "struct<syntax_valid:boolean,eligible_features:array<string>,deprecated_features:array<string>,visible_content_mismatches:array<string>>")
    some = lambda k: F.count_if(F.coalesce(F.size(v[k]), F.lit(0)) > 0)
    return pages.agg(F.count_if(F.coalesce(v["syntax_valid"], F.lit(True))).alias("syntax_valid_pages"), some("eligible_features").alias("eligible_feature_pages"), some("deprecated_features").alias("deprecated_markup_pages"), some("visible_content_mismatches").alias("visible_mismatch_pages"))


def engine_means(scores: DataFrame, key: str, base: str | None = None) -> DataFrame:
    """key, engine_mean: the mean over engines of each engine's rounded mean feature score (0..100); with base, a column of the key's own score, also their rounded mean as blended."""
    whole = lambda c: F.bround(c, 0).cast("int")
    per = scores.groupBy(key, F.lower(F.coalesce(F.nullif(F.trim("engine"), F.lit("")), F.lit("unknown"))).alias("engine")).agg(whole(F.avg(clamp(F.col("score")))).alias("m"), *([F.max(base).alias("b")] if base else []))
    out = per.groupBy(key).agg(whole(F.avg("m")).alias("engine_mean"), *([F.max("b").alias("b")] if base else []))
    return out.select(key, "engine_mean", whole((F.col("b") + F.col("engine_mean")) / 2.0).alias("blended")) if base else out


def schema_features(pages: DataFrame, rules: DataFrame, types: str = "schema_types") -> DataFrame:
    """url, engine, feature, eligible: markup types against a registry (schema_type, engine, feature, required: array); rules are few and broadcast after a count."""
    from ..operators.relational import small

    exploded = pages.select("normalized_url", F.col("properties"), F.explode(types).alias("schema_type"))
    joined = exploded.join(small(rules), "schema_type")
    missing = F.array_sort(F.array_except("required", F.coalesce("properties", F.array().cast("array<string>"))))
    return joined.select(F.col("normalized_url").alias("url"), "engine", "feature", missing.alias("missing"), (F.size(missing) == 0).alias("eligible"))
