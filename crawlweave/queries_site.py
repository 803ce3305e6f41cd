"""Queries over a site that is made up from the driver's tables: pages whose facts follow from the numbers of documents.

SITE is SQL that both engines run; it is input, not operator. Each query applies an operator to it, and its oracle says in
SQL what the operator is to give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import columns as C
from .queries import query, r6, t

SITE = """SELECT doc_id AS page_id, 'r1' AS run_id, n_chars,
  'https://www.e.com/' || CASE doc_id % 8 WHEN 0 THEN '?id=' WHEN 1 THEN 'service/' WHEN 2 THEN 'products/' WHEN 3 THEN 'blog/' WHEN 4 THEN 'tag/' WHEN 5 THEN 'quote/' WHEN 6 THEN 'location/' ELSE 'x/' END || CAST(doc_id AS STRING) AS normalized_url,
  CASE doc_id % 9 WHEN 0 THEN 'homepage' WHEN 1 THEN 'service' WHEN 2 THEN 'article' WHEN 3 THEN 'other' WHEN 4 THEN 'location' WHEN 5 THEN '' WHEN 6 THEN 'utility' WHEN 7 THEN 'industry' ELSE 'contact' END AS page_type,
  CASE doc_id % 5 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'text/html' END AS content_type,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Title ' || CAST(doc_id % 3 AS STRING) END AS title,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'Heading' END AS h1, CAST(CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END AS INT) AS h1_count,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'About it' END AS meta_description,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'https://www.e.com/c/' || CAST(doc_id % 10 AS STRING) END AS canonical_url,
  CAST(n_chars % 400 AS INT) AS word_count, CAST(doc_id % 10 AS INT) AS internal_links_out, CAST(doc_id % 6 AS INT) AS crawl_depth,
  CAST((doc_id * 37) % 101 AS INT) AS render_gap_score, CAST((doc_id * 17) % 60 AS INT) AS shell_score,
  CAST(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS INT) AS is_noindex, CAST(CASE WHEN doc_id % 12 = 0 THEN 1 ELSE 0 END AS INT) AS has_nosnippet_directive,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '-1' WHEN 3 THEN '40' ELSE '160' END AS max_snippet_directive,
  CASE (doc_id * 3) % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'standard' WHEN 2 THEN 'large' ELSE '' END AS max_image_preview_directive,
  CASE (doc_id * 5) % 11 WHEN 0 THEN '0' WHEN 1 THEN '4' ELSE '' END AS max_video_preview_directive, CAST(doc_id % 13 AS INT) AS data_nosnippet_count,
  CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS governance_googlebot_allowed, CAST(CASE WHEN doc_id % 7 = 1 THEN 0 ELSE 1 END AS INT) AS governance_bingbot_allowed,
  CAST(CASE WHEN doc_id % 5 = 1 THEN 0 ELSE 1 END AS INT) AS governance_openai_allowed, CAST((doc_id * 7) % 100 AS INT) AS schema_validation_score,
  CASE WHEN doc_id % 8 = 3 THEN 'noindex' ELSE '' END AS meta_robots, CASE WHEN doc_id % 4 = 3 THEN 'noindex' ELSE '' END AS rendered_meta_robots,
  CAST((n_chars * 3) % 700 AS INT) AS rendered_words, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Title ' || CAST(doc_id % 2 AS STRING) END AS rendered_title,
  CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'https://www.e.com/c/' || CAST(doc_id % 5 AS STRING) END AS rendered_canonical, CAST(doc_id % 2 AS INT) AS rendered_h1_count, CAST((doc_id * 5) % 40 AS INT) AS rendered_links,
  doc_id % 3 <> 1 AS was_rendered, doc_id % 2 = 0 AS prefers_rendered
FROM documents WHERE doc_id IS NOT NULL"""
#: Pages that work, in SQL.
WORKS = "(content_type LIKE '%html%' OR title <> '' OR h1 <> '' OR word_count <> 0) AND status_code BETWEEN 200 AND 399"
SEGMENT = "CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'service' WHEN 2 THEN 'products' WHEN 3 THEN 'blog' WHEN 4 THEN 'tag' WHEN 5 THEN 'quote' WHEN 6 THEN 'location' ELSE 'x' END"
#: A page's own type, else the one that its path tells.
KIND = f"CASE WHEN page_type <> '' THEN page_type WHEN {SEGMENT} = '' THEN 'homepage' WHEN {SEGMENT} = 'service' THEN 'service' WHEN {SEGMENT} = 'products' THEN 'product' WHEN {SEGMENT} = 'location' THEN 'location' WHEN {SEGMENT} = 'blog' THEN 'article' WHEN {SEGMENT} = 'tag' THEN 'tag' ELSE 'other' END"
#: Importance of the types that the site has.
WEIGHT = "CASE k WHEN 'homepage' THEN 1.4 WHEN 'service' THEN 1.3 WHEN 'location' THEN 1.3 WHEN 'product' THEN 1.3 WHEN 'contact' THEN 1.25 WHEN 'industry' THEN 1.05 WHEN 'article' THEN 0.85 WHEN 'tag' THEN 0.75 WHEN 'utility' THEN 0.7 ELSE 1.0 END"
RESTRICTION = """(CASE WHEN has_nosnippet_directive = 1 THEN 4 ELSE 0 END + CASE max_snippet_directive WHEN '0' THEN 3 WHEN '40' THEN 2 ELSE 0 END + CASE max_image_preview_directive WHEN 'none' THEN 3 WHEN 'standard' THEN 1 ELSE 0 END
  + CASE WHEN max_video_preview_directive IN ('0', '4') THEN 1 ELSE 0 END + CASE WHEN data_nosnippet_count >= 10 THEN 2 WHEN data_nosnippet_count >= 4 THEN 1 ELSE 0 END)"""
ELIGIBLE = "(is_noindex = 0 AND has_nosnippet_directive = 0 AND max_image_preview_directive <> 'none' AND max_snippet_directive <> '0' AND max_video_preview_directive <> '0')"


def site(spark, d):
    return spark.sql(SITE.replace("FROM documents", "FROM {documents}"), documents=t(spark, d, "documents"))


def points(*cases: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in cases)


def reasons(*cases: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in cases) + "], lambda x: x IS NOT NULL)"


# --- rendering ---------------------------------------------------------------------------------------------------------

_GAP = [("word_count < 100 AND rendered_words > 200", 45, "raw thin but rendered rich"), ("title <> rendered_title", 20, "title mismatch"), ("canonical_url <> '' AND canonical_url <> rendered_canonical", 15, "canonical mismatch"), ("h1_count <> rendered_h1_count", 15, "h1 mismatch"), ("rendered_links > internal_links_out * 2 + 10", 15, "rendered links much richer")]


@query(f"""SELECT page_id, CASE WHEN was_rendered THEN least(100, {points(*[g[:2] for g in _GAP])}) ELSE 0 END AS gap,
CASE WHEN NOT was_rendered THEN 'render not available' ELSE coalesce(nullif(array_to_string({reasons(*[(g[0], g[2]) for g in _GAP])}, '; '), ''), 'raw and rendered signals are aligned') END AS reasons FROM ({SITE})""")
def render_gaps(spark, d):
    from .plans.resolution import render_gap

    c = F.col
    raw = {"words": c("word_count"), "title": c("title"), "canonical": c("canonical_url"), "h1_count": c("h1_count"), "links": c("internal_links_out")}
    rendered = {"words": c("rendered_words"), "title": c("rendered_title"), "canonical": c("rendered_canonical"), "h1_count": c("rendered_h1_count"), "links": c("rendered_links")}
    return site(spark, d).select("page_id", render_gap(raw, rendered, c("was_rendered")).alias("g")).select("page_id", F.col("g.score").alias("gap"), "g.reasons")


_ESCALATION = [
    ("shell_score >= 45", 40, "shell_like_raw_html"), ("shell_score BETWEEN 30 AND 44", 20, "shell_signals_present"), ("word_count < 120", 15, "low_raw_text"), ("internal_links_out <= 1", 12, "sparse_raw_links"), ("title = ''", 8, "missing_title"),
    ("h1 = ''", 8, "missing_h1"), ("canonical_url = ''", 6, "missing_canonical"), ("page_type IN ('homepage', 'service', 'contact', 'location')", 10, "high_value_page"),
]
_ESCALATED = f"CASE WHEN {WORKS} THEN least(100, {points(*[e[:2] for e in _ESCALATION])}) ELSE 0 END"


@query(f"SELECT page_id, {_ESCALATED} AS escalation, CASE WHEN {WORKS} THEN array_to_string({reasons(*[(e[0], e[2]) for e in _ESCALATION])}, ',') ELSE 'non_actionable' END AS reasons FROM ({SITE})")
def render_escalations(spark, d):
    from .plans.policy import completed
    from .plans.resolution import render_escalation

    return completed(site(spark, d)).select("page_id", render_escalation().alias("e")).select("page_id", F.col("e.score").alias("escalation"), F.array_join("e.reasons", ",").alias("reasons"))


@query(f"""WITH p AS (SELECT *, {_ESCALATED} AS escalation FROM ({SITE}) WHERE {WORKS}),
first AS (
  SELECT normalized_url, min(place) AS place FROM (
    (SELECT normalized_url, 0 AS place FROM p ORDER BY page_type <> 'homepage', page_id LIMIT 1) UNION ALL (SELECT normalized_url, 1 FROM p WHERE page_type IN ('service', 'industry') ORDER BY internal_links_out DESC, page_id LIMIT 1)
    UNION ALL (SELECT normalized_url, 2 FROM p WHERE page_type = 'article' ORDER BY page_id LIMIT 1) UNION ALL (SELECT normalized_url, 3 FROM p WHERE word_count < 120 ORDER BY word_count, page_id LIMIT 1)) GROUP BY normalized_url),
o AS (
  SELECT *, 0 AS stage, row_number() OVER (ORDER BY escalation DESC, page_type <> 'homepage', CASE crawl_depth WHEN 0 THEN 99 ELSE crawl_depth END, internal_links_out DESC, normalized_url) AS turn FROM p WHERE escalation >= 35
  UNION ALL SELECT p.*, 1, row_number() OVER (ORDER BY coalesce(place, 4), internal_links_out DESC, word_count, page_id) FROM p LEFT JOIN first USING (normalized_url) WHERE escalation < 35)
SELECT page_id, stage, escalation FROM o ORDER BY stage, turn LIMIT 400""")
def render_picks(spark, d):
    from .plans.queue import render_targets

    return render_targets(site(spark, d), 400).select("page_id", "stage", "escalation")


@query(f"""SELECT page_id, CASE WHEN prefers_rendered AND rendered_title <> '' THEN rendered_title ELSE title END AS title, CASE WHEN prefers_rendered AND rendered_title <> '' THEN 'rendered' ELSE 'raw' END AS title_source,
CASE WHEN prefers_rendered AND rendered_canonical <> '' THEN 'rendered' WHEN prefers_rendered THEN 'raw_fallback' ELSE 'raw' END AS link_source FROM ({SITE})""")
def effective_facts(spark, d):
    from .plans.resolution import effective

    c = F.col
    p = site(spark, d).select("page_id", effective(c("title"), c("rendered_title"), c("prefers_rendered")).alias("t"), effective(c("canonical_url"), c("rendered_canonical"), c("prefers_rendered"), "raw_fallback").alias("l"))
    return p.select("page_id", F.col("t.value").alias("title"), F.col("t.source").alias("title_source"), F.col("l.source").alias("link_source"))


_MANY = "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a b' WHEN 3 THEN 'p a' ELSE 'b' END"
_RAW = "CASE (page_id * 3) % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'z' ELSE 'p' END"


@query(f"""WITH r AS (SELECT page_id, prefers_rendered, {_RAW} AS raw, list_filter(string_split({_MANY}, ' '), lambda x: x <> '') AS many FROM ({SITE})),
o AS (SELECT *, CASE WHEN NOT (prefers_rendered AND len(many) > 0) THEN CASE WHEN raw <> '' THEN 'raw' ELSE 'unresolved' END WHEN len(many) = 1 THEN 'resolver:rendered_single' WHEN list_contains(many, 'p') THEN 'resolver:rendered_self_match' WHEN raw <> '' AND list_contains(many, raw) THEN 'resolver:raw_agreement_fallback' ELSE 'resolver:rendered_multiple_unresolved' END AS outcome FROM r),
v AS (SELECT *, CASE outcome WHEN 'resolver:rendered_single' THEN many[1] WHEN 'resolver:rendered_self_match' THEN 'p' WHEN 'resolver:rendered_multiple_unresolved' THEN '' ELSE raw END AS canonical FROM o)
SELECT page_id, canonical, outcome, CAST(outcome LIKE 'resolver:%' AND raw <> '' AND CASE WHEN outcome IN ('resolver:rendered_single', 'resolver:rendered_self_match') THEN raw <> canonical ELSE NOT list_contains(many, raw) END AS INTEGER) AS conflict, CAST(outcome = 'resolver:rendered_multiple_unresolved' AS INTEGER) AS unresolved FROM v""")
def canonical_outcomes(spark, d):
    from .plans.resolution import resolve_canonical

    p = site(spark, d).select("page_id", "prefers_rendered", F.expr(_RAW).alias("raw"), F.filter(F.split(F.expr(_MANY), " "), lambda x: x != "").alias("many"))
    p = p.select("page_id", resolve_canonical(F.col("raw"), F.col("many"), F.lit("p"), F.col("prefers_rendered")).alias("r"))
    return p.select("page_id", F.col("r.value").alias("canonical"), "r.outcome", "r.conflict", "r.unresolved")


@query(f"""SELECT page_id, CASE WHEN shell_score < 30 THEN 'raw_shell_unlikely' WHEN was_rendered AND (rendered_words >= greatest(180, word_count * 2) OR rendered_links >= greatest(4, internal_links_out + 3) OR (title <> '' AND rendered_title <> '' AND title <> rendered_title)) THEN 'raw_shell_confirmed_after_render' ELSE 'raw_shell_possible' END AS shell_state FROM ({SITE})""")
def shell_states(spark, d):
    from .plans.resolution import shell_state

    c = F.col
    changed = (c("title") != "") & (c("rendered_title") != "") & (c("title") != c("rendered_title"))
    return site(spark, d).select("page_id", shell_state(F.lit(""), c("shell_score"), c("was_rendered"), c("word_count"), c("rendered_words"), c("internal_links_out"), c("rendered_links"), changed).alias("shell_state"))


_SHELL_HTML = "CASE page_id % 4 WHEN 0 THEN '<div id=\"root\"></div>' WHEN 1 THEN '<div id=\"app\">x</div><noscript>Please enable JavaScript</noscript>' ELSE '<p>text</p>' END || repeat('<script src=\"a.js\"></script>', CAST(page_id % 8 AS INT)) || repeat('<script type=\"module\" src=\"b.js\"></script>', CAST(page_id % 3 AS INT))"


@query(f"""WITH f AS (SELECT *, page_id % 8 + page_id % 3 AS scripts, page_id % 3 AS modules FROM ({SITE})),
s AS (SELECT page_id, {points(("word_count < 60", 30), ("word_count BETWEEN 60 AND 119", 15), ("h1_count = 0", 15), ("internal_links_out <= 1", 15), ("page_id % 4 < 2", 10), ("scripts >= 6", 15), ("page_id % 4 = 0 AND scripts >= 3", 18), ("page_id % 4 = 1", 18), ("modules >= 2", 8), ("title = ''", 8), ("canonical_url = ''", 5))} AS points FROM f)
SELECT page_id, least(100, points) AS score, least(100, points) >= 45 AS likely, CASE WHEN points >= 30 THEN 'raw_shell_possible' ELSE 'raw_shell_unlikely' END AS state FROM s""")
def shell_scores(spark, d):
    from .plans.resolution import shell

    c = F.col
    p = site(spark, d).withColumn("html", F.expr(_SHELL_HTML))
    return p.select("page_id", shell(c("html"), c("word_count"), c("h1_count"), c("internal_links_out"), c("title"), c("canonical_url")).alias("s")).select("page_id", "s.score", "s.likely", "s.state")


# --- governance, previews, citations ------------------------------------------------------------------------------------


@query(f"SELECT page_id, {RESTRICTION} AS restriction, {ELIGIBLE} AS eligible FROM ({SITE})")
def preview_controls(spark, d):
    from .plans import policy as P

    return P.completed(site(spark, d)).select("page_id", P.restriction().alias("restriction"), P.snippet_eligible().alias("eligible"))


_JUDGED = f"{ELIGIBLE} AND NOT (is_noindex = 1 OR (k IN ('utility') AND {WEIGHT} < 1.1))"
_MATTERS = f"{RESTRICTION} >= 4 AND ({WEIGHT} >= 1.0 OR k IN ('homepage', 'service', 'location', 'product', 'article'))"


@query(f"""WITH p AS (SELECT *, {KIND} AS k FROM ({SITE}))
SELECT count(*) AS total, count(*) FILTER (WHERE governance_googlebot_allowed = 0) AS googlebot_blocked, count(*) FILTER (WHERE governance_bingbot_allowed = 0) AS bingbot_blocked, count(*) FILTER (WHERE governance_openai_allowed = 0) AS oai_searchbot_blocked, 0::BIGINT AS gptbot_blocked,
count(*) FILTER (WHERE {_JUDGED} AND ({RESTRICTION} >= 5 OR ({_MATTERS}))) AS preview_restricted_pages, count(*) FILTER (WHERE {RESTRICTION} >= 4) AS preview_restricted_diagnostic_pages, count(*) FILTER (WHERE {_JUDGED} AND {RESTRICTION} >= 5) AS over_restrictive_pages,
count(*) FILTER (WHERE {_JUDGED} AND {_MATTERS}) AS bing_restrictive_pages, count(*) FILTER (WHERE meta_robots <> rendered_meta_robots) AS raw_render_mismatch_pages FROM p""")
def governance_totals(spark, d):
    from .plans.resolution import governance_summary

    return governance_summary(site(spark, d)).drop("google_extended_blocked", "oai_adsbot_blocked", "chatgpt_user_blocked")


_ANSWER = "(CASE WHEN title <> '' THEN 35 ELSE 0 END + CASE WHEN h1_count > 0 THEN 25 ELSE 0 END + CASE WHEN word_count >= 220 THEN 40 WHEN word_count >= 120 THEN 20 ELSE 0 END)"
_LOSS = [("is_noindex = 1", 70, "noindex"), ("governance_googlebot_allowed = 0", 24, "googlebot_blocked"), ("governance_bingbot_allowed = 0", 24, "bingbot_blocked"), ("governance_openai_allowed = 0", 24, "oai_searchbot_blocked"), ("has_nosnippet_directive = 1", 30, "nosnippet"), ("max_snippet_directive IN ('0', '-1')", 16, "max_snippet_non_positive"), ("internal_links_out < 2", 12, "weak_internal_prominence"), ("schema_validation_score BETWEEN 1 AND 69", 10, "schema_validation_weak")]


@query(f"SELECT page_id, CAST(greatest(0, least(100, 100 - ({points(*[x[:2] for x in _LOSS])}) + CASE WHEN schema_validation_score >= 70 THEN 5 ELSE 0 END + CAST(round_even({_ANSWER} / 10.0, 0) AS INTEGER))) AS INTEGER) AS score, array_to_string({reasons(*[(x[0], x[2]) for x in _LOSS], (f'{_ANSWER} >= 70', 'answer_like_visible_content'))}, ',') AS reasons FROM ({SITE})")
def citation_scores(spark, d):
    from .plans.resolution import citation, governance

    return citation(governance(site(spark, d))).select("page_id", F.col("citation_score").alias("score"), F.array_join("citation_reasons", ",").alias("reasons"))


_ROBOTS = "CASE page_id % 3 WHEN 0 THEN 'index, nofollow' WHEN 1 THEN 'NOINDEX' ELSE '' END"
_SCOPED = "CASE page_id % 4 WHEN 0 THEN 'max-image-preview:large' ELSE '' END"
_HEADER = "CASE page_id % 5 WHEN 0 THEN 'googlebot: nosnippet, max-image-preview:none' WHEN 1 THEN 'bingbot: noarchive' WHEN 2 THEN 'max-image-preview:standard' WHEN 3 THEN 'otherbot: noindex' ELSE '' END"


@query(f"""WITH a AS (SELECT page_id, list_sort(list_distinct(list_filter(list_transform(string_split(lower({_ROBOTS} || ',' || {_SCOPED} || ',' || CASE page_id % 5 WHEN 0 THEN 'nosnippet, max-image-preview:none' WHEN 2 THEN 'max-image-preview:standard' ELSE '' END), ','), lambda x: trim(x)), lambda x: x <> ''))) AS d FROM ({SITE}))
SELECT page_id, array_to_string(d, '|') AS directives, CASE WHEN list_contains(d, 'max-image-preview:none') THEN 'none' WHEN list_contains(d, 'max-image-preview:standard') THEN 'standard' WHEN list_contains(d, 'max-image-preview:large') THEN 'large' ELSE '' END AS image_preview FROM a""")
def robots_directives(spark, d):
    p = site(spark, d).select("page_id", C.applied_directives(F.array(F.expr(_ROBOTS)), F.array(F.expr(_SCOPED)), F.array(F.expr(_HEADER)), "googlebot").alias("a"))
    return p.select("page_id", F.array_join("a", "|").alias("directives"), C.strictest_preview(F.col("a")).alias("image_preview"))


# --- states and families ------------------------------------------------------------------------------------------------

_COVERAGE = "CASE page_id % 6 WHEN 0 THEN 'Submitted and indexed' WHEN 1 THEN 'Crawled - currently not indexed' WHEN 2 THEN 'Submitted URL blocked by robots.txt' WHEN 3 THEN 'Unknown to the engine' ELSE '' END"
_INDEXING = "CASE page_id % 4 WHEN 0 THEN 'BLOCKED_BY_ROBOTS_TXT' WHEN 1 THEN 'INDEXING_ALLOWED' ELSE '' END"
_VERDICT = "CASE WHEN page_id % 5 = 0 THEN 'NEUTRAL' ELSE 'PASS' END"
_FETCH = "CASE WHEN page_id % 7 = 0 THEN 'BLOCKED_4XX' ELSE 'SUCCESSFUL' END"


@query(f"""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'indexed' WHEN page_id % 6 IN (1, 2) THEN 'not_indexed' WHEN page_id % 4 = 0 OR page_id % 7 = 0 THEN 'not_indexed' WHEN page_id % 5 <> 0 AND page_id % 4 = 1 THEN 'indexed' ELSE 'unknown' END AS state FROM ({SITE})""")
def index_states(spark, d):
    from .plans.resolution import index_state

    x = F.expr
    return site(spark, d).select("page_id", index_state(x(_VERDICT), x(_COVERAGE), x(_INDEXING), F.lit("ALLOWED"), x(_FETCH)).alias("state"))


_MESSAGE = "CASE page_id % 8 WHEN 0 THEN 'RuntimeError: boom' WHEN 1 THEN 'Read timed out' WHEN 2 THEN 'HTTP 429' WHEN 3 THEN 'no CrUX record' WHEN 4 THEN 'missing key' WHEN 5 THEN 'Playwright import failed' WHEN 6 THEN 'navigation broke' ELSE '' END"


@query(f"SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'runtime' WHEN 1 THEN 'timeout' WHEN 2 THEN 'quota' WHEN 3 THEN 'no_fcp' WHEN 4 THEN 'not_attempted_policy' ELSE 'http' END AS family, CASE page_id % 8 WHEN 5 THEN 'environment' WHEN 6 THEN 'navigation' WHEN 7 THEN '' ELSE 'runtime' END AS render_family FROM ({SITE})")
def error_families(spark, d):
    from .plans.resolution import error_family, render_error_family

    return site(spark, d).select("page_id", error_family(F.expr(_MESSAGE)).alias("family"), render_error_family(F.expr(_MESSAGE)).alias("render_family"))


_STACK_HTML = "CASE page_id % 6 WHEN 0 THEN 'CDN.shopify.com' WHEN 1 THEN '/_next/static __NEXT_DATA__' WHEN 2 THEN 'wp-json wordpress' WHEN 3 THEN 'static.wixstatic.com' ELSE '' END"
_STACK_HOST = "CASE WHEN page_id % 5 = 0 THEN 'a.myshopify.com' ELSE 'e.com' END"
_SERVER = "CASE page_id % 7 WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'Vercel' ELSE 'nginx' END"


@query(f"""WITH s AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 45 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 35 ELSE 0 END AS shopify, CASE WHEN page_id % 6 = 3 THEN 45 ELSE 0 END AS wix, CASE WHEN page_id % 6 = 2 THEN 50 ELSE 0 END AS wordpress,
CASE WHEN page_id % 6 = 1 THEN 75 ELSE 0 END + CASE WHEN page_id % 7 = 1 THEN 15 ELSE 0 END AS nextjs, CASE WHEN page_id % 7 = 0 THEN 55 ELSE 0 END AS cloudflare FROM ({SITE})), b AS (SELECT *, greatest(shopify, wix, wordpress, nextjs, cloudflare) AS best FROM s)
SELECT page_id, CASE WHEN best < 35 THEN NULL WHEN shopify = best THEN 'shopify' WHEN wix = best THEN 'wix' WHEN wordpress = best THEN 'wordpress' WHEN nextjs = best THEN 'nextjs' ELSE 'cloudflare' END AS platform, CASE WHEN best >= 35 THEN least(99, best) END AS confidence FROM b""")
def platforms(spark, d):
    from .plans.resolution import platform

    p = site(spark, d).select("page_id", platform(F.expr(_STACK_HTML), F.expr(_STACK_HOST), F.create_map(F.lit("server"), F.expr(_SERVER))).alias("p"))
    return p.select("page_id", "p.platform", "p.confidence")


@query(f"SELECT page_id, page_type NOT IN ('utility') AND page_id % 4 <> 0 AS title_counts, page_type NOT IN ('utility') AND page_id % 13 <> 0 AS description_counts FROM ({SITE})")
def duplicate_candidates(spark, d):
    from .plans.resolution import duplicate_metadata_candidate as counts

    # 'Title 1' has seven characters; with a word more it counts.
    title = F.when(F.col("title") != "", F.concat("title", F.lit(" of it"))).otherwise("")
    return site(spark, d).select("page_id", counts(title, F.col("page_type")).alias("title_counts"), counts(F.col("meta_description"), F.col("page_type")).alias("description_counts"))


# --- groups, scopes, weights --------------------------------------------------------------------------------------------


@query(f"""SELECT page_id, CASE WHEN page_type = 'utility' OR seg = 'tag' THEN 'utility' WHEN page_type IN ('homepage', 'service', 'contact', 'location') OR seg IN ('service', 'products', 'quote') THEN 'money' ELSE 'other' END AS track,
CASE WHEN page_type = 'homepage' OR seg = '' THEN 'home' WHEN page_type = 'service' OR seg = 'service' THEN 'service' WHEN seg = 'products' THEN 'product' WHEN page_type = 'article' OR seg = 'blog' THEN 'blog' WHEN page_type = 'utility' OR seg = 'tag' THEN 'taxonomy' ELSE 'other' END AS template_group,
CASE WHEN k = 'homepage' OR seg = '' THEN 'home-template' WHEN k = 'service' OR seg = 'service' THEN 'service-template' WHEN k IN ('product', 'location') OR seg IN ('products', 'location') THEN 'commercial-template' WHEN k = 'article' OR seg = 'blog' THEN 'content-template' WHEN k IN ('tag', 'utility') THEN 'utility-template' ELSE 'other-template' END AS template
FROM (SELECT *, {SEGMENT} AS seg, {KIND} AS k FROM ({SITE}))""")
def page_groups(spark, d):
    from .plans import policy as P
    from .plans.report import template_group, track

    kind, url = F.col("page_type"), F.col("normalized_url")
    return P.completed(site(spark, d)).select("page_id", track(kind, url).alias("track"), template_group(kind, url).alias("template_group"), P.template_cluster(P.page_type(True), url).alias("template"))


@query(f"""WITH p AS (SELECT *, {SEGMENT} AS seg FROM ({SITE})), f AS (SELECT CASE WHEN page_type = 'homepage' OR seg = '' THEN 'home' WHEN page_type = 'service' OR seg = 'service' THEN 'service' WHEN seg = 'products' THEN 'product' WHEN page_type = 'article' OR seg = 'blog' THEN 'blog' WHEN page_type = 'utility' OR seg = 'tag' THEN 'taxonomy' ELSE 'other' END AS template_group, CASE WHEN page_id % 3 > 0 THEN render_gap_score END AS s FROM p)
SELECT template_group, count(*) AS n, count(s) AS scored, round(avg(s), 2) AS average FROM f GROUP BY template_group""")
def performance_by_group(spark, d):
    from .plans.report import performance_groups

    p = site(spark, d)
    rows = p.select(F.col("normalized_url").alias("url"), F.when(F.col("page_id") % 3 > 0, F.col("render_gap_score")).alias("performance_score"))
    return performance_groups(rows, p).groupBy("template_group").agg(F.count("*").alias("n"), F.count("performance_score").alias("scored"), F.round(F.avg("performance_score"), 2).alias("average"))


@query(f"""WITH p AS (SELECT *, {SEGMENT} AS seg FROM ({SITE})), f AS (SELECT CASE WHEN page_type = 'utility' OR seg = 'tag' THEN 'utility' WHEN page_type IN ('homepage', 'service', 'contact', 'location') OR seg IN ('service', 'products', 'quote') THEN 'money' ELSE 'other' END AS track, CASE status_code WHEN 404 THEN 'GONE' WHEN 500 THEN 'BROKEN' ELSE 'FINE' END AS issue_code FROM p)
SELECT track, issue_code, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, issue_code) AS rank FROM (SELECT track, issue_code, count(*) AS n FROM f GROUP BY ALL)) WHERE rank <= 2""")
def codes_by_track(spark, d):
    from .operators.relational import top_per_group
    from .plans.report import track

    p = site(spark, d).select(track(F.col("page_type"), F.col("normalized_url")).alias("track"), F.when(F.col("status_code") == 404, "GONE").when(F.col("status_code") == 500, "BROKEN").otherwise("FINE").alias("issue_code"))
    return top_per_group(p, ["track"], "issue_code", 2)


_HOST = "CASE page_id % 6 WHEN 0 THEN 'e.com' WHEN 1 THEN 'www.e.com' WHEN 2 THEN 'blog.e.com' WHEN 3 THEN 'other.org' WHEN 4 THEN 'note.com' ELSE '' END"


@query(f"SELECT page_id, page_id % 6 = 1 AS host_only, page_id % 6 IN (0, 1) AS apex_www, page_id % 6 IN (0, 1, 2) AS all_subdomains, page_id % 6 IN (0, 1, 3) AS listed, page_id % 6 IN (0, 1, 4) AS redirected FROM ({SITE})")
def host_scopes(spark, d):
    h = F.expr(_HOST)
    return site(spark, d).select("page_id", C.in_scope(h, "www.e.com", "host_only").alias("host_only"), C.in_scope(h, "www.e.com").alias("apex_www"), C.in_scope(h, "www.e.com", "all_subdomains").alias("all_subdomains"), C.in_scope(h, "www.e.com", "custom_allowlist", ["https://other.org/"]).alias("listed"), C.in_scope(h, "www.e.com", redirect_host="note.com").alias("redirected"))


@query(f"""WITH p AS (SELECT *, {KIND} AS k FROM ({SITE}))
SELECT page_id, k AS kind, round({WEIGHT}, 2) AS importance, CASE WHEN k IN ('homepage', 'service', 'location', 'product') THEN 220 WHEN k IN ('article', 'industry') THEN 170 WHEN k = 'contact' THEN 80 WHEN k IN ('tag', 'utility') THEN 70 ELSE 140 END AS thin_threshold,
CASE WHEN k = 'homepage' THEN CASE WHEN l <= 1 THEN 'severe' WHEN l <= 3 THEN 'weak' WHEN l <= 6 THEN 'okay' ELSE 'strong' END WHEN k IN ('service', 'location', 'product') THEN CASE WHEN l <= 1 THEN 'severe' WHEN l <= 3 THEN 'weak' WHEN l <= 5 THEN 'okay' ELSE 'strong' END
WHEN k = 'article' THEN CASE WHEN l <= 0 THEN 'severe' WHEN l <= 2 THEN 'weak' WHEN l <= 4 THEN 'okay' ELSE 'strong' END WHEN k IN ('tag', 'utility', 'contact') THEN CASE WHEN l <= 0 THEN 'severe' WHEN l <= 2 THEN 'weak' WHEN l <= 3 THEN 'okay' ELSE 'strong' END ELSE CASE WHEN l <= 1 THEN 'severe' WHEN l <= 2 THEN 'weak' WHEN l <= 4 THEN 'okay' ELSE 'strong' END END AS band
FROM (SELECT *, internal_links_out AS l FROM p)""")
def page_weights(spark, d):
    from .plans import policy as P

    p = P.completed(site(spark, d)).withColumn("k", P.page_type(True))
    return p.select("page_id", F.col("k").alias("kind"), F.round(P.importance(F.col("k")), 2).alias("importance"), P.thin_threshold(F.col("k")).alias("thin_threshold"), P.link_band(F.col("k"), P.links_out()).alias("band"))


_RULES = [
    (f"{WORKS} AND is_noindex = 1", "NOINDEX", "'high'"),
    (f"{WORKS} AND is_noindex = 0 AND title = ''", "MISSING_TITLE", "'high'"),
    (f"{WORKS} AND is_noindex = 0 AND meta_description = ''", "MISSING_META_DESCRIPTION", "'medium'"),
    (f"{WORKS} AND is_noindex = 0 AND h1 = ''", "MISSING_H1", "'medium'"),
    (f"{WORKS} AND is_noindex = 0 AND canonical_url = ''", "MISSING_CANONICAL", "'medium'"),
    (f"{WORKS} AND is_noindex = 0 AND canonical_url <> ''", "CANONICAL_MISMATCH", "'high'"),
    (f"{WORKS} AND is_noindex = 0 AND canonical_url <> ''", "CANONICAL_SELF_MISMATCH", "'medium'"),
    (f"{WORKS} AND is_noindex = 0 AND word_count < CASE WHEN k IN ('homepage', 'service', 'location', 'product') THEN 220 WHEN k IN ('article', 'industry') THEN 170 WHEN k = 'contact' THEN 80 WHEN k IN ('tag', 'utility') THEN 70 ELSE 140 END", "THIN_CONTENT", "'medium'"),
    (f"{WORKS} AND is_noindex = 0 AND render_gap_score >= 60", "RENDER_GAP_HIGH", "'high'"),
    (f"{WORKS} AND is_noindex = 0 AND l <= CASE WHEN k IN ('homepage', 'service', 'location', 'product') THEN 3 ELSE 2 END", "LOW_INTERNAL_LINKS", "'low'"),
]
_PLAIN = ["page_id", "run_id", "normalized_url", "page_type", "status_code", "content_type", "title", "h1", "h1_count", "meta_description", "canonical_url", "word_count", "internal_links_out", "render_gap_score", "is_noindex"]


@query("WITH p AS (SELECT *, " + KIND + " AS k, internal_links_out AS l FROM (" + SITE + ")) " + " UNION ALL ".join(f"SELECT normalized_url AS url, '{code}' AS issue_code, {severity} AS severity FROM p WHERE {rule}" for rule, code, severity in _RULES))
def rule_findings(spark, d):
    from .plans.rules import findings

    return findings(site(spark, d).select(*_PLAIN)).select("url", "issue_code", "severity")


@query(f"""WITH p AS (SELECT *, {KIND} AS k, {SEGMENT} AS seg FROM ({SITE})), t AS (SELECT *, CASE WHEN k = 'homepage' OR seg = '' THEN 'home-template' WHEN k = 'service' OR seg = 'service' THEN 'service-template' WHEN k IN ('product', 'location') OR seg IN ('products', 'location') THEN 'commercial-template' WHEN k = 'article' OR seg = 'blog' THEN 'content-template' WHEN k IN ('tag', 'utility') THEN 'utility-template' ELSE 'other-template' END AS template FROM p),
f AS (SELECT *, 'MISSING_TITLE' AS issue_code FROM t WHERE {WORKS} AND is_noindex = 0 AND title = '' UNION ALL SELECT *, 'MISSING_H1' FROM t WHERE {WORKS} AND is_noindex = 0 AND h1 = '' UNION ALL SELECT *, 'NOINDEX' FROM t WHERE {WORKS} AND is_noindex = 1),
n AS (SELECT issue_code, template, count(*) AS n, min(normalized_url) AS seen FROM f GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY issue_code ORDER BY n DESC, seen) AS r FROM n),
c AS (SELECT issue_code, count(DISTINCT normalized_url) AS affected_count, array_to_string(list_sort(list(DISTINCT k)), ',') AS affected_page_types FROM f GROUP BY issue_code), total AS (SELECT count(*) AS total FROM t WHERE {WORKS})
SELECT c.issue_code, affected_count, affected_page_types, CASE WHEN top.n >= 3 AND top.n / affected_count >= 0.5 THEN top.template ELSE '' END AS template_cluster, round(least(1.0, affected_count / total), 6) AS affected_ratio,
CASE WHEN affected_count / total >= 0.4 OR affected_count >= 10 THEN 'sitewide' WHEN affected_count / total >= 0.1 OR affected_count >= 3 OR (top.n >= 3 AND top.n / affected_count >= 0.5) THEN 'template_cluster' ELSE 'single_page' END AS reach FROM c JOIN top ON top.issue_code = c.issue_code AND top.r = 1, total""")
def finding_context(spark, d):
    from .plans.rules import enriched, findings

    pages = site(spark, d).select(*_PLAIN)
    rows = enriched(findings(pages), pages).where(F.col("issue_code").isin("MISSING_TITLE", "MISSING_H1", "NOINDEX"))
    return rows.select("issue_code", "affected_count", "affected_page_types", "template_cluster", F.round("affected_ratio", 6).alias("affected_ratio"), "reach").distinct()


# --- selections ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT page_id FROM ({SITE}) WHERE {WORKS} ORDER BY coalesce(nullif(page_type, ''), 'other') <> 'homepage', render_gap_score >= 90,
CASE coalesce(nullif(page_type, ''), 'other') WHEN 'homepage' THEN 0 WHEN 'service' THEN 1 WHEN 'contact' THEN 2 WHEN 'about' THEN 3 WHEN 'location' THEN 4 WHEN 'article' THEN 5 WHEN 'industry' THEN 6 WHEN 'other' THEN 7 ELSE 99 END, CASE crawl_depth WHEN 0 THEN 99 ELSE crawl_depth END, internal_links_out DESC, word_count DESC, normalized_url LIMIT 120""")
def measure_targets(spark, d):
    from .plans.queue import measurement_targets

    return measurement_targets(site(spark, d), 120).select("page_id")


_FOUND = "CASE event_id % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'no_data' WHEN 2 THEN 'failed_http' WHEN 3 THEN 'skipped_missing_key' WHEN 4 THEN 'no_data' ELSE 'odd' END"


@query(f"""WITH e AS (SELECT 'u' || CAST(user_id * 1000 + event_id % 97 AS STRING) AS url, {_FOUND} AS found, event_id % 12 = 2 AS broke, event_id AS seq FROM events WHERE value > 40),
s AS (SELECT url, seq, CASE found WHEN 'success' THEN 'ok' WHEN 'no_data' THEN 'provider_unavailable_data' WHEN 'skipped_missing_key' THEN 'measurement_not_attempted_by_policy' WHEN 'failed_http' THEN CASE WHEN broke THEN 'provider_runtime_error' ELSE 'provider_error' END END AS status,
CASE found WHEN 'success' THEN 'none' WHEN 'no_data' THEN 'no_fcp' WHEN 'skipped_missing_key' THEN 'not_attempted_policy' WHEN 'failed_http' THEN CASE WHEN broke THEN 'runtime' ELSE 'http' END END AS family FROM e),
r AS (SELECT *, CASE status WHEN 'ok' THEN 6 WHEN 'provider_error' THEN 5 WHEN 'provider_runtime_error' THEN 4 WHEN 'provider_unavailable_data' THEN 2 ELSE 1 END AS rank FROM s WHERE status IS NOT NULL),
a AS (SELECT url, 'measurement_not_attempted_by_policy' AS status, 'not_attempted_policy' AS family, 1 AS rank, -1 AS seq FROM (SELECT DISTINCT url FROM e) UNION ALL SELECT url, status, family, rank, seq FROM r)
SELECT url, status, family FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank DESC, seq DESC) AS n FROM a) WHERE n = 1""")
def measurement_statuses(spark, d):
    from .plans.queue import field_evidence, measurement_status

    e = t(spark, d, "events").where("value > 40").selectExpr("'u' || CAST(user_id * 1000 + event_id % 97 AS STRING) AS url", f"{_FOUND} AS status", "CASE WHEN event_id % 12 = 2 THEN 'RuntimeError' ELSE 'HTTP 500' END AS error_message", "event_id AS seq")
    return measurement_status(e.select("url"), field_evidence(e))


@query("SELECT url FROM (SELECT 'u' || CAST(user_id AS STRING) AS url, max(event_id) AS seq FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 200) GROUP BY 1)")
def recent_changed(spark, d):
    from .plans.queue import recent_urls

    return recent_urls(t(spark, d, "events").where("event_type = 'click'").selectExpr("'u' || CAST(user_id AS STRING) AS url", "event_id"), "event_id", 200).select("url")


@query(f"SELECT page_id FROM ({SITE}) WHERE render_gap_score % 2 = 1")
def render_sources(spark, d):
    from .plans.queue import changed_only

    return changed_only(site(spark, d).withColumn("changed_since_last_run", F.col("render_gap_score") % 2), True, False).select("page_id")


_JOBS = "SELECT event_id AS job_id, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'leased' WHEN 2 THEN 'retry_wait' ELSE 'queued' END AS state, CAST(floor(value) AS INT) AS priority, 'd' || CAST(user_id AS STRING) AS domain_key, CAST(event_id % 4 AS INT) AS required_tokens, CAST(0 AS INT) AS render_heavy, CAST(event_id % 2 AS INT) AS provider_heavy, CAST(0 AS INT) AS offsite_heavy, CAST(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS INT) AS cancel_requested, ts AS submitted_at, CASE WHEN event_id % 3 = 0 THEN ts END AS next_eligible_at, ts AS lease_expires_at FROM events"


def _jobs(spark, d):
    return spark.sql(_JOBS.replace("FROM events", "FROM {events}"), events=t(spark, d, "events"))


@query(f"SELECT CAST(sum(required_tokens) AS BIGINT) AS load_required_tokens, CAST(sum(render_heavy) AS BIGINT) AS load_render_heavy, CAST(sum(provider_heavy) AS BIGINT) AS load_provider_heavy, CAST(sum(offsite_heavy) AS BIGINT) AS load_offsite_heavy FROM ({_JOBS}) WHERE state IN ('running', 'leased')")
def job_load(spark, d):
    from .plans.queue import active_load

    return active_load(_jobs(spark, d))


@query(f"WITH j AS ({_JOBS}), w AS (SELECT sum(required_tokens) AS used FROM j WHERE state IN ('running', 'leased')) SELECT job_id FROM j, w WHERE state IN ('queued', 'retry_wait') AND cancel_requested = 0 AND coalesce(next_eligible_at, submitted_at) <= TIMESTAMP '2024-06-01' AND used + required_tokens <= 1000000 ORDER BY priority DESC, submitted_at, job_id LIMIT 100")
def job_pick(spark, d):
    from .plans.queue import next_jobs

    return next_jobs(_jobs(spark, d), "2024-06-01", {"required_tokens": 1_000_000}, exclusive_domains=False).select("job_id")


@query(f"SELECT job_id FROM ({_JOBS}) WHERE state IN ('running', 'leased') AND lease_expires_at < TIMESTAMP '2024-01-10'")
def job_expired(spark, d):
    from .plans.queue import expired

    return expired(_jobs(spark, d), "2024-01-10").select("job_id")


@query("SELECT user_id AS job_id, event_id % 50 AS attempt_no, event_id AS attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 50 DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def job_attempts(spark, d):
    from .plans.queue import latest_attempts

    return latest_attempts(t(spark, d, "events").selectExpr("user_id AS job_id", "event_id % 50 AS attempt_no", "event_id AS attempt_id"))


@query("""WITH s AS (SELECT o_custkey AS k, CAST(count(*) % 2 AS INTEGER) AS changed, CAST(count(*) AS INTEGER) AS streak FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS url, coalesce(changed, 1) AS changed, coalesce(streak, 0) AS streak FROM customer LEFT JOIN s ON k = c_custkey""")
def recrawl_plan(spark, d):
    from .plans.queue import crawl_plan

    state = t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("normalized_url")).agg((F.count("*") % 2).cast("int").alias("changed"), F.count("*").cast("int").alias("not_modified_streak"))
    return crawl_plan(t(spark, d, "customer").select(F.col("c_custkey").alias("url")), state).select("url", "changed", F.col("not_modified_streak").alias("streak"))


# --- lists, joins, rollups ----------------------------------------------------------------------------------------------

_ISSUES = "SELECT 'r1' AS run_id, normalized_url AS url, CASE page_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS issue_code, CASE page_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CAST((page_id * 13) % 101 AS INT) AS priority_score, 'about ' || CAST(page_id % 5 AS STRING) AS title, 'text' AS description, page_id AS seq FROM p WHERE page_id % 5 < 4"
_SCORES = "SELECT 'r1' AS run_id, normalized_url AS url, CAST((page_id * 29) % 101 AS INT) AS overall_score FROM p WHERE page_id % 7 > 0"


def _site_tables(spark, d):
    p = site(spark, d)
    return p, spark.sql(_ISSUES.replace("FROM p", "FROM {p}"), p=p), spark.sql(_SCORES.replace("FROM p", "FROM {p}"), p=p)


@query(f"""WITH p AS ({SITE}), i AS ({_ISSUES}), s AS ({_SCORES})
SELECT page_id, overall_score, (SELECT count(*) FROM i WHERE i.url = p.normalized_url) AS issue_count FROM p LEFT JOIN s ON s.url = p.normalized_url
WHERE status_code = 200 AND crawl_depth <= 4 AND coalesce(overall_score, 0) >= 10 AND (lower(normalized_url) LIKE '%/s%' OR lower(title) LIKE '%/s%' OR lower(h1) LIKE '%/s%') AND normalized_url IN (SELECT url FROM i WHERE severity = 'high')
ORDER BY coalesce(overall_score, 0) DESC, normalized_url LIMIT 10 OFFSET 0""")
def pages_filtered(spark, d):
    from .plans.insights import list_pages

    p, i, s = _site_tables(spark, d)
    return list_pages(p, s, i, "r1", status=200, max_depth=4, min_score=10, severity="HIGH", search="/s", page_size=10)[0].select("page_id", "overall_score", "issue_count")


@query(f"""WITH p AS ({SITE}), i AS ({_ISSUES}), s AS ({_SCORES})
SELECT i.url, issue_code, priority_score, page_type, overall_score FROM i LEFT JOIN p ON p.normalized_url = i.url LEFT JOIN s ON s.url = i.url WHERE severity = 'critical' AND priority_score >= 20 AND i.title LIKE '%t 1%'
ORDER BY priority_score DESC, i.url LIMIT 25 OFFSET 25""")
def issues_filtered(spark, d):
    from .plans.insights import list_issues

    p, i, s = _site_tables(spark, d)
    return list_issues(i, p, s, "r1", severity="critical", min_priority=20, search="t 1", page=2, page_size=25)[0].select("url", "issue_code", "priority_score", "page_type", "overall_score")


_METRICS = "SELECT 'r1' AS run_id, normalized_url AS url, (page_id % 50) / 1000.0 AS internal_pagerank, (page_id % 40) / 100.0 AS betweenness, 0.2 AS closeness, CAST(page_id % 6 AS INT) AS community_id, CAST(page_id % 2 AS INT) AS bridge_flag FROM p"
_LINKS = "SELECT 'r1' AS run_id, normalized_url AS source_url, 'https://www.e.com/service/' || CAST(page_id % 100 AS STRING) AS normalized_target_url, CAST(page_id % 2 AS INT) AS is_internal FROM p"


def _architecture(spark, d, name):
    from .plans.insights import architecture

    p, _, s = _site_tables(spark, d)
    made = lambda text: spark.sql(text.replace("FROM p", "FROM {p}"), p=p)
    return architecture(p, made(_METRICS), s, made(_LINKS), "r1")[name]


@query(f"WITH p AS ({SITE}), m AS ({_METRICS}), s AS ({_SCORES}), l AS ({_LINKS}) SELECT m.url, page_type, overall_score, (SELECT count(*) FROM l WHERE is_internal = 1 AND normalized_target_url = m.url) AS inlinks FROM m LEFT JOIN p ON p.normalized_url = m.url LEFT JOIN s ON s.url = m.url")
def link_nodes(spark, d):
    return _architecture(spark, d, "nodes").select("url", "page_type", "overall_score", "inlinks")


@query(f"WITH p AS ({SITE}), m AS ({_METRICS}) SELECT url FROM m WHERE bridge_flag = 1 AND betweenness >= greatest(0.05, (SELECT quantile_cont(betweenness, 0.9) FROM m WHERE betweenness > 0))")
def link_hubs(spark, d):
    return _architecture(spark, d, "overloaded_hubs").select("url")


@query(f"""WITH p AS ({SITE}), m AS (SELECT m.*, page_type FROM ({_METRICS}) m JOIN p ON p.normalized_url = m.url), z AS (SELECT community_id, count(*) AS size FROM m WHERE community_id > 0 GROUP BY 1),
y AS (SELECT community_id, page_type, count(*) AS n FROM m WHERE community_id > 0 GROUP BY ALL) SELECT z.community_id, size, (SELECT page_type FROM y WHERE y.community_id = z.community_id ORDER BY n DESC, page_type DESC LIMIT 1) AS dominant_type FROM z""")
def link_communities(spark, d):
    return _architecture(spark, d, "communities").select("community_id", "size", "dominant_type")


@query("""WITH r AS (SELECT s_name AS domain, round(avg(l_discount), 6) AS h, round(avg(l_tax), 6) AS p FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey BETWEEN 1 AND 6 GROUP BY s_name), t AS (SELECT s_name FROM supplier WHERE s_suppkey = 1)
SELECT domain, round(h - (SELECT h FROM r WHERE domain = (SELECT s_name FROM t)), 6) AS harmonic_gap, round(p - (SELECT p FROM r WHERE domain = (SELECT s_name FROM t)), 6) AS pagerank_gap FROM r WHERE domain <> (SELECT s_name FROM t)""")
def rank_gap(spark, d):
    from .operators.webgraph import rank_gaps

    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("domain"))
    ranks = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.avg("l_discount"), 6).alias("harmonic_centrality"), F.round(F.avg("l_tax"), 6).alias("pagerank"))
    names = [r["domain"] for r in s.where("id BETWEEN 1 AND 6").orderBy("id").collect()]
    gaps = rank_gaps(s, ranks, names[0], names[1:])
    # A supplier's name has one label, which is its own reverse but for the case.
    return gaps.join(s.select("domain", F.lower("domain").alias("name")), "name").select("domain", r6(F.col("harmonic_centrality_gap")).alias("harmonic_gap"), r6(F.col("pagerank_gap")).alias("pagerank_gap"))


@query(f"""WITH p AS ({SITE}), i AS ({_ISSUES}), s AS ({_SCORES}), n AS (SELECT url, count(*) AS issues FROM i GROUP BY url)
SELECT coalesce(nullif(trim(canonical_url), ''), 'unclustered') AS cluster, coalesce(nullif(page_type, ''), 'other') AS page_type, count(*) AS url_count, round(avg(coalesce(overall_score, 0)), 2) AS avg_score, CAST(coalesce(sum(issues), 0) AS BIGINT) AS issue_count
FROM p LEFT JOIN s ON s.url = p.normalized_url LEFT JOIN n ON n.url = p.normalized_url GROUP BY 1, 2""")
def template_rollups(spark, d):
    from .plans.scoring import template_rollup

    p, i, s = _site_tables(spark, d)
    return template_rollup(p.withColumn("canonical_cluster_key", F.col("canonical_url")), s, i).select("cluster", "page_type", "url_count", "avg_score", "issue_count")


@query(f"""WITH p AS ({SITE}), w AS (SELECT 'u' || CAST(page_id % 40 AS STRING) AS url, coalesce(nullif(CASE WHEN page_id % 3 > 0 THEN render_gap_score END, 0), 50) AS s FROM p) SELECT url, CAST(trunc(avg(s)) AS INTEGER) AS performance_score FROM w GROUP BY url""")
def performance_by_url(spark, d):
    from .plans.report import page_performance

    return page_performance(site(spark, d).select(F.concat(F.lit("u"), (F.col("page_id") % 40).cast("string")).alias("url"), F.when(F.col("page_id") % 3 > 0, F.col("render_gap_score")).alias("performance_score")))


@query(f"WITH p AS ({SITE}), h AS (SELECT normalized_url AS url, CASE page_id % 3 WHEN 0 THEN 'indexed' ELSE 'not_indexed' END AS state, page_id AS seq FROM p WHERE page_id % 4 = 0 UNION ALL SELECT normalized_url, 'indexed', page_id + 1000000 FROM p WHERE page_id % 8 = 0) SELECT p.page_id, coalesce((SELECT arg_max(state, seq) FROM h WHERE h.url = p.normalized_url), 'unknown') AS index_state FROM p")
def page_index_states(spark, d):
    from .plans.resolution import with_index_state

    p = site(spark, d)
    h = p.where("page_id % 4 = 0").selectExpr("normalized_url AS url", "CASE page_id % 3 WHEN 0 THEN 'indexed' ELSE 'not_indexed' END AS state", "page_id AS seq").unionByName(p.where("page_id % 8 = 0").selectExpr("normalized_url AS url", "'indexed' AS state", "page_id + 1000000 AS seq"))
    return with_index_state(p, h).select("page_id", "index_state")


@query(f"WITH p AS ({SITE}) SELECT normalized_url, CAST(sum(word_count) AS DOUBLE) AS clicks, CAST(sum(rendered_words) AS DOUBLE) AS impressions FROM p WHERE page_id % 8 > 0 GROUP BY normalized_url")
def page_search_metrics(spark, d):
    from .plans.resolution import with_search_metrics

    p = site(spark, d).where("page_id % 8 > 0")
    # Search rows spell the host in upper case.
    rows = p.select(F.replace("normalized_url", F.lit("https://www.e.com"), F.lit("HTTPS://WWW.E.COM")).alias("page"), F.col("word_count").cast("double").alias("clicks"), F.col("rendered_words").cast("double").alias("impressions"))
    return with_search_metrics(p.select("normalized_url").distinct(), rows)


# --- JSON, telemetry, counters ------------------------------------------------------------------------------------------

_DETAIL = "'{\"attempts\": ' || CAST(event_id % 9 AS STRING) || ', \"retries\": \"' || CAST(event_id % 4 AS STRING) || '\", \"wait_seconds\": ' || CAST(event_id % 5 AS STRING) || '.5' || CASE WHEN event_id % 3 = 0 THEN ', \"success\": \"x\"' ELSE ', \"success\": 7' END || '}'"


@query("SELECT event_id, event_type AS provider, CAST(event_id % 9 AS INTEGER) AS attempts, CAST(event_id % 4 AS INTEGER) AS retries, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 7 END AS success, 0 AS no_data, event_id % 5 + 0.5::DOUBLE AS wait_seconds FROM events WHERE value < 30")
def provider_summaries(spark, d):
    from .plans.insights import provider_telemetry

    e = t(spark, d, "events").where("value < 30").selectExpr("event_id", "event_type AS stage", "'provider_summary' AS event_type", f"{_DETAIL} AS detail_json")
    return provider_telemetry(e).select("event_id", "provider", "attempts", "retries", "success", "no_data", "wait_seconds")


_STAT = "CASE event_type WHEN 'view' THEN 'fetched' WHEN 'click' THEN 'not_modified' WHEN 'error' THEN 'fetch_retries_total' ELSE 'ignored' END"


@query("SELECT CAST(count(*) FILTER (WHERE event_type = 'view') * 2 AS BIGINT) AS fetched, CAST(count(*) FILTER (WHERE event_type = 'error') * 2 AS BIGINT) AS fetch_retries_total, CAST(count(*) FILTER (WHERE event_type = 'click') * 2 AS BIGINT) AS not_modified, 0::BIGINT AS rerendered FROM events")
def crawl_statistics(spark, d):
    from .plans.insights import crawl_counters

    return crawl_counters(t(spark, d, "events").selectExpr(f"{_STAT} AS stat", "2 AS n")).select("fetched", "fetch_retries_total", "not_modified", "rerendered")


_VALID = "CASE page_id % 4 WHEN 0 THEN '{\"syntax_valid\": false}' WHEN 1 THEN '{\"eligible_features\": [\"a\"], \"deprecated_features\": []}' WHEN 2 THEN '{\"deprecated_features\": [\"x\"], \"visible_content_mismatches\": [\"y\", \"z\"]}' ELSE '' END"


@query(f"SELECT count(*) FILTER (WHERE page_id % 4 <> 0) AS syntax_valid_pages, count(*) FILTER (WHERE page_id % 4 = 1) AS eligible_feature_pages, count(*) FILTER (WHERE page_id % 4 = 2) AS deprecated_markup_pages, count(*) FILTER (WHERE page_id % 4 = 2) AS visible_mismatch_pages FROM ({SITE})")
def schema_audits(spark, d):
    from .plans.resolution import schema_audit

    return schema_audit(site(spark, d).withColumn("schema_validation_json", F.expr(_VALID)))


@query("SELECT l_suppkey, CAST(round_even(avg(m), 0) AS INTEGER) AS engine_mean FROM (SELECT l_suppkey, l_returnflag, round_even(avg(least(100, l_quantity * 3)), 0) AS m FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def schema_engine_means(spark, d):
    from .plans.resolution import engine_means

    return engine_means(t(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("engine"), (F.col("l_quantity") * 3).alias("score")), "l_suppkey")


_PAYLOAD = "CASE page_id % 3 WHEN 0 THEN '{\"potential\": {\"score\": 40}, \"observed_evidence\": {\"gsc_clicks\": \"3\"}, \"adapters_applied\": [\"gsc\"], \"adapter_errors\": [\"old\"]}' WHEN 1 THEN '{\"adapters_applied\": [\"log\", \"gsc\"]}' ELSE 'broken' END"


@query(f"SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 100 WHEN page_id % 3 = 0 THEN 40 ELSE 0 END AS INTEGER) AS score, CASE page_id % 3 WHEN 0 THEN 'gsc,log' WHEN 1 THEN 'log,gsc' ELSE 'log' END AS adapters, CASE WHEN page_id % 3 = 0 THEN 'old,new' ELSE 'new' END AS errors FROM ({SITE})")
def visibility_merge(spark, d):
    from .plans.visibility import merged_payload

    p = site(spark, d).select("page_id", merged_payload(F.expr(_PAYLOAD), F.array(F.lit(" log "), F.lit("")), F.array(F.lit("new"), F.lit(" ")), F.when(F.col("page_id") % 2 == 0, F.lit(140))).alias("m"))
    return p.select("page_id", "m.score", F.array_join("m.adapters", ",").alias("adapters"), F.array_join("m.errors", ",").alias("errors"))


@query(f"SELECT 'gsc' AS adapter, count(*) FILTER (WHERE page_id % 3 < 2) AS n, (SELECT count(*) FROM ({SITE}) WHERE page_id % 3 = 0) AS observed FROM ({SITE}) UNION ALL SELECT 'log', count(*) FILTER (WHERE page_id % 3 = 1), (SELECT count(*) FROM ({SITE}) WHERE page_id % 3 = 0) FROM ({SITE})")
def visibility_counts(spark, d):
    from .plans.visibility import payload_counts

    total, adapters = payload_counts(site(spark, d).withColumn("payload", F.expr(_PAYLOAD)).withColumn("score", F.lit(None).cast("int")), "payload", "score")
    return adapters.join(F.broadcast(total.select(F.col("observed_pages").alias("observed"))), how="cross")


@query(f"WITH p AS ({SITE}) SELECT 'e.com' AS url, 'DISCOVERY_BLIND_SPOT' AS issue_code, 'medium' AS severity, CAST((SELECT count(*) FROM p WHERE shell_score >= 45) AS BIGINT) AS shells")
def discovery_blind_spot(spark, d):
    from .plans.visibility import blind_spot

    p = site(spark, d).withColumn("likely_js_shell", (F.col("shell_score") >= 45).cast("int"))
    stats = spark.range(1).selectExpr("4 AS checks", "0 AS successes", "0 AS enqueued")
    found = blind_spot(p, stats, "hybrid", "r1", "e.com").unionByName(blind_spot(p, stats, "raw_only", "r1", "e.com"))
    return found.select("url", "issue_code", "severity", F.get_json_object("evidence", "$.shell_like_pages").cast("long").alias("shells"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) - 6 AS first_day, CAST(o_orderdate AS DATE) AS last_day FROM orders")
def date_windows(spark, d):
    first, last = C.date_window(7, F.col("o_orderdate"))
    return t(spark, d, "orders").select("o_orderkey", first.alias("first_day"), last.alias("last_day"))


@query("SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-06-01' - ts) / 86400) AS BIGINT) AS age, (CASE WHEN event_id % 3 = 0 THEN event_id % 50 WHEN event_id % 3 = 1 THEN 60 END)::DOUBLE AS wait FROM events")
def stamps(spark, d):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    after = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 50).cast("string")).when(F.col("event_id") % 3 == 1, F.lit("Mon, 01 Jan 2024 00:01:00 GMT")).otherwise("soon")
    made = C.lastmod(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return t(spark, d, "events").select("event_id", C.age_days(made, F.lit("2024-06-01").cast("timestamp")).alias("age"), F.when(F.col("event_id") % 3 < 2, C.retry_after_seconds(after, now)).alias("wait"))


_LIST = "CASE event_id % 4 WHEN 0 THEN '[\" a\", \"b\", \"a\", \"\"]' WHEN 1 THEN 'no list' WHEN 2 THEN '[]' ELSE '[\"c\"]' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 3 THEN 'c' ELSE '' END AS items, CAST(round_even(value, 0) AS INTEGER) AS whole, CAST(least(60, greatest(10, value)) AS DOUBLE) AS clamped, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS INTEGER) ELSE -1 END AS parsed FROM events")
def cleaned_values(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).otherwise("x1")
    return t(spark, d, "events").select("event_id", F.array_join(C.json_strings(F.expr(_LIST)), ",").alias("items"), C.half_even(F.col("value")).alias("whole"), C.clamp(F.col("value"), 10, 60).cast("double").alias("clamped"), C.safe_int(raw, -1).alias("parsed"))


@query("SELECT event_id, 'GET /?key=***&x=' || CAST(event_id % 7 AS VARCHAR) || ' with ***' AS message FROM events")
def redacted_messages(spark, d):
    from .plans.resolution import redacted

    return t(spark, d, "events").select("event_id", redacted(F.concat(F.lit("GET /?key=abc"), (F.col("event_id") % 9).cast("string"), F.lit("&x="), (F.col("event_id") % 7).cast("string"), F.lit(" with s3cret")), ["s3cret", ""]).alias("message"))


@query("SELECT page_id, lower(regexp_extract(url, '//([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), ''), '/') || '?' || CASE WHEN list_contains(k, 'page') THEN 'page' ELSE array_to_string(k, ',') END AS cluster FROM (SELECT page_id, url, list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: lower(string_split(x, '=')[1])), lambda x: x <> ''))) AS k FROM pages)")
def url_clusters(spark, d):
    return t(spark, d, "pages").select("page_id", C.cluster_key(F.col("url"), ["page"]).alias("cluster"))


# --- images, sitemaps ---------------------------------------------------------------------------------------------------

_IMAGES = "CASE WHEN page_id % 2 = 0 THEN '<h2>x</h2>' ELSE '' END || repeat('<img src=\"/a/red-door.png\" alt=\"A red door\" width=\"1600\">', CAST(page_id % 3 AS INT)) || repeat('<img src=\"/photo1.bmp\">', CAST(page_id % 4 AS INT))"


@query(f"""WITH c AS (SELECT page_id, page_id % 3 AS a, page_id % 4 AS b, page_id % 3 + page_id % 4 AS n FROM ({SITE}))
SELECT page_id, CAST(n AS INTEGER) AS images, round(CASE WHEN n = 0 THEN 1 ELSE a / n END, 6) AS alt_coverage, CAST(CASE WHEN n = 0 THEN 70 ELSE round_even((a / n) * 25.0 + (a / n) * 10.0 + (a / n) * 20.0 + (a / n) * 15.0 + (CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END) * 10.0 + (a / n) * 10.0 + ((CASE WHEN a > 1 THEN a ELSE 0 END + CASE WHEN b > 1 THEN b ELSE 0 END) / n) * 10.0, 0) END AS INTEGER) AS discoverability FROM c""")
def image_discoverability(spark, d):
    from .sources.html import extract, image_scores

    p = site(spark, d).select("page_id", F.col("normalized_url").alias("url"), F.expr(_IMAGES).alias("html"))
    return image_scores(extract(p, "page_id", "url", "html"), "page_id").select("page_id", "images", r6(F.col("alt_coverage")).alias("alt_coverage"), "discoverability")


def _entries(spark, d):
    """Every second page in sitemaps, a few URLs of other hosts, stamps of two years."""
    p = site(spark, d)
    lang = F.array(F.struct(F.lit("DE").alias("lang"), F.concat(F.lit("https://www.e.com/de/"), F.col("page_id") % 3).alias("href")))
    url = F.when(F.col("page_id") % 20 == 0, F.concat(F.lit("https://other.org/"), F.col("page_id"))).otherwise(F.col("normalized_url"))
    stamp = F.when(F.col("page_id") % 6 == 0, "2022-01-01").when(F.col("page_id") % 6 == 2, "2025-12-01").otherwise("")
    image = F.array(F.struct(F.lit("x.png").alias("loc")))
    entries = p.where("page_id % 2 = 0").select(F.lit("url").alias("entry_kind"), url.alias("url"), stamp.alias("lastmod"), F.when(F.col("page_id") % 4 == 0, image).otherwise(F.array_remove(image, image[0])).alias("images"), F.array_remove(image, image[0]).alias("videos"), lang.alias("hreflang"))
    pages = p.select("normalized_url", "status_code", (F.col("page_id") % 3).cast("int").alias("image_count"), F.array_remove(image, image[0]).alias("videos"), F.when(F.col("page_id") % 5 == 0, lang).otherwise(F.slice(lang, 1, 0)).alias("hreflang"))
    return entries, pages


_ENTRIES = "SELECT page_id, CASE WHEN page_id % 20 = 0 THEN 'https://other.org/' || CAST(page_id AS STRING) ELSE normalized_url END AS url FROM p WHERE page_id % 2 = 0"


@query(f"""WITH p AS ({SITE}), e AS ({_ENTRIES}), w AS (SELECT * FROM p WHERE status_code BETWEEN 200 AND 399), h AS (SELECT url, 'de' AS lang, 'https://www.e.com/de/' || CAST(page_id % 3 AS STRING) AS href FROM e), g AS (SELECT normalized_url AS url, 'de' AS lang, 'https://www.e.com/de/' || CAST(page_id % 3 AS STRING) AS href FROM w WHERE page_id % 5 = 0)
SELECT (SELECT count(DISTINCT url) FROM e) AS sitemap_urls, (SELECT count(*) FROM e WHERE page_id % 6 = 4) AS missing_lastmod, (SELECT count(*) FROM e WHERE page_id % 6 = 0) AS stale_lastmod, CAST((SELECT count(*) FROM e WHERE page_id % 4 = 0) AS BIGINT) AS sitemap_images, (SELECT count(DISTINCT normalized_url) FROM w) AS discovered_urls,
(SELECT count(*) FROM (SELECT url FROM e EXCEPT SELECT normalized_url FROM w)) AS not_crawled, (SELECT count(*) FROM (SELECT normalized_url FROM w EXCEPT SELECT url FROM e)) AS not_in_sitemap, CAST((SELECT sum(page_id % 3) FROM w) AS BIGINT) AS page_images, (SELECT count(*) FROM e WHERE page_id % 20 = 0) AS scope_violations,
(SELECT count(*) FROM (SELECT DISTINCT * FROM h)) AS sitemap_hreflang_pairs, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS page_hreflang_pairs, (SELECT count(*) FROM (SELECT * FROM h EXCEPT SELECT * FROM g)) AS hreflang_mismatches""")
def sitemap_measures(spark, d):
    from .sources.sitemaps import measures

    entries, pages = _entries(spark, d)
    return measures(entries, pages, "www.e.com", "2026-01-01").drop("sitemap_videos", "page_videos")


@query(f"WITH p AS ({SITE}), e AS ({_ENTRIES}) SELECT url, 'de' AS lang, 'https://www.e.com/de/' || CAST(page_id % 3 AS STRING) AS href FROM e EXCEPT SELECT normalized_url, 'de', 'https://www.e.com/de/' || CAST(page_id % 3 AS STRING) FROM p WHERE page_id % 5 = 0")
def hreflang_difference(spark, d):
    from .sources.sitemaps import hreflang_mismatches

    return hreflang_mismatches(*_entries(spark, d))


@query(f"WITH p AS ({SITE}), e AS ({_ENTRIES}) SELECT CASE WHEN page_id % 20 = 0 THEN 'other' WHEN page_id % 8 = 0 THEN 'home' ELSE 'other' END AS bucket, 'image' AS extension, count(*) AS n FROM e WHERE page_id % 4 = 0 GROUP BY 1")
def sitemap_extensions(spark, d):
    from .sources.sitemaps import extension_coverage

    return extension_coverage(_entries(spark, d)[0])


# --- report, classes, spellings -----------------------------------------------------------------------------------------


def _section(spark, d, name):
    from .plans.report import sections

    p, i, s = _site_tables(spark, d)
    return sections(p, i.withColumn("confidence", F.col("priority_score")), s)[name]


@query(f"SELECT count(*) AS pages, count(*) FILTER (WHERE {WORKS}) AS actionable, count(*) FILTER (WHERE is_noindex = 1) AS noindex, round(avg(word_count), 2) AS avg_words, count(DISTINCT 0) AS communities, 0::BIGINT AS bridges FROM ({SITE})")
def report_totals(spark, d):
    return _section(spark, d, "Totals")


@query(f"WITH p AS ({SITE}), s AS ({_SCORES}) SELECT round(avg(overall_score), 2) AS average, CAST(trunc(quantile_cont(overall_score, 0.5)) AS INTEGER) AS median, min(overall_score) AS minimum, max(overall_score) AS maximum FROM s")
def report_scores(spark, d):
    return _section(spark, d, "Scores")


@query(f"WITH p AS ({SITE}), i AS ({_ISSUES}) SELECT CASE WHEN priority_score >= 85 THEN 'high' WHEN priority_score >= 70 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM i GROUP BY 1")
def report_confidence(spark, d):
    return _section(spark, d, "Confidence")


@query(f"WITH p AS ({SITE}), i AS ({_ISSUES}) SELECT issue_code, array_to_string(list_sort(list(url)), ' ') AS urls FROM (SELECT issue_code, url, row_number() OVER (PARTITION BY issue_code ORDER BY url) AS r FROM (SELECT DISTINCT issue_code, url FROM i)) WHERE r <= 3 GROUP BY issue_code")
def report_examples(spark, d):
    return _section(spark, d, "Examples")


@query(f"WITH p AS ({SITE}), i AS ({_ISSUES}) SELECT priority_score, severity, issue_code, url FROM i ORDER BY priority_score DESC, url, issue_code LIMIT 10")
def report_priorities(spark, d):
    return _section(spark, d, "Highest priority")


@query(f"WITH p AS ({SITE}) SELECT count(*) FILTER (WHERE has_nosnippet_directive = 1) AS nosnippet, CAST(sum(data_nosnippet_count) AS BIGINT) AS marked, count(*) FILTER (WHERE {RESTRICTION} >= 4) AS restrictive, count(*) FILTER (WHERE NOT {ELIGIBLE}) AS not_eligible FROM p")
def report_snippets(spark, d):
    return _section(spark, d, "Snippet controls")


@query(f"SELECT normalized_url, render_gap_score FROM ({SITE}) WHERE render_gap_score > 0 ORDER BY render_gap_score DESC, normalized_url LIMIT 10")
def report_render_gaps(spark, d):
    return _section(spark, d, "Render gaps")


@query(f"WITH p AS ({SITE}), t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://e.com/robots.txt' WHEN 1 THEN 'https://e.com/a/Sitemap.xml' WHEN 2 THEN 'https://e.com/x.xml?y=1' WHEN 3 THEN 'https://e.com/xml/' ELSE normalized_url END AS url, {WORKS} AS works FROM p) SELECT page_id, page_id % 5 IN (0, 1, 2) AS is_system, works AND page_id % 5 > 2 AS actionable FROM t")
def actionable_pages(spark, d):
    from .plans import policy as P

    made = F.expr("CASE page_id % 5 WHEN 0 THEN 'https://e.com/robots.txt' WHEN 1 THEN 'https://e.com/a/Sitemap.xml' WHEN 2 THEN 'https://e.com/x.xml?y=1' WHEN 3 THEN 'https://e.com/xml/' ELSE normalized_url END")
    p = P.completed(site(spark, d).withColumn("normalized_url", made))
    return p.select("page_id", P.is_system(F.col("normalized_url")).alias("is_system"), P.actionable().alias("actionable"))


@query("SELECT arg_max(run, (o_orderdate, run)) AS run_id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS run, o_orderdate FROM orders)")
def latest_run(spark, d):
    from .plans.insights import newest_run

    runs = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return spark.createDataFrame([(newest_run(runs),)], "run_id string")


@query(f"SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'homepage' WHEN 1 THEN 'service' WHEN 3 THEN 'article' WHEN 4 THEN 'utility' WHEN 6 THEN 'location' ELSE 'other' END AS page_type, CASE page_id % 8 WHEN 0 THEN 98 WHEN 1 THEN 95 WHEN 3 THEN 95 WHEN 4 THEN 95 WHEN 6 THEN 95 ELSE 35 END AS confidence FROM ({SITE})")
def page_classes(spark, d):
    from .functions.classify import classify

    return site(spark, d).select("page_id", classify(F.col("normalized_url"), F.col("title"), F.col("h1")).alias("c")).select("page_id", "c.page_type", "c.confidence")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_ ]', ' ', 'g') AS text FROM documents)")
def text_words(spark, d):
    # Texts are cut to ASCII, where both engines agree on what a word is.
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9_ ]", " ")
    return t(spark, d, "documents").select("doc_id", F.size(C.visible_words(text)).cast("long").alias("n"), F.lower(C.squeezed(text)).alias("plain"))


@query("SELECT doc_id, sha256(md5(coalesce(text, '')) || '|page|v2') AS k FROM documents")
def artifact_keys(spark, d):
    from .streaming.state import artifact_key

    return t(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("body")).select("doc_id", artifact_key("body", "page", "v2").alias("k"))


@query("SELECT policy, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(q, '(^|&)(sort|order|view|variant)=') THEN 'canonical_candidate_duplicate' WHEN regexp_matches(q, '(^|&)(preview|amp|variant)=') THEN 'crawl_once_diagnostic' ELSE 'crawl_normally' END AS policy FROM (SELECT regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages)) GROUP BY policy")
def policy_counts(spark, d):
    from .operators.relational import top_counts

    return top_counts(t(spark, d, "pages").select(C.url_policy(F.col("url")).alias("policy")), ["policy"], None)


# --- structured data and videos, from pages written out as HTML -----------------------------------------------------------


def _marked_pages(spark, d):
    """Facts of pages whose HTML is written from the site's numbers: an article as JSON-LD, an organization or an old type as microdata, videos."""
    from .sources.html import extract

    html = """concat('<html><head><title>T</title>', if(page_id % 6 = 0, '<meta property="og:video" content="/v.mp4">', ''), '<script type="application/ld+json">{"@graph":[{"@type":"http://schema.org/Article"',
      if(page_id % 3 = 0, '', concat(',"headline":"Title ', page_id % 4, '"')), if(page_id % 2 = 0, ',"author":{"@id":"x"}', ''), if(page_id % 5 = 0, ',"datePublished":"2020"', ''), ',"image":[]}]}</script></head><body><p>See title 1 here</p>',
      CASE page_id % 3 WHEN 1 THEN concat('<div itemscope itemtype="https://schema.org/Organization"><b itemprop="name">Title <i>1</i></b>', if(page_id % 7 = 0, '<a itemprop="url" href="/o">o</a>', ''), '</div>') WHEN 2 THEN '<div itemscope itemtype="DataVocabulary"></div>' ELSE '' END,
      if(page_id % 4 = 0, '<iframe src="https://player.vimeo.com/1"></iframe>', ''), if(page_id % 5 = 0, '<video src="a.mp4"></video>', ''), '</body></html>')"""
    p = site(spark, d).select("page_id", "normalized_url", F.expr(html).alias("html"), F.expr("if(page_id % 2 = 0, 'Article', 'product')").alias("page_type"))
    return extract(p.select("page_id", "normalized_url", "html"), "page_id", "normalized_url", "html").withColumn("page_type", F.expr("if(page_id % 2 = 0, 'Article', 'product')"))


@query(f"""WITH a AS (SELECT page_id, page_id % 3 = 0 AS bare, page_id % 3 = 1 AS org, page_id % 3 = 2 AS old, 1 + CAST(page_id % 2 <> 0 AS INT) + CAST(page_id % 5 <> 0 AS INT) AS rec, 2 + CAST(page_id % 7 <> 0 AS INT) AS org_rec, CASE WHEN page_id % 2 = 0 THEN 100 ELSE 80 END AS start FROM ({SITE})),
b AS (SELECT *, CAST(NOT bare AND page_id % 4 <> 1 AS INT) AS hid FROM a),
c AS (SELECT *, greatest(0, start - CASE WHEN bare THEN 25 ELSE 0 END - 8 * rec - 10 * hid) AS f1, CASE WHEN org THEN 80 - 8 * org_rec WHEN old THEN 35 END AS f2, 100 - CASE WHEN bare THEN 15 ELSE 0 END - 5 * rec - 5 * hid - CASE WHEN org THEN 5 * org_rec WHEN old THEN 10 ELSE 0 END AS plain FROM b),
e AS (SELECT *, CAST(round_even(CASE WHEN f2 IS NULL THEN f1 ELSE (f1 + f2) / 2.0 END, 0) AS INT) AS mean FROM c)
SELECT page_id, CAST(round_even((plain + mean) / 2.0, 0) AS INT) AS score, mean AS google, CASE WHEN org THEN 'Article,Organization' WHEN old THEN 'Article,DataVocabulary' ELSE 'Article' END AS types,
CASE WHEN bare OR hid = 1 THEN CASE WHEN org THEN 'google:organization_knowledge' ELSE '' END ELSE CASE WHEN org THEN 'google:article_rich_results,google:organization_knowledge' ELSE 'google:article_rich_results' END END AS eligible,
CASE WHEN old THEN 'google:legacy_vocab' ELSE '' END AS deprecated, CASE WHEN bare THEN 'headline' ELSE '' END AS required,
array_to_string(list_filter([CASE WHEN page_id % 2 <> 0 THEN 'author' END, CASE WHEN page_id % 5 <> 0 THEN 'datePublished' END, 'image'], lambda x: x IS NOT NULL), ',') AS recommended, CASE WHEN hid = 1 THEN 'Article.headline' ELSE '' END AS hidden FROM e""")
def schema_validations(spark, d):
    from .plans.schema import validated

    feature = "google:article_rich_results"
    text = lambda c: F.concat_ws(",", F.coalesce(c, F.array().cast("array<string>")))
    out = validated(_marked_pages(spark, d), "page_id")
    return out.select("page_id", "score", F.col("engine_feature_scores")["google"].alias("google"), text(F.col("recognized_types")).alias("types"), text(F.col("eligible_features")).alias("eligible"), text(F.col("deprecated_features")).alias("deprecated"), text(F.col("missing_required_by_feature")[feature]).alias("required"), text(F.col("missing_recommended_by_feature")[feature]).alias("recommended"), text(F.col("visible_content_mismatches")).alias("hidden"))


@query(f"""WITH v AS (SELECT page_id, CAST(page_id % 4 = 0 AS INT) AS has_embed, CAST(page_id % 5 = 0 AS INT) AS has_tag, CAST(page_id % 6 = 0 AS INT) AS has_metadata FROM ({SITE}))
SELECT *, has_embed + has_tag + has_metadata AS videos, 0 AS has_schema, 0 AS has_sitemap, 25 * has_embed + 25 * has_tag + 5 * has_metadata + CASE WHEN has_embed + has_tag + has_metadata > 0 THEN 10 ELSE 0 END AS discoverability FROM v""")
def video_discoverability(spark, d):
    from .sources.html import video_scores

    return video_scores(_marked_pages(spark, d), "page_id")
