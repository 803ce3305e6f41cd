"""Scalar functions as column expressions: URLs, text, numbers, JSON, directives."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid"]
BINARY = ["jpg", "jpeg", "png", "gif", "svg", "pdf", "zip", "ico", "webp"]


# --- URLs -------------------------------------------------------------------------------------------------------------


def normalize_one(url: str | None, base: str | None = None, prefer_https: bool = True) -> str | None:
    """A URL in one spelling: resolved, lower-case scheme and host, no default port, slashes and quoting uniform, no tracking parameters, parameters sorted, no fragment."""
    from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

    if url is None:
        return None
    try:
        parts = urlsplit(urljoin(base, url) if base else url)
        port = parts.port
    except ValueError:
        return None
    from_base = urlsplit(base).scheme.lower() if base else ""
    scheme = parts.scheme.lower() or from_base or ("https" if prefer_https else "http")
    if scheme == "http" and prefer_https and from_base == "https":
        scheme = "https"
    host = (parts.hostname or "").lower()
    if port and port != {"https": 443, "http": 80}.get(scheme):
        host = f"{host}:{port}"
    segments = [s for i, s in enumerate((parts.path or "/").split("/")) if s or i == 0]
    path = "/".join(segments) or "/"
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING)
    return urlunsplit((scheme, host, quote(unquote(path), safe="/:@!$&'()*+,;=-._~"), urlencode(kept), ""))


@F.pandas_udf(StringType())
def normalize_url(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """normalize_one over batches, each distinct URL once."""
    for s in urls:
        yield s.map({u: normalize_one(u) for u in s.unique() if u is not None})


@F.pandas_udf(StringType())
def resolve_url(urls: pd.Series, bases: pd.Series) -> pd.Series:
    """A link as seen on a page of URL base."""
    return pd.Series([None if u is None else normalize_one(u, b) for u, b in zip(urls, bases, strict=True)], dtype=object)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """The path of an absolute URL, `/` where it is empty."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def first_segment(url: Column) -> Column:
    """The first segment of the path in lower case; empty for the root."""
    return F.lower(F.regexp_extract(path(url), r"^/*([^/]*)", 1))


def apex(hosts: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(hosts)), r"^www\.", "")


def in_scope(hosts: Column, root: str, mode: str = "apex_www", allowed: Sequence[str] = (), redirect_host: str = "") -> Column:
    """Whether a host counts as internal: the root alone, with its apex and www, all below the apex too, or with a list; a host that the homepage redirects to always does."""
    root = root.strip().lower()
    bare = root.removeprefix("www.")
    named = {root} if mode == "host_only" else {root, bare, f"www.{bare}"}
    if mode == "custom_allowlist":
        named |= {re.sub(r"^[a-z][a-z0-9+.-]*://|[/?#:].*$", "", a.strip().lower()) for a in allowed} - {""}
    if redirect_host:
        named.add(redirect_host.strip().lower())
    inside = hosts.isin(*sorted(named))
    return inside | hosts.endswith("." + bare) if mode == "all_subdomains" else inside


def reversed_labels(domain: Column) -> Column:
    """Labels of a domain in reverse order, blanks left out; its own inverse."""
    return F.array_join(F.reverse(F.filter(F.split(F.lower(F.trim(domain)), r"\."), lambda x: x != "")), ".")


def domain_of(raw: Column) -> Column:
    """Bare host of a domain or URL: lower case, no port, no trailing dot, no www."""
    token = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    absolute = F.when(token.contains("://"), token).otherwise(F.concat(F.lit("https://"), token))
    return apex(F.regexp_replace(host(absolute), r"\.+$", ""))


def query_pairs(url: Column) -> Column:
    """`key=value` parts of the query that are not empty."""
    return F.filter(F.split(query(url), "&"), lambda x: x != "")


def query_keys(url: Column) -> Column:
    """Distinct keys in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(query_pairs(url), lambda p: F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1))))), lambda k: k != "")))


def binary_asset(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(BINARY) + ")$")


# Parameters by what is done with them, and labels of the classes.
POLICY_KEYS = {
    "action": ["add-to-cart", "add_to_cart", "replytocom", "session", "sessionid", "token", "auth", "nonce"],
    "headers_only": ["download", "export", "format"],
    "diagnostic": ["preview", "amp", "variant"],
    "canonical": ["sort", "order", "view", "variant"],
    "faceted": ["facet", "filter", "filters", "sort", "brand", "color", "size", "price", "min", "max", "category", "categories", "q", "query"],
}
POLICY_CLASSES = {"action": "never_enqueue", "headers_only": "fetch_headers_only", "diagnostic": "crawl_once_diagnostic", "canonical": "canonical_candidate_duplicate"}


def url_policy(url: Column, keys: dict[str, Sequence[str]] | None = None, faceted_least: int = 2) -> Column:
    """Crawl class of a URL by its parameters: the first kind that it has a key of."""
    kinds = {**POLICY_KEYS, **(keys or {})}
    found = query_keys(url)
    out = None
    for kind, label in POLICY_CLASSES.items():
        hit = F.arrays_overlap(found, F.array(*[F.lit(k) for k in kinds[kind]]))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    facet = F.arrays_overlap(found, F.array(*[F.lit(k) for k in kinds["faceted"]])) & (F.size(query_pairs(url)) >= faceted_least)
    return out.when(facet, "crawl_sampled").otherwise("crawl_normally")


def cluster_key(url: Column, risky: Sequence[str]) -> Column:
    """host, path and the risky keys of a URL, all keys where none is risky."""
    keys = query_keys(url)
    some = F.array_sort(F.array_intersect(keys, F.array(*[F.lit(r) for r in risky])))
    return F.concat(host(url), path(url), F.lit("?"), F.array_join(F.when(F.size(some) > 0, some).otherwise(keys), ","))


# Weights of the signals of a URL in the crawl frontier.
FRONTIER_WEIGHTS = {"template_importance": 220.0, "internal_prominence": 140.0, "demand": 120.0, "change": 100.0, "render_risk": 75.0, "platform": 60.0, "canonical_confidence": 45.0, "in_sitemap": 35.0, "freshness": 35.0, "query_risk": -130.0}
FRONTIER_DEPTH, FRONTIER_MOST = -14.0, 999.0


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def frontier_priority(signals: dict[str, Column], depth: Column) -> Column:
    """Sum of weighted signals, each within 0..1, less a cost for depth, within 0..999, to four places."""
    total = sum((unit(v) * F.lit(FRONTIER_WEIGHTS[k]) for k, v in signals.items()), F.lit(0.0))
    total = total + F.greatest(F.lit(0), depth) * F.lit(FRONTIER_DEPTH)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(FRONTIER_MOST), total)), 4)


def query_risk(url: Column, risky: Sequence[str]) -> Column:
    """0.7 times the share of risky keys plus 0.3 times the number of parameters over ten, within 0..1."""
    keys = query_keys(url)
    share = F.size(F.array_intersect(keys, F.array(*[F.lit(r) for r in risky]))) / F.greatest(F.lit(1), F.size(keys))
    count = F.least(F.lit(1.0), F.size(query_pairs(url)) / 10.0)
    return F.when(F.size(keys) == 0, 0.0).otherwise(unit(share * 0.7 + count * 0.3))


def template_bucket(url: Column) -> Column:
    s = first_segment(url)
    return F.when(s == "", "home").when(s.isin("service", "services"), "service").when(s.isin("blog", "news", "insights", "article", "articles"), "article").when(s.isin("product", "products", "location", "locations"), "commercial").otherwise("other")


# --- text -------------------------------------------------------------------------------------------------------------


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def visible_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\W+"), lambda w: w != "")


def content_hash(text: Column) -> Column:
    """sha256 of the squeezed text in lower case; empty for an empty text."""
    plain = F.lower(squeezed(text))
    return F.when(plain == "", F.lit("")).otherwise(F.sha2(plain, 256))


@F.pandas_udf(StringType())
def casefold_hash(texts: pd.Series) -> pd.Series:
    """content_hash with full case folding, for texts where lower case isn't enough."""
    import hashlib

    folded = [" ".join((t or "").split()).casefold() for t in texts]
    return pd.Series([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in folded])


def directives(raw: Column) -> Column:
    """Distinct directives of a comma-separated robots value, lower case, without blanks."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(raw, F.lit(""))), ","), lambda v: F.trim(v)), lambda x: x != ""))


def directive_value(raw: Column, name: str) -> Column:
    """The value of `name:value`, null where absent."""
    hit = F.filter(directives(raw), lambda x: x.startswith(f"{name}:"))
    return F.when(F.size(hit) > 0, F.trim(F.split_part(hit[0], F.lit(":"), F.lit(2))))


# Crawlers that a robots header may be addressed to.
KNOWN_CRAWLERS = ["*", "googlebot", "googlebot-news", "bingbot", "oai-searchbot", "gptbot", "oai-adsbot", "chatgpt-user", "google-extended"]
IMAGE_PREVIEWS = ["none", "standard", "large"]


def applied_directives(robots: Column, scoped: Column, headers: Column, crawler: str) -> Column:
    """Sorted distinct directives that hold for a crawler. robots, scoped: arrays of meta values for all and for it; headers: array of robots headers.

    A header may begin with a crawler's name and a colon; it then holds for that crawler alone.
    """
    crawler, none = crawler.strip().lower(), F.array().cast("array<string>")
    clean = lambda a: F.filter(F.transform(F.coalesce(a, none), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    left = lambda v: F.lower(F.trim(F.substring_index(v, ":", 1)))
    addressed = lambda v: v.contains(":") & (left(v).isin(KNOWN_CRAWLERS) | left(v).endswith("bot") | left(v).endswith("bot-news"))
    rest = lambda v: F.trim(F.regexp_replace(v, r"^[^:]*:", ""))
    mine = F.transform(F.filter(clean(headers), lambda v: addressed(v) & (left(v) == crawler)), rest)
    parts = [clean(robots), clean(scoped) if crawler not in ("", "generic", "robots", "*") else none, F.filter(clean(headers), lambda v: ~addressed(v)), mine]
    tokens = F.flatten(F.transform(F.concat(*parts), lambda v: F.transform(F.split(F.lower(v), ","), lambda x: F.trim(x))))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x != "")))


def strictest_preview(applied: Column) -> Column:
    """The strictest image preview among directives; the first other value if none is known, empty without any."""
    values = F.transform(F.filter(applied, lambda x: x.startswith("max-image-preview:")), lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    ranked = F.filter(F.array(*map(F.lit, IMAGE_PREVIEWS)), lambda v: F.array_contains(values, v))
    return F.coalesce(F.get(ranked, 0), F.get(values, 0), F.lit(""))


def date_window(days: int, today: Column | None = None) -> tuple[Column, Column]:
    """First and last day of a window of so many days, one at least, that ends today."""
    end = F.current_date() if today is None else today.cast("date")
    return F.date_sub(end, max(1, days) - 1), end


def strictest_number(raw: Column, name: str) -> Column:
    """The least non-negative number given for a directive (-1 means no limit); -1 if only that is given."""
    numbers = F.filter(F.transform(F.filter(directives(raw), lambda x: x.startswith(f"{name}:")), lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(2))).try_cast("int")), lambda v: v.isNotNull())
    limits = F.filter(numbers, lambda v: v >= 0)
    return F.when(F.size(limits) > 0, F.array_min(limits)).otherwise(F.array_max(numbers))


# --- numbers ----------------------------------------------------------------------------------------------------------


def clamp(value: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def safe_int(raw: Column, default: int | None = None) -> Column:
    value = F.trim(raw.cast("string")).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def safe_float(raw: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(raw.cast("string")).try_cast("double"), F.lit(default))


def half_even(value: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.bround(value, 0).cast("int")


def python_round(value: float, places: int = 0) -> float:
    return round(value, places) if math.isfinite(value) else value


# --- dates ------------------------------------------------------------------------------------------------------------


def lastmod(raw: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(raw), F.lit("")))


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days from ts to as_of, rounded down; fractions of a second count."""
    micros = F.unix_micros(as_of) - F.unix_micros(ts)
    return F.call_function("div", micros - F.pmod(micros, F.lit(86_400_000_000)), F.lit(86_400_000_000))


def retry_after_seconds(raw: Column, now: Column) -> Column:
    """Seconds to wait: a number, or an HTTP date less now, not below 0."""
    date = F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(F.trim(raw).try_cast("double"), (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.greatest(F.lit(0.0), seconds)


# --- JSON -------------------------------------------------------------------------------------------------------------


def json_strings(raw: Column) -> Column:
    """A JSON list of strings, empty for anything else; blanks dropped, first occurrences in order."""
    parsed = F.from_json(F.coalesce(raw, F.lit("")), "array<string>")
    return F.array_distinct(F.filter(F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda x: x != ""))


def json_value(raw: Column, json_path: str, kind: str) -> Column:
    """A value at a path, null where the text is no JSON or the value is of another kind."""
    return F.try_variant_get(F.try_parse_json(raw), json_path, kind)
