"""Page type from URL, title, heading and schema types: points for each type, the best one if it leads clearly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import first_segment, path

# Types in order, with the first path segments and words that speak for them, and their points.
SEGMENTS = {
    "contact": (4, ["contact", "contact-us", "book", "support"]),
    "about": (4, ["about", "company", "team", "story"]),
    "legal": (5, ["privacy", "terms", "legal", "cookie", "compliance"]),
    "article": (4, ["blog", "news", "article", "insights", "resources"]),
    "service": (4, ["service", "services", "solution", "solutions", "capabilities"]),
    "industry": (4, ["industry", "industries", "sector", "sectors", "verticals"]),
    "location": (4, ["location", "locations", "near", "area", "city"]),
    "utility": (5, ["wp-admin", "login", "signin", "search", "tag", "category", "feed", "cart", "checkout", "account"]),
}
WORDS = {
    "contact": (2, "contact|get in touch|call us|support"),
    "about": (2, "about|our story|our team|who we are"),
    "legal": (3, "privacy|terms|cookie|legal|gdpr"),
    "article": (2, "article|insight|news|blog"),
    "service": (2, "service|services|what we do|solution"),
    "industry": (2, "industry|industries|sector|vertical"),
    "location": (2, "location|near me|city|state|area"),
}
SCHEMA_ENDS = {"article": ["article", "blogposting"], "service": ["service"], "location": ["localbusiness"], "contact": ["contactpage"], "about": ["aboutpage"]}


def _ends_with(ends: list[str]) -> Callable[[Column], Column]:
    pattern = f"({'|'.join(ends)})$"
    return lambda k: k.rlike(pattern)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it, in branches too."""
    return F.transform(F.array(value), use)[0]


def _ranked(page: Column, by_schema: bool) -> Column:
    """Types as structs of negative points, place and name, the best first."""
    scores = []
    for i, (kind, (points, names)) in enumerate(SEGMENTS.items()):
        score = F.when(page["segment"].isin(names), points).otherwise(0)
        if kind in WORDS:
            score = score + F.when(page["text"].rlike(rf"\b({WORDS[kind][1]})\b"), WORDS[kind][0]).otherwise(0)
        if kind == "article":
            score = score + F.when(page["where"].rlike(r"\b20\d{2}\b"), 1).otherwise(0)
        if by_schema and kind in SCHEMA_ENDS:
            score = score + F.when(F.exists(page["kinds"], _ends_with(SCHEMA_ENDS[kind])), 2).otherwise(0)
        scores.append(F.struct((-score).alias("minus"), F.lit(i).alias("at"), F.lit(kind).alias("kind")))
    return F.sort_array(F.array(*scores))


def _outcome(page: Column) -> Column:
    """struct(page_type, confidence) from where and ranked."""
    first, second = page["ranked"][0], page["ranked"][1]
    top, margin, kind = -first["minus"], second["minus"] - first["minus"], first["kind"]
    confidence = F.least(F.lit(95), F.lit(45) + top * 8 + F.greatest(F.lit(0), margin - 1) * 5)
    as_is = lambda t, c: F.struct(F.lit(t).alias("page_type") if isinstance(t, str) else t.alias("page_type"), c.cast("int").alias("confidence"))
    return (
        F.when(page["where"] == "", as_is("homepage", F.lit(98)))
        .when(top < 3, as_is("other", F.lit(35)))
        .when((margin <= 1) & ~kind.isin("legal", "utility"), as_is("other", F.lit(45)))
        .when((confidence < 60) & kind.isin("article", "service", "industry", "location"), as_is("other", confidence))
        .otherwise(as_is(kind, F.greatest(F.lit(30), confidence)))
    )


def classify(url: Column, title: Column, h1: Column, schema_types: Column | None = None) -> Column:
    """struct(page_type, confidence). Types that tie keep the order above; a type that leads by one point or less is `other`, but for legal and utility."""
    where = F.regexp_replace(F.lower(path(url)), "^/+|/+$", "")
    parts = [where.alias("where"), first_segment(url).alias("segment"), F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(h1, F.lit("")), where)).alias("text")]
    if schema_types is not None:
        parts.append(F.transform(schema_types, lambda v: F.lower(v)).alias("kinds"))
    ranked = _bound(F.struct(*parts), lambda page: F.struct(page["where"].alias("where"), _ranked(page, schema_types is not None).alias("ranked")))
    return _bound(ranked, _outcome)
