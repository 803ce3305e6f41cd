"""Structured data against a registry of search features: what is eligible, what is missing, and a score.

A page's nodes and the registry's rules, a short list of constants, meet within the page's own row: no join and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_even

# Engine, type, feature, status, required fields, recommended fields, fields that the page must show, page types.
REGISTRY = [
    ("google", "Article", "article_rich_results", "supported", ["headline"], ["author", "datePublished", "image"], ["headline"], ["article", "blog", "homepage", "other"]),
    ("google", "BlogPosting", "article_rich_results", "supported", ["headline"], ["author", "datePublished", "image"], ["headline"], ["article", "blog", "homepage", "other"]),
    ("google", "Product", "product_rich_results", "supported", ["name"], ["offers", "image", "brand"], ["name"], ["product", "service", "location", "other"]),
    ("google", "LocalBusiness", "local_business_knowledge", "supported", ["name", "address"], ["telephone", "url", "openingHoursSpecification"], ["name"], ["homepage", "location", "service", "contact"]),
    ("google", "VideoObject", "video_rich_results", "supported", ["name", "thumbnailUrl"], ["uploadDate", "description", "embedUrl", "contentUrl"], ["name"], ["article", "blog", "other"]),
    ("google", "Organization", "organization_knowledge", "limited", ["name"], ["url", "sameAs", "logo"], ["name"], ["homepage", "about", "contact", "other"]),
    ("google", "WebPage", "webpage_markup", "other_surface_only", ["name"], ["description"], ["name"], ["homepage", "other"]),
    ("google", "DataVocabulary", "legacy_vocab", "deprecated", [], [], [], ["other"]),
]
# Points of the page's score for each fault (of one, at most) and of a feature's score; the most that a status allows.
DEPRECATED = 10
FAULTS = {"required": (15, 45), "recommended": (5, 20), "hidden": (5, 15)}
FEATURE_FAULTS = {"required": 25, "recommended": 8, "hidden": 10}
STATUS_MOST = {"deprecated": 35, "limited": 85, "non_search": 70, "other_surface_only": 70}
OTHER_PAGE_MOST = 80


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _match(rule: tuple, fields: Column, page_type: Column, shown: Column) -> Column:
    """What a node with these fields comes to under a rule."""
    engine, type_, feature, status, required, recommended, visible, page_types = rule
    missing = lambda names: F.filter(_words(names), lambda n: ~F.map_contains_key(fields, n))
    is_hidden = lambda n: (F.coalesce(fields[n], F.lit("")) != "") & (shown != "") & ~F.contains(shown, F.lower(fields[n]))
    return F.struct(
        F.lit(engine).alias("engine"),
        F.lit(type_).alias("type"),
        F.lit(f"{engine}:{feature}").alias("feature"),
        F.lit(status).alias("status"),
        missing(required).alias("required"),
        missing(recommended).alias("recommended"),
        F.filter(_words(visible), is_hidden).alias("hidden"),
        (F.lit(bool(page_types)) & (page_type != "") & ~page_type.isin(page_types)).alias("other_page"),
    )


def matches(nodes: Column, page_type: Column, shown: Column, registry: list[tuple] = REGISTRY, engine: str = "google") -> Column:
    """Of each node and type with a rule: the rule's engine, type, feature and status, its missing and hidden fields. engine: `` for all."""
    page_type, shown = F.lower(F.trim(F.coalesce(page_type, F.lit("")))), F.lower(F.coalesce(shown, F.lit("")))
    rules = [r for r in registry if engine in ("", r[0])]

    def of_node(page: Column, node: Column) -> Column:
        found = lambda k: F.filter(F.array(*[F.when(F.lower(k) == r[1].lower(), _match(r, node["fields"], page["page_type"], page["shown"])) for r in rules]), lambda m: m.isNotNull())
        return F.flatten(F.transform(node["types"], found))

    # Page type and text are put in lower case once a page, not once a node.
    page = F.array(F.struct(page_type.alias("page_type"), shown.alias("shown")))
    return F.flatten(F.transform(page, lambda p: F.flatten(F.transform(nodes, lambda n: of_node(p, n)))))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, m: a + value(m))


def _feature_score(m: Column) -> Column:
    """A feature's score (0..100): a deprecated or misplaced one starts lower, faults take points, its status bounds the rest."""
    most = lambda statuses: reduce(lambda a, s: F.when(m["status"] == s, STATUS_MOST[s]).otherwise(a), statuses, F.lit(100))
    start = F.least(most(["deprecated"]), F.when(m["other_page"], OTHER_PAGE_MOST).otherwise(100))
    taken = sum((F.size(m[k]) * v for k, v in FEATURE_FAULTS.items()), F.lit(0))
    return clamp(F.least(start - taken, most(["limited", "non_search", "other_surface_only"])))


def _by_feature(found: Column, field: str) -> Column:
    """Map of features to their missing fields, both in order."""
    lacking = F.filter(found, lambda m: F.size(m[field]) > 0)
    features = F.array_sort(F.array_distinct(F.transform(lacking, lambda m: m["feature"])))
    fields = lambda k: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(lacking, lambda m: m["feature"] == k), lambda m: m[field]))))
    return F.map_from_entries(F.transform(features, lambda k: F.struct(k.alias("key"), fields(k).alias("value"))))


def validated(pages: DataFrame, key: str, nodes: str = "schema_nodes", page_type: str = "page_type", shown: str = "shown_text", registry: list[tuple] = REGISTRY, engine: str = "google") -> DataFrame:
    """key, score (0..100), recognized_types, features that are eligible, deprecated, lack fields or differ from what is shown, and the mean by engine.

    pages holds nodes as `sources.html` gives them. Null nodes are none; a page without nodes has a score of 100.
    """
    held = F.coalesce(F.col(nodes), F.array().cast(pages.schema[nodes].dataType))
    found = pages.select(key, F.array_sort(F.array_distinct(F.flatten(F.transform(held, lambda n: n["types"])))).alias("recognized_types"), matches(held, F.col(page_type), F.col(shown), registry, engine).alias("m"))
    fault = lambda m: F.when(m["status"] == "deprecated", DEPRECATED).otherwise(0) + sum((F.least(F.lit(most), F.size(m[k]) * each) for k, (each, most) in FAULTS.items()), F.lit(0))
    rated = found.withColumns({"plain": clamp(F.lit(100) - _total(F.col("m"), fault)).cast("int"), "rated": F.transform("m", lambda m: F.struct(m["engine"].alias("engine"), _feature_score(m).cast("int").alias("score")))})
    mean = lambda items: half_even(_total(items, lambda v: v) / F.size(items))
    of_engine = lambda e: mean(F.transform(F.filter("rated", lambda r: r["engine"] == e), lambda r: r["score"]))
    engines = F.array_sort(F.array_distinct(F.transform("rated", lambda r: r["engine"])))
    rated = rated.withColumn("engines", F.transform(engines, lambda e: F.struct(e.alias("engine"), of_engine(e).alias("score"))))
    blended = half_even((F.col("plain") + mean(F.transform("engines", lambda e: e["score"]))) / 2)
    kinds = lambda keep: F.transform(F.filter("m", keep), lambda m: m["feature"])
    eligible = kinds(lambda m: m["status"].isin("supported", "limited") & (F.size(m["required"]) == 0) & (F.size(m["hidden"]) == 0))
    hidden = F.flatten(F.transform("m", lambda m: F.transform(m["hidden"], lambda f: F.concat_ws(".", m["type"], f))))
    return rated.select(
        key,
        F.when(F.size("m") > 0, blended).otherwise(F.col("plain")).alias("score"),
        "recognized_types",
        eligible.alias("eligible_features"),
        kinds(lambda m: m["status"] == "deprecated").alias("deprecated_features"),
        _by_feature(F.col("m"), "required").alias("missing_required_by_feature"),
        _by_feature(F.col("m"), "recommended").alias("missing_recommended_by_feature"),
        hidden.alias("visible_content_mismatches"),
        F.map_from_entries("engines").alias("engine_feature_scores"),
    )
