"""Differences between two versions of rows, one row for each family of facts that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import latest_per_key

# Families of a page's facts with their severity.
FAMILIES = {
    "title": "medium",
    "meta_description": "low",
    "canonical": "medium",
    "robots_directives": "high",
    "headings": "low",
    "schema_types": "medium",
    "internal_links": "low",
    "primary_content_hash": "medium",
    "raw_content_hash": "low",
    "rendered_content_hash": "low",
    "media_inventory": "low",
    "structured_data_eligibility_shifts": "medium",
}


def unpivot_diffs(current: DataFrame, previous: DataFrame, keys: Sequence[str], families: dict[str, tuple[str, Column]]) -> DataFrame:
    """keys, family, old_value, new_value, severity of what differs; rows without a previous version give none.

    families: name -> (severity, expression over either side). Both sides are reduced to the signatures before the join.
    """
    sides = [f.select(*keys, F.struct(*[F.coalesce(e.cast("string"), F.lit("")).alias(n) for n, (_, e) in families.items()]).alias(side)) for side, f in (("new", current), ("old", previous))]
    joined = sides[0].join(sides[1], list(keys))
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.col(f"old.`{n}`").alias("old_value"), F.col(f"new.`{n}`").alias("new_value"), F.lit(s).alias("severity")) for n, (s, _) in families.items()])
    return joined.select(*keys, F.explode(F.filter(rows, lambda r: r["old_value"] != r["new_value"])).alias("d")).select(*keys, "d.*")


def page_families() -> dict[str, tuple[str, Column]]:
    """The signatures of pages. Lists are compared sorted, so that order alone is no change."""
    def sorted_list(c: str) -> Column:
        return F.to_json(F.array_sort(F.array_distinct(F.from_json(F.coalesce(F.col(c), F.lit("[]")), "array<string>"))))

    def effective(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))

    media = F.concat_ws("|", F.col("image_count").cast("string"), F.sha2(F.coalesce("image_details_json", F.lit("")), 256), F.sha2(F.coalesce("video_details_json", F.lit("")), 256))
    signatures = {
        "title": effective("effective_title", "title"),
        "meta_description": effective("effective_meta_description", "meta_description"),
        "canonical": effective("effective_canonical", "canonical_url"),
        "robots_directives": F.col("effective_robots_json"),
        "headings": F.concat_ws("|", "h1", F.col("h1_count").cast("string"), "heading_outline_json"),
        "schema_types": sorted_list("schema_types_json"),
        "internal_links": F.concat_ws("|", F.col("effective_internal_links_out").cast("string"), sorted_list("effective_links_json")),
        "primary_content_hash": effective("effective_content_hash", "content_hash"),
        "raw_content_hash": F.col("raw_content_hash"),
        "rendered_content_hash": F.col("rendered_content_hash"),
        "media_inventory": media,
        "structured_data_eligibility_shifts": F.coalesce(F.to_json(F.from_json("schema_validation_json", "struct<eligible_features:array<string>,missing_required_by_feature:map<string,array<string>>>")), F.lit("")),
    }
    return {n: (FAMILIES[n], s) for n, s in signatures.items()}


def page_diffs(pages: DataFrame, run_id: str, key: str = "normalized_url", seq: str = "page_id") -> DataFrame:
    """Differences of a run's pages to the latest version of the same page in other runs."""
    current = pages.where(F.col("run_id") == run_id)
    previous = latest_per_key(pages.where(F.col("run_id") != run_id), [key], [seq])
    needed = ["effective_title", "effective_meta_description", "effective_canonical", "effective_content_hash", "rendered_content_hash", "raw_content_hash"]
    fill = lambda f: f.withColumns({c: F.lit("") for c in needed if c not in f.columns})
    return unpivot_diffs(fill(current), fill(previous), [key], page_families())
