"""Joins over a domain graph: vertices, ranks and edges in separate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import reversed_labels
from .relational import bucketed, small

# Places in the ranking up to which a bucket goes, from the last to the first; weights of a referrer.
RANK_BUCKETS = [(50, "top_100"), (25, "top_50"), (10, "top_25"), (0, "top_10")]
CENTRALITY_WEIGHT, PAGERANK_WEIGHT = 1000.0, 1_000_000.0


def rank_rows(vertices: DataFrame, ranks: DataFrame, domains: list[str]) -> DataFrame:
    """Vertices of the given names with their ranks, null where they have none."""
    return vertices.where(F.col("domain").isin(domains)).join(ranks, "id", "left")


def _best() -> list[Column]:
    """Centrality, then pagerank, then hosts, missing ones as 0, then name."""
    return [F.coalesce("harmonic_centrality", F.lit(0.0)).desc(), F.coalesce("pagerank", F.lit(0.0)).desc(), F.coalesce("num_hosts", F.lit(0)).desc(), F.col("domain")]


def linking(edges: DataFrame, targets: DataFrame, vertices: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """Distinct sources that link to any of the targets (target_id), the best `limit` of them.

    Targets are counted before they are broadcast, so that few of them don't shuffle the edges; sources alone are
    shuffled to their vertices and ranks.
    """
    sources = edges.join(small(targets.select("target_id").distinct()), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    rows = sources.join(vertices, "id").join(ranks, "id", "left").select("domain", "num_hosts", "harmonic_centrality", "pagerank").distinct()
    return rows.orderBy(*_best()).limit(limit)


def linking_domains(edges: DataFrame, vertices: DataFrame, ranks: DataFrame, domain: str, limit: int) -> DataFrame:
    """linking() to the vertices of one name."""
    return linking(edges, vertices.where(F.col("domain") == domain).select(F.col("id").alias("target_id")), vertices, ranks, limit)


def rank_buckets(rows: DataFrame) -> DataFrame:
    """Adds place (from 0) and rank_bucket to a ranking that is already cut to a few rows."""
    placed = rows.withColumn("place", (F.row_number().over(Window.orderBy(*_best())) - 1).cast("long"))
    return placed.withColumn("rank_bucket", bucketed(F.col("place"), RANK_BUCKETS, "top_100"))


def referrer_aggregates(rows: DataFrame) -> DataFrame:
    """referring, weighted_score, averages of centrality and pagerank, and the largest referrer's share; null where there is none."""
    weight = F.coalesce("harmonic_centrality", F.lit(0.0)) * CENTRALITY_WEIGHT + F.coalesce("pagerank", F.lit(0.0)) * PAGERANK_WEIGHT
    total = F.sum(weight)
    return rows.agg(
        F.count("*").alias("referring"),
        F.when(total > 0, total).alias("weighted_score"),
        F.avg("harmonic_centrality").alias("avg_harmonic"),
        F.avg("pagerank").alias("avg_pagerank"),
        F.when(total > 0, F.max(weight) / total).alias("top_concentration"),
    )


def rank_gaps(vertices: DataFrame, ranks: DataFrame, target: str, others: list[str]) -> DataFrame:
    """Each other domain's ranks less the target's; the target is one row."""
    rows = rank_rows(vertices, ranks, [target, *others])
    own = rows.groupBy().agg(F.max(F.when(F.col("domain") == target, F.col("harmonic_centrality"))).alias("h"), F.max(F.when(F.col("domain") == target, F.col("pagerank"))).alias("p")).first()
    gap = lambda c, v: (F.col(c) - F.lit(v).cast("double")).alias(f"{c}_gap")
    return rows.where(F.col("domain") != target).select(reversed_labels(F.col("domain")).alias("name"), "harmonic_centrality", "pagerank", gap("harmonic_centrality", own["h"]), gap("pagerank", own["p"]))
