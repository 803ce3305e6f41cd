"""Relational operators over any tables: joins with defaults, comparisons, duplicates, rankings, histograms.

Each takes DataFrames and column names and returns a DataFrame. Aggregates that could gather a large group are written
so that they combine before the shuffle; orders are total wherever a result depends on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 100_000


def blank_to(column: Column, default: object) -> Column:
    """A text column with null and blank replaced."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default))


def filtered(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """All conditions that are given, as one filter that reaches the scan."""
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def text_search(df: DataFrame, columns: Sequence[str], needle: str | None) -> DataFrame:
    """Rows of which any column contains the needle, in any case; % and _ in the needle keep their LIKE meaning."""
    if not needle:
        return df
    pattern = f"%{needle.strip().lower()}%"
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.lower(F.coalesce(F.col(c), F.lit(""))).like(pattern)
    return df.where(condition)


def left_with_defaults(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left outer join; columns of the right that are missing get defaults."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_match_count(left: DataFrame, right: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Number of matches in right for each row of left, 0 where none: the right is counted by key before it is joined."""
    keys = list(on.values())
    counts = right.groupBy(*keys).agg(F.count("*").alias(name)).withColumnsRenamed({r: f"__{r}" for r in keys})
    condition = [left[a] == counts[f"__{b}"] for a, b in on.items()]
    return left.join(counts, condition, "left").drop(*[f"__{r}" for r in keys]).withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def compare_values(left: DataFrame, right: DataFrame, key: str, value: str, limit: int | None = None) -> DataFrame:
    """key, left_value, right_value and delta of keys on both sides, largest change first."""
    a = left.select(key, F.col(value).alias("left_value"))
    b = right.select(key, F.col(value).alias("right_value"))
    out = a.join(b, key).withColumn("delta", F.col("right_value") - F.col("left_value"))
    if limit is None:
        return out
    return out.orderBy(F.abs("delta").desc(), F.col(key)).limit(limit)


def compare_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left_count, right_count and delta of keys on either side; one pass over both, counted together."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counted = both.groupBy(key).agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count"))
    return counted.withColumn("delta", F.col("right_count") - F.col("left_count"))


def reciprocity_missing(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    """Edges a -> b whose b is a node and that have no b -> a; self-edges are their own answer."""
    distinct = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct()
    known = distinct.join(nodes.select(F.col(node).alias("b")).distinct(), "b", "left_semi").select("a", "b")
    back = distinct.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return known.join(back, ["a", "b"], "left_anti").withColumnsRenamed({"a": source, "b": target})


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. An aggregate, so that rows are combined before the shuffle; order should be total."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_counts(df: DataFrame, keys: Sequence[str], limit: int | None, name: str = "n", seq: str | None = None) -> DataFrame:
    """Counts by keys, most first; ties by keys, or by first appearance where seq gives the order of rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias(name), *([F.min(seq).alias("__first")] if seq else []))
    ordered = counted.orderBy(F.col(name).desc(), *([F.col("__first")] if seq else [F.col(k).asc_nulls_first() for k in keys]))
    ordered = ordered.drop("__first") if seq else ordered
    return ordered if limit is None else ordered.limit(limit)


def histograms(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """facet, value, n of several text columns at once, blanks counted under each column's default: one scan, one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), blank_to(F.col(c), d).alias("value")) for c, d in columns.items()])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def bucketed(value: Column, bounds: Sequence[tuple[float, str]], other: str) -> Column:
    """The label of the first bound that the value reaches, bounds from high to low."""
    out = None
    for least, label in bounds:
        out = F.when(value >= least, label) if out is None else out.when(value >= least, label)
    return out.otherwise(other)


def top_per_group(df: DataFrame, group: Sequence[str], key: str, k: int, name: str = "n") -> DataFrame:
    """The k most frequent values of key in each group; counted before they are ranked."""
    counted = df.groupBy(*group, key).agg(F.count("*").alias(name))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(name).desc(), F.col(key)))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def duplicate_clusters(df: DataFrame, key: Column) -> DataFrame:
    """clusters and rows in them: keys that occur more than once, blanks left out."""
    counted = df.select(key.alias("__k")).where("__k IS NOT NULL AND __k <> ''").groupBy("__k").agg(F.count("*").alias("n")).where("n > 1")
    return counted.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_clusters"))


def weighted_present(weights: dict[str, float], name: str = "score") -> list[Column]:
    """Weighted mean over the columns that are present, and the percentage of weight that they have."""
    have = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c).cast("double") * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return [F.when(have > 0, total / have).alias(name), (have / sum(weights.values()) * 100).alias("coverage")]


def decayed_sums(df: DataFrame, group: Sequence[str], family: str, value: str, decay: float, name: str = "decayed") -> DataFrame:
    """Sum by group and family of values, the r-th largest weighed decay^(r - 1)."""
    rank = F.row_number().over(Window.partitionBy(*group, family).orderBy(F.col(value).desc()))
    return df.withColumn("__r", rank).groupBy(*group, family).agg(F.sum(F.col(value) * F.pow(F.lit(decay), F.col("__r") - 1)).alias(name), F.count("*").alias("n"))


def within_budget(df: DataFrame, cluster: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most k rows of each cluster, with their rank in it."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*cluster).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def change_streaks(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """changed (1 if the value differs from the one before; 1 for the first) and streak (unchanged rows in a row so far)."""
    by_key = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("changed", F.when(F.lag(value).over(by_key).eqNullSafe(F.col(value)) & (F.row_number().over(by_key) > 1), 0).otherwise(1))
    island = F.sum("changed").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("__island", island)
    streak = F.row_number().over(Window.partitionBy(key, "__island").orderBy(*order)) - 1
    return df.withColumn("streak", streak.cast("long")).drop("__island")


def tokens(df: DataFrame, column: str, separator: str = ",", blank: str = "unknown") -> DataFrame:
    """token, n: values of a separated list, trimmed; a blank list counts once as `blank`."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), separator), lambda v: F.trim(v)), lambda x: x != "")
    parts = F.when(F.size(parts) == 0, F.array(F.lit(blank))).otherwise(parts)
    return df.select(F.explode(parts).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def best_status(evidence: DataFrame, key: str, status: str, rank: str, seq: str, *carry: str) -> DataFrame:
    """The status of highest rank by key; later rows win ties."""
    return evidence.groupBy(key).agg(F.max_by(F.struct(status, *carry), F.struct(rank, seq)).alias("__s")).select(key, "__s.*")


def hash_sampled(df: DataFrame, column: str, rate: float) -> DataFrame:
    """Rows whose md5, its first 8 bytes as a fraction of 2^64, is below the rate; adds the fraction as bucket."""
    high = F.conv(F.substring(F.md5(F.col(column)), 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(F.md5(F.col(column)), 9, 8), 16, 10).cast("double")
    return df.withColumn("bucket", (high * F.lit(2.0**32) + low) / F.lit(2.0**64)).where(F.col("bucket") < rate)


def round_robin(df: DataFrame, band: str, weights: dict[str, int], order: Sequence[Column]) -> DataFrame:
    """place of each row when bands take turns, weights[b] rows of band b in each round; bands in the order of weights."""
    nth = F.row_number().over(Window.partitionBy(band).orderBy(*order)) - 1
    weight = F.create_map(*[F.lit(x) for b, w in weights.items() for x in (b, w)])[F.col(band)]
    rank = F.create_map(*[F.lit(x) for i, b in enumerate(weights) for x in (b, i)])[F.col(band)]
    df = df.where(F.col(band).isin(*weights)).withColumn("__n", nth).withColumn("round", F.floor(F.col("__n") / weight)).withColumn("__band", rank)
    return df.orderBy("round", "__band", "__n").drop("__n", "__band")


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of the ordered rows."""
    size = max(1, min(200, size))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def first_seen(*frames: DataFrame, key: str) -> DataFrame:
    """Ordered union of frames with a column seq: of equal keys the first stays; frames count before their successors."""
    both = None
    for i, f in enumerate(frames):
        f = f.withColumn("__frame", F.lit(i))
        both = f if both is None else both.unionByName(f, allowMissingColumns=True)
    return first_per_key(both, [key], ["__frame", "seq"]).drop("__frame")


def ranks(value: Column, order: Sequence[str], default: int = 0) -> Column:
    """Position of a label in a list, from 0."""
    mapping = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return F.coalesce(mapping[F.lower(value)], F.lit(default))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, which are counted; else df."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_missing_columns(df: DataFrame, expected: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive migration: columns that are expected (name -> type, default) and absent are added."""
    return df.withColumns({c: F.lit(v).cast(k) for c, (k, v) in expected.items() if c not in df.columns})
