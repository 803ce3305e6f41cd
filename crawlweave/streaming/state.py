"""State that is carried from run to run: keyed merges, memoised work, change streaks, progress of an event log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: all rows of new, and those of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def advanced(old: DataFrame, seen: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, changed and not_modified_streak after a run saw `seen`; keys it didn't see stay as they are."""
    was = old.select(key, F.col(value).alias("__was"), F.col("not_modified_streak").alias("__streak"))
    same = F.col("__was").eqNullSafe(F.col(value)) & F.col("__streak").isNotNull()
    now = seen.select(key, value).join(was, key, "left")
    now = now.withColumn("changed", F.when(same, 0).otherwise(1)).withColumn("not_modified_streak", F.when(same, F.col("__streak") + 1).otherwise(0))
    return merged(old.select(key, value, F.lit(0).alias("changed"), "not_modified_streak"), now.select(key, value, "changed", "not_modified_streak"), [key])


def memoised(rows: DataFrame, cache: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for all rows: those in the cache as they are, work applied to the rest alone (each key once)."""
    missing = rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    results = cache.join(rows.select(key).distinct(), key, "left_semi").unionByName(work(missing))
    return results


def artifact_key(body_hash: str, kind: str, version: str) -> Column:
    """Key of memoised work: changes with the body, the kind of work and its version."""
    return F.sha2(F.concat_ws("|", F.col(body_hash), F.lit(kind), F.lit(version)), 256)


def progress(events: DataFrame, key: str = "run_id", done: str = "stage_timing", stages: int = 10) -> DataFrame:
    """key, done, percent: finished stages over all, at most 99. Works on a batch and on a stream."""
    counted = events.groupBy(key).agg(F.count_if(F.col("event_type") == done).alias("done"))
    return counted.withColumn("percent", F.least(F.lit(99), F.floor(F.col("done") * 100 / stages)).cast("int"))


def stream_counts(events: DataFrame, keys: Sequence[str], name: str, checkpoint: str) -> StreamingQuery:
    """Running counts by keys of a stream of events, kept in a table in memory; ends when what is there has been read."""
    counted = events.groupBy(*keys).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event_id"))
    return counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_merge(source: DataFrame, keys: Sequence[str], order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row by key of a stream as Parquet versions `path/v=<batch>`: each batch merges into the version before.

    A batch that is run again writes the same version again.
    """
    from ..operators.relational import latest_per_key

    def merge(batch: DataFrame, number: int) -> None:
        rows = latest_per_key(batch, list(keys), [order])
        if number > 0:
            rows = latest_per_key(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/v={number - 1}").unionByName(rows), list(keys), [order])
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
