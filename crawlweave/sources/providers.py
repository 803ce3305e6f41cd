"""Measurements of providers from recorded payloads: JSON files, one response each, as rows.

The payload source reads files on executors that see the folder; on other stores read the files with Spark's own
binaryFile reader and parse the same way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAYLOAD = "provider string, url string, payload string"


class PayloadSource(DataSource):
    """Format `recorded_payloads`: option path, a folder of provider/*.json with a `url` and the response as `payload`."""

    @classmethod
    def name(cls) -> str:
        return "recorded_payloads"

    def schema(self) -> str:
        return PAYLOAD

    def reader(self, schema) -> DataSourceReader:
        return PayloadReader(self.options["path"])


class PayloadReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """One partition for each provider."""
        return [InputPartition(str(p)) for p in sorted(Path(self.path).iterdir()) if p.is_dir()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in sorted(Path(partition.value).glob("*.json")):
            recorded = json.loads(file.read_text())
            yield Path(partition.value).name, recorded.get("url", ""), json.dumps(recorded.get("payload"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """provider, url, payload of a folder of recorded responses."""
    spark.dataSource.register(PayloadSource)
    return spark.read.format("recorded_payloads").option("path", path).load()


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    text = files.select(F.element_at(F.split("path", "/"), -2).alias("provider"), F.decode("content", "UTF-8").alias("t"))
    return text.select("provider", F.get_json_object("t", "$.url").alias("url"), F.get_json_object("t", "$.payload").alias("payload"))


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json("payload"), path, kind)


def page_speed(payloads: DataFrame, provider: str = "psi") -> DataFrame:
    """url, strategy, scores of 0..100, metrics, status and message of page-speed responses."""
    score = lambda name: F.bround(_at(f"$.lighthouseResult.categories.{name}.score", "double") * 100, 0).cast("int")
    metric = lambda name: _at(f"$.lighthouseResult.audits['{name}'].numericValue", "double")
    error = F.coalesce(_at("$.error.message", "string"), F.lit(""))
    return payloads.where(F.col("provider") == provider).select(
        "url",
        F.coalesce(_at("$.lighthouseResult.configSettings.formFactor", "string"), F.lit("mobile")).alias("strategy"),
        score("performance").alias("performance_score"),
        score("seo").alias("seo_score"),
        metric("largest-contentful-paint").alias("lcp"),
        metric("cumulative-layout-shift").alias("cls"),
        F.when(error != "", "failed").when(score("performance").isNull(), "partial").otherwise("success").alias("status"),
        error.alias("error_message"),
    )


def field_data(payloads: DataFrame, provider: str = "crux") -> DataFrame:
    """url, query_scope, 75th percentiles, status of field-data responses."""
    p75 = lambda name: _at(f"$.record.metrics.{name}.percentiles.p75", "double")
    return payloads.where(F.col("provider") == provider).select(
        "url",
        F.when(_at("$.record.key.url", "string").isNotNull(), "page").otherwise("origin").alias("query_scope"),
        p75("largest_contentful_paint").alias("lcp_p75"),
        p75("cumulative_layout_shift").alias("cls_p75"),
        p75("interaction_to_next_paint").alias("inp_p75"),
        F.when(_at("$.error.code", "int") == 404, "no_data").when(_at("$.error.code", "int").isNotNull(), "failed").otherwise("success").alias("status"),
    )


def inspections(payloads: DataFrame, provider: str = "gsc_inspection") -> DataFrame:
    """url and index state of inspection responses."""
    from ..plans.resolution import index_state

    parts = [_at(f"$.inspectionResult.indexStatusResult.{k}", "string") for k in ("verdict", "coverageState", "indexingState", "robotsTxtState", "pageFetchState")]
    return payloads.where(F.col("provider") == provider).select("url", index_state(*parts).alias("state"), F.coalesce(parts[1], F.lit("")).alias("coverage"))


def search_rows(payloads: DataFrame, dimensions: list[str], provider: str = "gsc_analytics") -> DataFrame:
    """Rows of search analytics: a column for each dimension, clicks, impressions, position."""
    rows = payloads.where(F.col("provider") == provider).select(F.explode(F.from_json("payload", "struct<rows:array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>>")["rows"]).alias("r"))
    return rows.select(*[F.get("r.keys", i).alias(d) for i, d in enumerate(dimensions)], "r.clicks", "r.impressions", "r.position")
