"""Tables of audit runs: schemas, run-partitioned Parquet, CSV with column aliases, releases, upserts, exports, blobs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.state import merged

# Columns of the tables, `name type` each; tables whose rows belong to a run have run_id first.
SCHEMAS = {
    "runs": "run_id string, started_at timestamp, completed_at timestamp, domain string, config_json string, status string, notes string",
    "links": "run_id string, source_url string, target_url string, normalized_target_url string, is_internal int, anchor_text string, rel string, region string",
    "issues": "run_id string, url string, severity string, issue_code string, title string, description string, evidence_json string, issue_provenance string, technical_seo_gate string, verification_status string, confidence_score int, certainty_state string, priority_score int, page_importance double, reach string, urgency double, affected_count int, affected_ratio double, template_cluster string, affected_page_types string",
    "scores": "run_id string, url string, crawlability_score int, onpage_score int, render_risk_score int, internal_linking_score int, local_seo_score int, performance_score int, overall_score int, quality_score int, risk_score int, coverage_score int, score_cap int, scoring_model_version string, scoring_profile string, explanation_json string",
    "page_graph_metrics": "run_id string, url string, internal_pagerank double, betweenness double, closeness double, community_id int, bridge_flag int",
    "performance_metrics": "run_id string, url string, strategy string, source string, performance_score int, seo_score int, lcp double, cls double, inp double, status string, error_message string",
    "lighthouse_metrics": "run_id string, url string, form_factor string, performance_score int, accessibility_score int, best_practices_score int, seo_score int, status string, error_message string",
    "crux_metrics": "run_id string, url string, query_scope string, status string, lcp_p75 double, cls_p75 double, inp_p75 double, error_message string",
    "sitemap_entries": "run_id string, sitemap_url string, url string, entry_kind string, lastmod string, changefreq string, priority string, extensions_json string, hreflang_links_json string",
    "robots_rules": "run_id string, robots_url string, user_agent string, directive string, value string, pos int",
    "run_events": "run_id string, event_time timestamp, event_type string, stage string, elapsed_ms bigint, detail_json string",
    "crawl_fetches": "run_id string, url string, fetched_at timestamp, status_code int, fetch_ms bigint, bytes bigint, from_cache int",
    "page_snapshots": "run_id string, url string, content_hash string, changed int, observed_at timestamp",
    "url_state": "url_key string, normalized_url string, last_etag string, last_modified string, last_content_hash string, not_modified_streak int, last_run_id string",
    "body_blobs": "body_sha256 string, size bigint, first_run_id string, body binary",
    "artifact_cache": "artifact_sha256 string, artifact_type string, extractor_version string, payload_json string",
    "page_diffs": "run_id string, url string, family string, severity string, old_value string, new_value string",
    "render_sessions": "run_id string, url string, status string, elapsed_ms bigint, detail_json string",
    "schema_validations": "run_id string, url string, variant string, score int, payload_json string",
    "media_assets": "run_id string, url string, kind string, asset_url string, detail_json string",
    "index_state_history": "run_id string, url string, state string, coverage string, observed_at timestamp",
    "citation_events": "run_id string, url string, eligibility int, detail_json string",
    "ai_visibility_events": "run_id string, url string, potential int, observed_json string",
    "submission_events": "run_id string, url string, action string, status string, detail_json string",
    "template_clusters": "run_id string, cluster_key string, page_type string, url_count bigint, avg_score double, issue_count bigint",
    "offsite_summary": "run_id string, target_domain string, status string, release string, referring_domains bigint, weighted_score double, avg_harmonic double, avg_pagerank double, top_concentration double",
    "offsite_linking_domains": "run_id string, linking_domain string, source_num_hosts bigint, source_harmonic_centrality double, source_pagerank double, rank_bucket string",
    "offsite_comparisons": "run_id string, compare_domain string, harmonic_centrality double, pagerank double, harmonic_gap double, pagerank_gap double",
}
RUN_SCOPED = [name for name, columns in SCHEMAS.items() if columns.startswith("run_id") and name != "runs"]

# Names that a column of a web-graph file may have, in order of preference.
ALIASES = {
    "vertices": {"id": ["id", "vertex_id", "node_id"], "domain": ["domain", "host", "rev_domain", "name"], "num_hosts": ["num_hosts", "n_hosts", "hosts"]},
    "ranks": {"id": ["id", "vertex_id", "node_id"], "harmonic_centrality": ["harmonic_centrality", "harmonicc_val", "hc"], "pagerank": ["pagerank", "pr_val", "pr"]},
    "edges": {"source_id": ["source_id", "src", "from_id"], "target_id": ["target_id", "dst", "to_id"]},
}
GRAPH_TYPES = {"id": "bigint", "num_hosts": "bigint", "source_id": "bigint", "target_id": "bigint", "harmonic_centrality": "double", "pagerank": "double", "domain": "string"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def completed(df: DataFrame, wanted: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the wanted columns in order: absent ones are added with their defaults, others are cast."""
    defaults = defaults or {}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in wanted.fields])


def write(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Appends rows to a table; those of a run go to a partition of their own."""
    writer = completed(df, schema(name)).write.mode(mode)
    (writer.partitionBy("run_id") if name in RUN_SCOPED else writer).parquet(f"{root}/{name}")


def replace_run(df: DataFrame, root: str, name: str) -> None:
    """Writes a run's rows in place of those the table has of the same runs."""
    completed(df, schema(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table, or one run of it (its partition alone is read); an empty one where it hasn't been written."""
    path = f"{root}/{name}"
    df = spark.read.schema(schema(name)).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema(name))
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def read_first(spark: SparkSession, root: str, names: Sequence[str], run_id: str | None = None) -> DataFrame:
    """The first of several tables that exists: a new name, then its predecessors."""
    for name in names:
        if exists(spark, f"{root}/{name}"):
            df = spark.read.parquet(f"{root}/{name}")
            return df if run_id is None else df.where(F.col("run_id") == run_id)
    return read(spark, root, names[0], run_id)


def sql(spark: SparkSession, text: str, args: dict[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A statement with named parameters over the given tables, written {name} in it."""
    return spark.sql(text, args=args, **tables)


def pick(columns: Iterable[str], names: Sequence[str], required: bool = True) -> str | None:
    """The first of the names that is a column, in any case."""
    known = {c.lower(): c for c in columns}
    found = next((known[n.lower()] for n in names if n.lower() in known), None)
    if found is None and required:
        raise ValueError(f"none of {list(names)} in {sorted(known.values())}")
    return found


def read_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files, compressed or not, united by name; lines that don't parse are dropped. Values are text: casts are the reader's."""
    out = None
    for path in paths:
        df = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def web_graph(spark: SparkSession, paths: Sequence[str], kind: str) -> DataFrame:
    """vertices, ranks or edges from CSV files with columns of any known name, cast; names lower-cased and trimmed, rows without a key left out."""
    raw, columns = read_csv(spark, paths), []
    for name, names in ALIASES[kind].items():
        found = pick(raw.columns, names, required=name not in ("num_hosts", "harmonic_centrality", "pagerank"))
        value = F.trim(F.col(found)).try_cast(GRAPH_TYPES[name]) if found else F.lit(None).cast(GRAPH_TYPES[name])
        columns.append((F.lower(value) if name == "domain" else F.coalesce(value, F.lit(0)) if name == "num_hosts" else value).alias(name))
    keys = [k for k in ("id", "source_id", "target_id") if k in ALIASES[kind]]
    return raw.select(*columns).dropna(subset=keys)


def release_state(spark: SparkSession, root: str, release: str) -> str:
    """What of a release is materialised: cold, partial, warm_ranks (vertices and ranks) or warm_edges (all)."""
    have = {k for k in ALIASES if exists(spark, f"{root}/release={release}/{k}/_SUCCESS")}
    return "warm_edges" if have == set(ALIASES) else "warm_ranks" if {"vertices", "ranks"} <= have else "partial" if have else "cold"


def materialise_release(spark: SparkSession, root: str, release: str, files: dict[str, Sequence[str]], version: str) -> None:
    """Writes what a release lacks, or all of it if it was written by another version."""
    manifest = f"{root}/release={release}/manifest"
    same = exists(spark, f"{manifest}/_SUCCESS") and spark.read.text(manifest).first()[0] == json.dumps({"version": version})
    for kind, paths in files.items():
        target = f"{root}/release={release}/{kind}"
        if not same or not exists(spark, f"{target}/_SUCCESS"):
            web_graph(spark, paths, kind).write.mode("overwrite").parquet(target)
    spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(manifest)


def latest_release(releases: DataFrame, column: str = "release") -> str | None:
    return releases.agg(F.max(column)).first()[0]


def upsert(spark: SparkSession, new: DataFrame, root: str, name: str, keys: Sequence[str], version: int) -> DataFrame:
    """A keyed table as versions: version n is n - 1 with rows of equal keys replaced."""
    path = f"{root}/{name}/v={version - 1}"
    old = spark.read.parquet(path) if version > 0 and exists(spark, path) else spark.createDataFrame([], new.schema)
    merged(old, new, keys).write.mode("overwrite").parquet(f"{root}/{name}/v={version}")
    return spark.read.parquet(f"{root}/{name}/v={version}")


def blank_old(payloads: DataFrame, runs: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """payloads with a column blanked to {} where the run began more than `days` before as_of."""
    old = runs.where(F.col("started_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")).select("run_id", F.lit(True).alias("__old"))
    rows = payloads.join(old, "run_id", "left")
    return rows.withColumn(column, F.when(F.col("__old") & (F.trim(column) != "{}"), F.lit("{}")).otherwise(F.col(column))).drop("__old")


def export_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One CSV file with a header, also where there are no rows. For tables of one run, which fit a task."""
    rows = df.orderBy(*order) if order else df
    if rows.isEmpty():
        header = pd.DataFrame(columns=df.columns).to_csv(index=False).strip()
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_run(spark: SparkSession, root: str, run_id: str, out: str) -> list[str]:
    """All tables as CSV under out; those of runs with the rows of one run alone. Names of the tables."""
    for name in SCHEMAS:
        df = read(spark, root, name, run_id if name in RUN_SCOPED else None)
        export_csv(df.drop("body") if name == "body_blobs" else df, f"{out}/{name}.csv")
    return list(SCHEMAS)


def blobs(bodies: DataFrame, body: str, run_id: str) -> DataFrame:
    """Distinct bodies by their sha256."""
    rows = bodies.select(F.sha2(F.col(body), 256).alias("body_sha256"), F.octet_length(body).cast("bigint").alias("size"), F.lit(run_id).alias("first_run_id"), F.col(body).cast("binary").alias("body"))
    return rows.dropDuplicates(["body_sha256"])


def blob_path(sha256: str) -> str:
    """Where a body lies below the store's folder: by the first two pairs of digits."""
    return f"{sha256[:2]}/{sha256[2:4]}/{sha256}"


def file_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
