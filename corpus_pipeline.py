"""A corpus pipeline in five stages, each of which calls one of the operators in crawlweave.llm.

1. language ID: documents without a letter, or whose text of SCORED_LETTERS letters or more resembles no learned language, go;
2. line dedup: runs of lines that stand elsewhere too are cut out of texts;
3. n-gram Jaccard join: one document of each group of near duplicates stays;
4. mixing sources to target weights: documents are repeated or left out so that sources come near their targets;
5. best-fit packing: what is left is tokenised and packed into sequences.

What a stage has put aside in the shared folder is deleted when the next stage begins: its documents are written by then.
The session's spark.sql.execution.arrow.maxBytesPerBatch is set, and stays set, unless it has been set before: a stage's
rows are read after it has returned.

Cases: an empty table gives no pieces. Null texts go in the first stage. Repeated rows are one document after the third,
and so are rows that agree in id and text alone. Very long texts are whole documents in every stage. Columns of documents
beyond those used are passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.llm import jaccard_join, language_id, line_dedup, mixing, packing
from crawlweave.llm.common import recorded, released, small_batches, staged, table

#: Share of a text's n-grams, corrected, that its language's filter must hold.
LEAST_LANGUAGE_SCORE = 0.3
#: Letters from which that share means something; texts of fewer have few n-grams or none.
SCORED_LETTERS = 20


_aside: list[DataFrame] = []


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the one before has put aside, and whose rows go to workers in small batches."""

    @wraps(run)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released(*(x for x in _aside if x.sparkSession is spark))
        _aside.clear()
        small_batches(spark)
        with recorded() as made:
            out = run(spark, docs, sf_dir)
        _aside.extend(made)
        return out

    return begin


@_stage
def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    # Numbered names, so that no column of docs clashes with the prediction's.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    told = language_id.identify(docs.withColumnsRenamed(own), model, text=own["text"])
    short = F.regexp_count(F.col(own["text"]), F.lit(r"\p{L}")) < SCORED_LETTERS
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("score") >= LEAST_LANGUAGE_SCORE) | short))
    return kept.select(*[F.col(new).alias(old) for old, new in own.items()])


@_stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup(docs).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


@_stage
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_duplicates),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; between stages rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
