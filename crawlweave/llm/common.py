"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Byte table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

#: Rows whose texts a worker has as Python's strings at once.
ROWS_AT_ONCE = 512

_OWN: list[str] = []
_RECORDS: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and all runs on this machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="crawlweave-"))
    return _OWN[0]


#: With it Spark deletes the shuffle files of a SQL execution when that ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and fixes what a retry would compute anew.

    The job's shuffle files are deleted when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crawlweave/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    for record in _RECORDS:
        record.append(out)
    return out


@contextlib.contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The frames that `staged` writes meanwhile: for who knows when nothing reads them any more."""
    record: list[DataFrame] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not record]


def released(*frames: DataFrame) -> None:
    """Deletes what `staged` has written for frames that nothing reads any more: what was made of them is written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def parts(batch: pa.RecordBatch, rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, which are not copied."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


#: Bytes of the batches in which `small_batches` has rows sent to workers.
_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to workers in batches of about BATCH_BYTES, unless it has a size of its own: executor and worker hold a few batches a task, within and beside the heap."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end gives the memory it has freed back to the system: allocators keep it, and a worker lives on after its task."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return task


#: Bits of a key filter, and of one of its rows: 2048 rows of 4 KB, 8 MB at most, whatever the number of keys. More keys only let more pass.
KEY_BITS, ROW_BITS = 1 << 26, 1 << 15


def _key_bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BITS))


def key_filter(keys: Column, rows: DataFrame) -> DataFrame:
    """A bit set of the keys of rows: one row (part, bits) for each run of ROW_BITS bits that has a key."""
    at = rows.select(_key_bit(keys).alias("at"))
    # The bitmap functions count from 1.
    return at.groupBy(F.floor(F.col("at") / ROW_BITS).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))


def sifted(rows: DataFrame, key: Column, bits: DataFrame, held: bool) -> DataFrame:
    """The rows whose key the filter may hold, or those whose key it surely does not hold. The filter is broadcast: its size is bounded."""
    columns = rows.columns
    own = rows.withColumn("__at", _key_bit(key)).withColumn("__part", F.floor(F.col("__at") / ROW_BITS))
    met = own.join(F.broadcast(bits.select(F.col("part").alias("__part"), F.col("bits").alias("__bits"))), "__part", "left")
    place = F.col("__at") % ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))
    return met.where(found if held else ~found).select(*columns)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))
