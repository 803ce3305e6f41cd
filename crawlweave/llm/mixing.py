"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots, each filled by one equal-token block of a source. Slot i takes the point frac(i * phi) of
the golden-ratio sequence, in integers, and the source into whose share of the points it falls, so that every prefix of
the mix is near the targets. A source's r-th slot takes its block r modulo its number of blocks; the source's documents
are laid out in the order of a hash of their id and cut into blocks of about BLOCK_TOKENS words, as equal as can be.

Each source has a quota: the number of slots whose blocks come nearest to its target, MOST_TIMES its blocks at most.
Shares of the points are in proportion to the quotas. The sequence gives a source some slots more or less than its quota:
those beyond it, which are the source's last, go to the sources that are short. So a block is taken MOST_TIMES times at
most and a document never more often, and a source's taken words differ from its target by less than one block.

All of it is DataFrame expressions. A source's running sums are made in two steps, within buckets of its documents and
over the buckets' totals, and so are the ranks of its slots, so that no task holds a whole source. Points find their
source among the bounds in cells of the unit interval, each sorted on its own: any number of sources will do.

Cases: null text has size 0 and takes 0. A null source is a source of its own, the last. Ties of the hash are ordered by
id, size and text. Repeated rows are laid out and taken each on their own. An empty table gives no rows. A very long text
is cut into its blocks by numbers alone. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, staged, word_count

#: Words of a block, about.
BLOCK_TOKENS = 64
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix has, and times that a source may be used at most.
SHARE, MOST_TIMES = 1.0, 3
#: Documents of a bucket of a source, and slots of a chunk or cell, about.
BUCKET_DOCS, CHUNK_SLOTS = 5_000, 8_192
#: Points are integers below 2^POINT_BITS; STEP is the golden ratio's fraction of that, odd, so that 2^POINT_BITS slots have different points.
POINT_BITS, STEP = 40, 679_535_556_991
#: Sources up to which their table is broadcast; beyond it joins shuffle.
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, and the place of the document in its source's order."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(11)).alias("place"),
        F.xxhash64(F.col(text)).alias("text_hash"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_no, docs, source_size and target, for each source.

    Weight times level, stopped at most_times the size, where the level makes the sum right: the fixed point of sharing
    the excess of stopped sources anew. Sources stop in the order of most_times * size / weight.
    """
    per = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most_times))).withColumn("stops", F.col("most") / F.col("weight"))
    by_stop = Window.orderBy("stops", "source_no")
    everything = Window.partitionBy(F.lit(0))
    done = by_stop.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # If this source and all before it stop, the rest shares what is left at this level.
    per = per.withColumn("left", F.sum("source_size").over(everything) * F.lit(share) - F.sum("most").over(done)).withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(done))
    before = F.col("left") + F.col("most"), F.col("rest") + F.col("weight")
    # A source is free from the first one on that doesn't stop at the level that its predecessors leave.
    free = before[0] / before[1] <= F.col("stops")
    per = per.withColumn("first", F.min(F.when(free, F.struct("stops", "source_no", (before[0] / before[1]).alias("level")))).over(everything))
    reached = F.struct("stops", "source_no") >= F.struct(F.col("first.stops"), F.col("first.source_no"))
    per = per.withColumn("target", F.when(reached, F.least(F.col("most"), F.col("weight") * F.col("first.level"))).otherwise(F.col("most")))
    return per.select("source", "source_no", "docs", F.col("source_size"), "target")


def by_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Adds the sources' columns; the table by source is broadcast where its number of rows has been found small."""
    few = per.select("source").count() <= BROADCAST_SOURCES
    right = per.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(right) if few else right, rows["source"].eqNullSafe(right["__source"])).drop("__source")


def laid_out(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Adds start: the words of the source that lie before the document in its order."""
    rows = by_source(rows, per)
    # Buckets are ranges of the hash, so that their order is the documents' order.
    buckets = F.ceil(F.col("docs") / BUCKET_DOCS)
    unit = F.shiftrightunsigned("place", 33).cast("double") / F.lit(2.0**31)
    rows = rows.withColumn("bucket", F.floor(unit * buckets))
    own = Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumn("within", F.sum("size").over(own) - F.col("size"))
    total = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = total.withColumn("ahead", F.sum("n").over(ahead) - F.col("n")).select("source_no", "bucket", "ahead")
    return inner.join(offsets, ["source_no", "bucket"]).withColumn("start", F.col("ahead") + F.col("within")).drop("ahead", "within", "bucket")


def blocked(per: DataFrame, block_tokens: int = BLOCK_TOKENS, most_times: int = MOST_TIMES) -> DataFrame:
    """Adds blocks, the words of the shorter ones, the number of those with a word more, and quota: the slots that the source is to have."""
    size = F.col("source_size")
    per = per.withColumn("blocks", F.ceil(size / block_tokens).cast("long"))
    some = F.col("blocks") > 0
    per = per.withColumns({"words": F.when(some, F.floor(size / F.nullif(F.col("blocks"), F.lit(0)))).otherwise(0), "more": F.when(some, size % F.nullif(F.col("blocks"), F.lit(0))).otherwise(0)})
    wanted = F.round(F.col("target") * F.col("blocks") / F.nullif(size, F.lit(0))).cast("long")
    return per.withColumn("quota", F.coalesce(F.least(wanted, F.col("blocks") * most_times), F.lit(0)).cast("long"))


def block_at(word: Column) -> Column:
    """The block of a source that has its word-th word; the first `more` blocks have words + 1."""
    edge = F.col("more") * (F.col("words") + 1)
    return F.when(word < edge, F.floor(word / (F.col("words") + 1))).otherwise(F.col("more") + F.floor((word - edge) / F.greatest(F.col("words"), F.lit(1))))


def block_begin(block: Column) -> Column:
    return block * F.col("words") + F.least(block, F.col("more"))


def point(slot: Column) -> Column:
    """slot * STEP modulo 2^POINT_BITS, without leaving 64 bits: the slot's upper and lower 20 bits apart."""
    half, top = 1 << 20, 1 << POINT_BITS
    high = F.shiftright(slot, 20) % half
    return (slot % half * F.lit(STEP) + high * F.lit(STEP * half % top) % top) % top


def schedule(per: DataFrame, rows: int | None = None) -> DataFrame:
    """The mix: slot, source_no, rank of the slot within its source, and the source's block that fills it. per: as `blocked` gives it."""
    spark, top = per.sparkSession, 1 << POINT_BITS
    per = per.where("quota > 0").select("source_no", "blocks", "quota")
    slots = per.agg(F.sum("quota")).first()[0] or 0
    bits = min(POINT_BITS, max(0, (slots // CHUNK_SLOTS).bit_length()))
    width = 1 << (POINT_BITS - bits)
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = lambda n: F.floor(n.cast("double") / max(slots, 1) * top).cast("long")
    share = per.withColumn("end", F.sum("quota").over(upto)).withColumns({"lo": edge(F.col("end") - F.col("quota")), "hi": edge(F.col("end"))})
    # Marks: where a source's share begins, and in whose share each cell begins. A point belongs to the last mark up to it.
    first, last = F.ceil(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)
    cells = F.when((F.col("hi") > F.col("lo")) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    begins = F.concat(F.array("lo"), F.transform(cells, lambda c: c * width))
    marks = share.select("source_no", F.explode(begins).alias("at"), F.lit(None).cast("long").alias("slot"))
    points = spark.range(slots).select(F.lit(None).cast("int").alias("source_no"), point(F.col("id")).alias("at"), F.col("id").alias("slot"))
    met = marks.unionByName(points).withColumn("cell", F.floor(F.col("at") / width))
    until = Window.partitionBy("cell").orderBy("at", F.col("slot").isNotNull(), "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = met.withColumn("source_no", F.last("source_no", ignorenulls=True).over(until)).where("slot IS NOT NULL").select("slot", "source_no")
    picked = picked.withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    own = Window.partitionBy("chunk", "source_no").orderBy("slot")
    counts = picked.groupBy("chunk", "source_no").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn("ahead", F.sum("n").over(ahead) - F.col("n")).select("chunk", "source_no", "ahead")
    ranked = picked.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["chunk", "source_no"])
    ranked = ranked.select("slot", "source_no", (F.col("own") + F.col("ahead")).alias("rank"))
    few = (rows if rows is not None else per.count()) <= BROADCAST_SOURCES
    met = ranked.join(F.broadcast(per) if few else per, "source_no")
    inside = met.where("rank < quota")
    # Slots beyond their source's quota go to the sources that the sequence leaves short: as many, a few of each source.
    beyond = met.where("rank >= quota").select("slot", F.row_number().over(Window.orderBy("slot")).alias("nth"))
    given = counts.groupBy("source_no").agg(F.sum("n").alias("given"))
    short = per.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < quota")
    short = short.select("source_no", "blocks", F.explode(F.sequence("given", F.col("quota") - 1)).alias("rank"))
    short = short.withColumn("nth", F.row_number().over(Window.orderBy("rank", "source_no"))).join(beyond, "nth")
    columns = ["slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block")]
    return inside.select(*columns).unionByName(short.select(*columns))


def times(slots: DataFrame) -> DataFrame:
    """source_no, block and how often the schedule takes it."""
    return slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Documents as laid out (with source_size, target, start), and their pieces joined with the schedule.

    A piece is the part of a document in one block: doc_id, source_no, start, place, size, text_hash, block, head (whether
    the document begins in it), words, times.
    """
    rows = staged(sized(docs), "sizes")
    per = staged(blocked(targets(rows, weights, share, most_times), block_tokens, most_times), "targets")
    placed = staged(laid_out(rows, per), "laid-out")
    released(rows)
    parts = placed.where("size > 0").withColumns({"from": block_at(F.col("start")), "to": block_at(F.col("start") + F.col("size") - 1)})
    parts = parts.select("*", F.explode(F.sequence("from", "to")).alias("block"))
    words = F.least(F.col("start") + F.col("size"), block_begin(F.col("block") + 1)) - F.greatest(F.col("start"), block_begin(F.col("block")))
    parts = parts.select("doc_id", "source_no", "start", "place", "size", "text_hash", "block", (F.col("block") == F.col("from")).alias("head"), words.alias("words"))
    joined = parts.join(times(schedule(per)), ["source_no", "block"]).withColumn("times", F.col("times").cast("long"))
    return placed, joined


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    placed, pieces = mix(docs, **options)
    found = pieces.groupBy("source_no", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    left = placed.select("source_no", "start", "doc_id", "size", "source_size", "target")
    same = [left[k].eqNullSafe(found[k]) for k in ("source_no", "start", "doc_id", "size")]
    return left.join(found, same, "left").select(left["doc_id"], left["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs as the mix takes them whole: a row for each time that the schedule takes the block in which the document begins.

    Rows that agree in id and text are taken as often as the most taken of them. Documents without words are not in a mix.
    """
    placed, pieces = mix(docs, **options)
    often = staged(pieces.where("head").groupBy("doc_id", "text_hash").agg(F.max("times").alias("__times")), "times").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    released(placed)
    rows = docs.join(often, docs[doc_id].eqNullSafe(often["__id"]) & (F.xxhash64(docs[text]) == often["__hash"]))
    return rows.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[docs[c] for c in docs.columns])
