"""Line dedup with content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the last WINDOW line hashes decides after which lines a chunk ends, so
that the same run of lines is cut alike wherever it stands. A line of LONG_WORDS words or more is a chunk of its own: a
long passage may be one line. A chunk of two lines or more, or of one such long line, that occurs more than once among
all documents is a repetition everywhere but at its first occurrence (least doc_id, then place), once its bytes have
been compared with that occurrence's.

A repeated passage seldom begins and ends where chunks do. So repetitions are extended over equal neighbouring lines:
pairs of adjacent lines that are not both long and are no chunk are looked up and compared in the same way, and the lines
of repeated chunks and pairs form runs. A run goes if it holds a repeated chunk or LONG_WORDS words. Nothing stays of a
repeated passage of short lines but its first occurrence, and no line's first occurrence ever goes.

Only hashes are shuffled until the repetitions are known. Then a key filter of fixed size (`common.key_filter`) picks the
texts that hold first occurrences or repetitions; no other text is shuffled. Counting is combined before it is shuffled,
and the joins by chunk are inner joins, which adaptive execution splits where one chunk is very frequent. All of it is
DataFrame expressions.

Cases: a null text stays null, an empty text stays empty. Rows that agree in doc_id and text count as one document, are
cleaned alike, and are each returned. A null doc_id comes last among first occurrences. A text all of whose lines are
removed is empty; no row is dropped. An empty table gives an empty table. A very long text is one row whose lines are
arrays: work and memory grow with its number of lines, and nothing is cut. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, key_filter, sifted, staged

#: Lines of the rolling hash, and the modulus that makes a boundary.
WINDOW, MODULUS = 3, 4
#: Words from which a line is a chunk of its own, and from which a run of repeated pairs goes.
LONG_WORDS = 20


def _line_number(line: Column) -> Column:
    """A number below 2^28 that depends on the line alone."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _key(doc_id: str, text: str) -> Column:
    """Key of a document: rows that agree in id and text share it."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(text))))


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_key, lines, and chunks: (first line, number of lines, whether it may be removed alone) of every chunk; pairs: first lines of the pairs that are no chunks and hold a short line."""
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("doc_key"), F.split(F.col(text), "\n").alias("lines"))
    rows = rows.withColumn("facts", F.transform("lines", lambda x: F.struct(_line_number(x).alias("h"), (F.regexp_count(x, F.lit(WORD)) >= LONG_WORDS).alias("long"))))
    # A chunk ends after line i if the rolling hash says so, or if line i or the one after is long, or at the end.
    hashed = lambda i, k: F.when(i > k, F.element_at("facts", F.greatest(i - k, F.lit(1)))["h"] * 31**k).otherwise(0)
    rolling = lambda i: sum((hashed(i, k) for k in range(1, WINDOW)), hashed(i, 0)) % 1009 % MODULUS == 0
    end = lambda i: (i == F.size("lines")) | F.element_at("facts", i)["long"] | F.element_at("facts", F.least(i + 1, F.size("lines")))["long"] | rolling(i)
    rows = rows.withColumn("ends", F.transform(F.sequence(F.lit(1), F.size("lines")), end))
    rows = rows.withColumn("last", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("ends", i)))
    start = lambda k: F.when(k == 0, 0).otherwise(F.element_at("last", F.greatest(k, F.lit(1)))) + 1
    chunks = F.transform(
        "last",
        lambda e, k: F.struct(start(k).alias("first"), (e - start(k) + 1).alias("n"), ((e > start(k)) | F.element_at("facts", e)["long"]).alias("removable")),
    )
    ended = lambda i: F.element_at("ends", i)
    whole = lambda i: ((i == 1) | ended(F.greatest(i - 1, F.lit(1)))) & ~ended(i) & ended(i + 1)
    both_long = lambda i: F.element_at("facts", i)["long"] & F.element_at("facts", i + 1)["long"]
    firsts = F.when(F.size("lines") > 1, F.sequence(F.lit(1), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.filter(firsts, lambda i: ~both_long(i) & ~whole(i))
    return rows.select("doc_id", "doc_key", "lines", chunks.alias("chunks"), pairs.alias("pairs"))


def _body(lines: str, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"], chunk["n"]), "\n")


def repetitions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_key, first, n, chunk (false: a pair), hash, origin_key, origin_first, origin_n of every chunk and pair whose hash is that of an earlier one; written to the shared folder."""
    cut = chunked(docs, doc_id, text)
    picked = F.transform(F.filter("chunks", lambda c: c["removable"]), lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), F.lit(True).alias("chunk")))
    picked = F.concat(picked, F.transform("pairs", lambda i: F.struct(i.alias("first"), F.lit(2).alias("n"), F.lit(False).alias("chunk"))))
    marks = F.transform(picked, lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), c["chunk"].alias("chunk"), F.unhex(F.md5(_body("lines", c))).alias("hash")))
    found = staged(cut.select("doc_id", "doc_key", F.explode(marks).alias("c")).select("doc_id", "doc_key", "c.*"), "chunk-marks")
    # The first occurrence, combined before the shuffle. What has but one is left out; rows that agree in id and text are one.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), F.col("first").alias("first"), F.col("n").alias("n"))
    sides = found.groupBy("hash").agg(F.min(place).alias("origin"), F.max(place).alias("last")).where("origin <> last")
    kept = sides.select("hash", F.col("origin.key").alias("origin_key"), F.col("origin.first").alias("origin_first"), F.col("origin.n").alias("origin_n"))
    # A pair that overlaps its first occurrence, as in three equal lines, is no repetition.
    others = found.join(kept, "hash").where((F.col("doc_key") != F.col("origin_key")) | (F.col("first") >= F.col("origin_first") + F.col("origin_n")))
    return staged(others.drop("doc_id").distinct(), "repetitions")


def _bodies(docs: DataFrame, others: DataFrame, doc_id: str, text: str) -> DataFrame:
    """hash, body: the first occurrences' lines, read from their documents alone."""
    origins = others.select("hash", "origin_key", "origin_first", "origin_n").distinct()
    wanted = origins.groupBy("origin_key").agg(F.collect_list(F.struct("hash", F.col("origin_first").alias("first"), F.col("origin_n").alias("n"))).alias("wanted"))
    texts = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(_key(doc_id, text).alias("origin_key"), F.col(text).alias("text"))
    sources = sifted(texts, F.col("origin_key"), key_filter(F.col("origin_key"), others), True)
    sources = sources.join(wanted, "origin_key").withColumn("lines", F.split("text", "\n"))
    bodies = F.transform("wanted", lambda w: F.struct(w["hash"].alias("hash"), _body("lines", w).alias("body")))
    return sources.select(F.explode(bodies).alias("b")).select("b.*").groupBy("hash").agg(F.min("body").alias("body"))


def _runs(found: Column) -> Column:
    """(first, n) of the runs of adjacent lines that the found chunks and pairs cover, if they hold a chunk or LONG_WORDS words."""
    spans = F.array_sort(F.transform(found, lambda c: F.struct(c["first"].alias("first"), (c["first"] + c["n"] - 1).alias("last"), c["chunk"].alias("chunk"))))
    nothing = "array<struct<first:int,last:int,chunk:boolean>>"

    def add(state: Column, c: Column) -> Column:
        # The open run is kept apart from those that are closed, so that a step does not copy them unless a run ends.
        now = state["open"]
        meets = now["first"].isNotNull() & (c["first"] <= now["last"] + 1)
        joined = F.struct(now["first"].alias("first"), F.greatest(now["last"], c["last"]).alias("last"), (now["chunk"] | c["chunk"]).alias("chunk"))
        closed = F.when(meets | now["first"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(now)))
        return F.struct(closed.alias("done"), F.when(meets, joined).otherwise(c).alias("open"))

    begin = F.struct(F.array().cast(nothing).alias("done"), F.lit(None).cast("struct<first:int,last:int,chunk:boolean>").alias("open"))
    every = F.aggregate(spans, begin, add, lambda s: F.when(s["open"]["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    runs = F.transform(every, lambda r: F.struct(r["first"].alias("first"), (r["last"] - r["first"] + 1).alias("n"), r["chunk"].alias("chunk")))
    goes = F.filter(runs, lambda r: r["chunk"] | (F.regexp_count(_body("__lines", r), F.lit(WORD)) >= LONG_WORDS))
    return F.transform(goes, lambda r: F.struct(r["first"].alias("first"), r["n"].alias("n")))


def _cleaned(rows: DataFrame, text: str) -> DataFrame:
    """rows with __found, without the runs that are found and whose bytes agree."""
    rows = rows.withColumn("__lines", F.split(F.col(text), "\n"))
    # The byte comparison: what stands there must be what the first occurrence has.
    rows = rows.withColumn("__gone", F.filter("__found", lambda c: F.array_join(F.slice("__lines", c["first"], c["n"]), "\n") == c["body"]))
    # Kept lines are those between the removed runs.
    rows = rows.withColumn("__cuts", _runs(F.col("__gone")))
    count = F.size("__cuts")
    begin = lambda k: F.when(k == 0, 1).otherwise(F.element_at("__cuts", F.greatest(k, F.lit(1)))["first"] + F.element_at("__cuts", F.greatest(k, F.lit(1)))["n"])
    stop = lambda k: F.when(k == count, F.size("__lines") + 1).otherwise(F.element_at("__cuts", F.least(k + 1, count))["first"])
    spans = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice("__lines", begin(k), F.greatest(stop(k) - begin(k), F.lit(0))))
    touched = F.coalesce(F.size("__cuts") > 0, F.lit(False))
    clean = F.when(touched, F.array_join(F.flatten(spans), "\n")).otherwise(F.col(text))
    lines = F.when(touched, F.aggregate("__cuts", F.lit(0).cast("long"), lambda a, c: a + c["n"])).otherwise(F.lit(0).cast("long"))
    out = rows.withColumns({"removed_lines": lines, "__clean": clean})
    return out.withColumn("removed_chars", F.coalesce(F.length(F.col(text)) - F.length("__clean"), F.lit(0)).cast("long")).withColumn(text, F.col("__clean"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated runs of lines removed from the text, and removed_lines and removed_chars (which replace columns of docs of these names)."""
    others = repetitions(docs, doc_id, text)
    found = others.join(_bodies(docs, others, doc_id, text), "hash")
    gone = found.groupBy(F.col("doc_key").alias("__key")).agg(F.collect_list(F.struct("first", "n", "chunk", "body")).alias("__found"))
    out = [*[c for c in docs.columns if c not in ("removed_lines", "removed_chars")], "removed_lines", "removed_chars"]
    # A null text has the key of its id alone; it is in no repetition.
    rows = docs.withColumn("__key", F.coalesce(_key(doc_id, text), F.lit(b"")))
    bits = staged(key_filter(F.col("doc_key"), others), "repeating")
    touched = _cleaned(sifted(rows, F.col("__key"), bits, True).join(gone, "__key", "left"), text).select(*out)
    rest = sifted(rows, F.col("__key"), bits, False).withColumns({"removed_lines": F.lit(0).cast("long"), "removed_chars": F.lit(0).cast("long")}).select(*out)
    return rest.unionByName(touched)


def digest(cleaned: DataFrame) -> DataFrame:
    """What the query returns: doc_id, removed_lines, removed_chars, n_chars left, and the md5 of the text that is left."""
    return cleaned.select("doc_id", "removed_lines", "removed_chars", F.length("text").cast("long").alias("n_left"), F.md5("text").alias("left_md5"))


#: The digest in SQL over the table documents. Chunks are numbered by running sums, bodies compared themselves.
DIGEST_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), text)) AS doc_key FROM documents),
u AS (SELECT doc_key, any_value(doc_id) AS doc_id, any_value(text) AS text FROM d WHERE text IS NOT NULL AND text <> '' GROUP BY doc_key),
s AS (SELECT doc_key, doc_id, string_split(text, chr(10)) AS a FROM u),
l AS (SELECT doc_key, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos, len(a) AS n FROM s),
f AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
b AS (
  SELECT *, words >= {LONG_WORDS} AS long, lead(line) OVER w AS line2, lead(words) OVER w AS words2,
    (pos = n OR words >= {LONG_WORDS} OR coalesce(lead(words) OVER w >= {LONG_WORDS}, false) OR (h + 31 * coalesce(lag(h) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 1009 % {MODULUS} = 0) AS ends
  FROM f WINDOW w AS (PARTITION BY doc_key ORDER BY pos)),
c AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
g AS (SELECT doc_key, any_value(doc_id) AS doc_id, min(pos) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body, bool_or(long) AS long FROM c GROUP BY doc_key, chunk),
m AS (
  SELECT doc_key, doc_id, first, n, body, true AS chunk FROM g WHERE n > 1 OR long
  UNION ALL
  SELECT c.doc_key, c.doc_id, c.pos, 2, c.line || chr(10) || c.line2, false FROM c LEFT JOIN g ON g.doc_key = c.doc_key AND g.first = c.pos AND g.n = 2
  WHERE c.pos < c.n AND NOT (c.long AND c.words2 >= {LONG_WORDS}) AND g.doc_key IS NULL),
r AS (SELECT *, first_value(doc_key) OVER w AS origin_key, first_value(first) OVER w AS origin_first FROM m WINDOW w AS (PARTITION BY body ORDER BY doc_id NULLS LAST, doc_key, first, n)),
x AS (SELECT * FROM r WHERE doc_key <> origin_key OR first >= origin_first + n),
y AS (SELECT doc_key, unnest(range(first, first + n)) AS pos, chunk FROM x),
z AS (SELECT doc_key, pos, bool_or(chunk) AS chunk FROM y GROUP BY ALL),
i AS (SELECT z.*, c.words, z.pos - row_number() OVER (PARTITION BY z.doc_key ORDER BY z.pos) AS run FROM z JOIN c ON c.doc_key = z.doc_key AND c.pos = z.pos),
o AS (SELECT doc_key, run FROM i GROUP BY ALL HAVING bool_or(chunk) OR sum(words) >= {LONG_WORDS}),
e AS (SELECT i.doc_key, i.pos FROM i JOIN o ON i.doc_key = o.doc_key AND i.run = o.run),
k AS (
  SELECT c.doc_key, count(e.pos) AS removed, string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (WHERE e.pos IS NULL) AS kept
  FROM c LEFT JOIN e ON c.doc_key = e.doc_key AND c.pos = e.pos GROUP BY c.doc_key)
SELECT d.doc_id, CAST(coalesce(k.removed, 0) AS BIGINT) AS removed_lines,
  CAST(coalesce(length(d.text) - length(CASE WHEN coalesce(k.removed, 0) = 0 THEN d.text ELSE coalesce(k.kept, '') END), 0) AS BIGINT) AS removed_chars,
  CAST(length(CASE WHEN coalesce(k.removed, 0) = 0 THEN d.text ELSE coalesce(k.kept, '') END) AS BIGINT) AS n_left,
  md5(CASE WHEN coalesce(k.removed, 0) = 0 THEN d.text ELSE coalesce(k.kept, '') END) AS left_md5
FROM d LEFT JOIN k ON d.doc_key = k.doc_key
"""
