"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue the whole dialogue is rendered once with that participant as the assistant and all
others as named users; the mask is 1 on the assistant's own words (and the mark that ends them), 0 elsewhere. Participants
are the distinct roles that speak; `system` turns instruct and stay system in every perspective, and a dialogue of
system turns alone has no perspective.

No text can pass for a mark: `<|` in texts and names is written `< |`, and white space in names is one blank, so that a
turn begins and ends where the rendering says so.

A rendered dialogue is one value by definition, so a dialogue is gathered in one row, and its renderings are participants
times its length: that is the result's size, not the method's. Masks are spans of code points.

Cases: null text is empty, a null or blank role is `unknown`, a row with a null conv_id is a dialogue of its own; turns are
ordered by turn (null first), role and text, and repeated rows are all rendered. An empty table gives no rows. A very long
text or dialogue is rendered whole; it must fit in a row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with defaults in place and without marks in texts and names."""
    unmarked = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.trim(F.regexp_replace(F.coalesce("role", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return conversations.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.when(role == "", F.lit("unknown")).otherwise(unmarked(role)).alias("role"),
        unmarked(F.coalesce("text", F.lit(""))).alias("text"),
    )


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, rendered, and spans: array of (start, end) in code points that are trained on.

    The dialogue is gathered once, sorted, and each perspective is a fold over its turns, all within expressions.
    """
    said = turns(conversations)
    whole = said.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    whole = whole.unionByName(said.where("conv_id IS NULL").select("conv_id", F.array(F.struct("turn", "role", "text")).alias("t")))
    # array_sort puts a null turn where structs with nulls sort: first, as an ascending order does.
    seen = F.array_sort(F.array_distinct(F.filter(F.transform("t", lambda x: x["role"]), lambda r: r != "system")))
    one = whole.select("conv_id", "t", F.explode(seen).alias("perspective"))
    head = F.transform(
        "t",
        lambda x: F.when(x["role"] == F.col("perspective"), F.lit(f"{OPEN}assistant\n")).when(x["role"] == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), x["role"], F.lit("\n"))),
    )
    one = one.withColumn("head", head)
    one = one.withColumn("rendered", F.array_join(F.transform("t", lambda x, i: F.concat(F.get("head", i), x["text"], F.lit(f"{CLOSE}\n"))), ""))
    # Ends of the turns as running sums of their lengths: start of the text, end of its closing mark, end of the turn.
    sizes = F.transform("t", lambda x, i: F.struct(F.length(F.get("head", i)).cast("long").alias("head"), (F.length(x["text"]) + len(CLOSE)).cast("long").alias("body"), (x["role"] == F.col("perspective")).alias("own")))
    # One fold over the turns: the place reached so far and the spans found so far.
    folded = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + 1).alias("at"),
            F.when(s["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["head"]).alias("start"), (acc["at"] + s["head"] + s["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return one.select("conv_id", "perspective", F.size("t").cast("long").alias("n_turns"), "rendered", folded["spans"].alias("spans"))


def digest(rotated: DataFrame) -> DataFrame:
    """What the query returns of each perspective: sizes, the md5 of the text, and spans as `start-end` text."""
    own = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return rotated.select(
        "conv_id",
        "perspective",
        "n_turns",
        F.size("spans").cast("long").alias("n_own"),
        F.length("rendered").cast("long").alias("n_chars"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_trained"),
        F.md5("rendered").alias("rendered_md5"),
        F.array_join(own, ",").alias("mask"),
    )


#: The digest in SQL over the table conversations: lengths and running sums by window instead of a fold.
DIGEST_SQL = f"""
WITH n AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, trim(regexp_replace(coalesce(role, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS named FROM conversations),
t AS (SELECT conv_id, alone, turn, CASE WHEN named = '' THEN 'unknown' ELSE replace(named, '<|', '< |') END AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM n),
p AS (SELECT DISTINCT conv_id, alone, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, t.alone, p.perspective, t.turn, t.role, t.text, (t.role = p.perspective) AS own,
    CASE WHEN t.role = p.perspective THEN '{OPEN}assistant' || chr(10) WHEN t.role = 'system' THEN '{OPEN}system' || chr(10) ELSE '{OPEN}user name=' || t.role || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.alone IS NOT DISTINCT FROM p.alone),
s AS (
  SELECT *, length(head) AS h, length(text) + {len(CLOSE)} AS b,
    coalesce(sum(length(head) + length(text) + {len(CLOSE)} + 1) OVER (PARTITION BY conv_id, alone, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM r)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, CAST(sum(h + b + 1) AS BIGINT) AS n_chars,
  CAST(coalesce(sum(b) FILTER (WHERE own), 0) AS BIGINT) AS n_trained,
  md5(string_agg(head || text || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS rendered_md5,
  coalesce(string_agg(CAST(CAST(pos + h AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + h + b AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '') AS mask
FROM s GROUP BY conv_id, alone, perspective
"""
