"""robots.txt texts as rules, and what they allow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import small

KEPT = ("allow", "disallow", "crawl-delay", "sitemap")


def rules(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, user_agent, directive, value: rules in order; the last user-agent before a rule is its own."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.split_part("line", F.lit("#"), F.lit(1)))).where(F.col("line").contains(":"))
    lines = lines.select(key, "pos", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("directive"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agent = F.coalesce(F.last(F.when(F.col("directive") == "user-agent", F.col("value")), ignorenulls=True).over(before), F.lit("*"))
    return lines.withColumn("user_agent", agent).where(F.col("directive").isin(*KEPT)).select(key, "pos", "user_agent", "directive", "value")


def allowed(path: Column, path_rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether the first rule whose prefix the path has allows it; true where none does."""
    out = F.lit(True)
    for prefix, allow in reversed(list(path_rules)):
        out = F.when(path.startswith(prefix), F.lit(allow)).otherwise(out)
    return out


def allowed_by_rules(urls: DataFrame, path: str, found: DataFrame, agent: str) -> DataFrame:
    """Adds allowed: rules of the agent's own group if there are any, else of `*`; the first that fits counts. Rules are few: they are counted, then broadcast."""
    mine = found.where(F.col("directive").isin("allow", "disallow"))
    own = mine.where(F.lower(F.lit(agent)).contains(F.lower("user_agent")) & (F.col("user_agent") != "*"))
    use = own if not own.isEmpty() else mine.where("user_agent = '*'")
    use = use.where("value <> ''").select("pos", F.col("value").alias("prefix"), (F.col("directive") == "allow").alias("allow"))
    first = F.array_sort(F.collect_list(F.struct("pos", "prefix", "allow")))
    listed = small(use.agg(first.alias("__rules")))
    hit = F.filter("__rules", lambda r: F.col(path).startswith(r["prefix"]))
    return urls.join(listed, how="cross").withColumn("allowed", F.coalesce(F.get(hit, 0)["allow"], F.lit(True))).drop("__rules")


def crawl_delay(found: DataFrame, agent: str) -> DataFrame:
    """delay of an agent: of the longest matching name, else the first of `*`; null where none is given."""
    token = F.lower(F.lit(agent.strip().split(" ")[0].split("/")[0]))
    name = F.lower(F.trim("user_agent"))
    delays = found.where(F.col("directive") == "crawl-delay").select("pos", name.alias("name"), F.col("value").try_cast("double").alias("delay")).where("delay >= 0")
    fits = delays.where((F.col("name") == "*") | token.startswith(F.col("name")) | token.contains(F.col("name")))
    return fits.agg(F.min_by("delay", F.struct((F.col("name") == "*"), -F.length("name"), F.col("pos"))).alias("delay"))
