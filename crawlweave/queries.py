"""The engine's operators bound to the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import graph as G
from .operators import relational as R
from .operators import webgraph as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- scans, filters, projections ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice, coalesce(o_orderpriority, '') AS priority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def scan_filter_project(spark, d):
    o = R.filtered(t(spark, d, "orders"), [F.col("o_orderstatus") == "F", F.col("o_totalprice") >= 1000, F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"), None])
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%d_w%' OR lower(p_brand) LIKE '%d_w%' OR lower(p_type) LIKE '%d_w%'")
def text_search_or(spark, d):
    return R.text_search(t(spark, d, "part"), ["p_name", "p_brand", "p_type"], "D_W").select("p_partkey", "p_name", "p_type")


@query("SELECT page_id, url, regexp_matches(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)), '\\.(jpg|jpeg|png|gif|svg|pdf|zip|ico|webp)$') AS binary_asset, url LIKE '%.html%' AS has_html FROM pages")
def url_filters(spark, d):
    return t(spark, d, "pages").select("page_id", "url", C.binary_asset(F.col("url")).alias("binary_asset"), F.col("url").like("%.html%").alias("has_html"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginate(spark, d):
    return R.page_of(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 25)


@query("SELECT * FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) AS q LIMIT 1000")
def adhoc_sql(spark, d):
    from .plans.insights import adhoc

    return adhoc(spark, {"orders": t(spark, d, "orders")}, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", 1000)


# --- joins -------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def left_join_defaults(spark, d):
    totals = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return R.left_with_defaults(t(spark, d, "customer").select("c_custkey", "c_name"), totals, ["c_custkey"], {"n_orders": 0, "total": 0.0})


@query("SELECT l_orderkey, l_linenumber, o_custkey, coalesce(c_mktsegment, 'none') AS segment FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45")
def left_join_chain(spark, d):
    li = t(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return li.join(o, "l_orderkey", "left").join(c, "o_custkey", "left").withColumn("segment", F.coalesce("segment", F.lit("none"))).select("l_orderkey", "l_linenumber", "o_custkey", "segment")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, d):
    big = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_missing(spark, d):
    big = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_anti")


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01')")
def in_subquery(spark, d):
    old = t(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1994-01-01").cast("timestamp")).select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").join(old, "l_orderkey", "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer ORDER BY n_orders DESC, c_custkey LIMIT 50")
def scalar_count_project(spark, d):
    o = t(spark, d, "orders").select("o_custkey")
    counted = R.with_match_count(t(spark, d, "customer").select("c_custkey"), o, {"c_custkey": "o_custkey"}, "n_orders")
    return counted.orderBy(F.col("n_orders").desc(), "c_custkey").limit(50)


@query("""SELECT p.p_partkey, p.p_name, (n.u IS NOT NULL OR m.u IS NOT NULL) AS found FROM part p
LEFT JOIN (SELECT DISTINCT l_partkey AS u FROM lineitem WHERE l_quantity = 50) n ON n.u = p.p_partkey
LEFT JOIN (SELECT DISTINCT l_partkey AS u FROM lineitem WHERE l_discount = 0.1) m ON m.u = p.p_partkey""")
def membership_either(spark, d):
    li = t(spark, d, "lineitem")
    a = li.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("a", F.lit(True))
    b = li.where(F.col("l_discount") == 0.1).select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("b", F.lit(True))
    both = t(spark, d, "part").select("p_partkey", "p_name").join(a, "p_partkey", "left").join(b, "p_partkey", "left")
    return both.select("p_partkey", "p_name", (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("found"))


_LINK_SQL = """
WITH e AS (SELECT DISTINCT l_suppkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7),
k AS (SELECT l_suppkey AS id, round(avg(l_discount), 6) AS harmonic_centrality, round(avg(l_tax), 6) AS pagerank FROM lineitem GROUP BY l_suppkey),
q AS (SELECT s_name AS domain, CAST(s_nationkey AS BIGINT) AS num_hosts, harmonic_centrality, pagerank FROM e JOIN supplier ON s = s_suppkey LEFT JOIN k ON k.id = s_suppkey),
o AS (SELECT *, row_number() OVER (ORDER BY coalesce(harmonic_centrality, 0) DESC, coalesce(pagerank, 0) DESC, coalesce(num_hosts, 0) DESC, domain) - 1 AS place FROM q)
"""


def _linking(spark, d):
    li = t(spark, d, "lineitem")
    edges = li.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    wanted = t(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("target_id"))
    ranks = li.groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.avg("l_discount"), 6).alias("harmonic_centrality"), F.round(F.avg("l_tax"), 6).alias("pagerank"))
    vertices = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("domain"), F.col("s_nationkey").cast("long").alias("num_hosts"))
    return W.linking(edges, wanted, vertices, ranks, 100)


@query(_LINK_SQL + "SELECT domain, num_hosts, harmonic_centrality, pagerank, place, CASE WHEN place < 10 THEN 'top_10' WHEN place < 25 THEN 'top_25' WHEN place < 50 THEN 'top_50' ELSE 'top_100' END AS rank_bucket FROM o WHERE place < 100")
def linking_entities_topk(spark, d):
    return W.rank_buckets(_linking(spark, d))


@query(_LINK_SQL + "SELECT count(*) AS referring, round(sum(harmonic_centrality * 1000 + pagerank * 1000000), 2) AS weighted_score, round(avg(harmonic_centrality), 6) AS avg_harmonic, round(avg(pagerank), 6) AS avg_pagerank, round(max(harmonic_centrality * 1000 + pagerank * 1000000) / sum(harmonic_centrality * 1000 + pagerank * 1000000), 6) AS top_concentration FROM o WHERE place < 100")
def referrer_aggregates(spark, d):
    a = W.referrer_aggregates(_linking(spark, d))
    return a.select("referring", F.round("weighted_score", 2).alias("weighted_score"), *[r6(F.col(c)).alias(c) for c in ("avg_harmonic", "avg_pagerank", "top_concentration")])


_YEARS = "(SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) = {} GROUP BY o_custkey)"


def _year(spark, d, year):
    return t(spark, d, "orders").where(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query(f"SELECT o_custkey, l.v AS left_value, r.v AS right_value, round(r.v - l.v, 2) AS delta FROM {_YEARS.format(1995)} l JOIN {_YEARS.format(1996)} r USING (o_custkey) ORDER BY abs(r.v - l.v) DESC, o_custkey LIMIT 100")
def self_join_compare(spark, d):
    return R.compare_values(_year(spark, d, 1995), _year(spark, d, 1996), "o_custkey", "v", 100).withColumn("delta", F.round("delta", 2))


@query("SELECT o_orderpriority, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1995) AS BIGINT) AS left_count, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1996) AS BIGINT) AS right_count, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1996) - count(*) FILTER (WHERE year(o_orderdate) = 1995) AS BIGINT) AS delta FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY o_orderpriority")
def full_outer_compare(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"))
    return R.compare_counts(o.where("y = 1995"), o.where("y = 1996"), "o_orderpriority")


#: Trade between nations: customer's nation -> supplier's, edges whose number of lines reaches the upper quartile.
TRADE_SQL = """
g AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
e AS (SELECT src, dst FROM g WHERE n >= (SELECT quantile_cont(n, 0.75) FROM g))
"""


def _trade(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    counted = G.kept(li.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").groupBy("src", "dst").agg(F.count("*").alias("n")))
    least = counted.agg(F.percentile("n", F.lit(0.75))).first()[0]
    return G.kept(counted.where(F.col("n") >= F.lit(least)).select("src", "dst"))


def _nations(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


@query(f"WITH {TRADE_SQL} SELECT a.src, a.dst FROM e a WHERE a.dst IN (SELECT n_nationkey FROM nation) AND NOT EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src)")
def reciprocity_missing(spark, d):
    return R.reciprocity_missing(_trade(spark, d), _nations(spark, d), "src", "dst", "node").select("src", "dst")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return R.latest_per_key(t(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


_RULES = [("/en/", 1, 1), ("/de/1", 0, 2), ("/", 1, 3)]


@query("""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('/en/', 1, 1), ('/de/1', 0, 2), ('/', 1, 3)) v(prefix, allow, seq))
SELECT page_id, path, CAST(coalesce((SELECT arg_min(allow, seq) FROM r WHERE starts_with(p.path, r.prefix)), 1) AS INTEGER) AS allowed FROM p""")
def rule_prefix_match(spark, d):
    from .sources.robots import allowed

    p = t(spark, d, "pages").select("page_id", C.path(F.col("url")).alias("path"))
    return p.withColumn("allowed", allowed(F.col("path"), [(prefix, bool(a)) for prefix, a, _ in _RULES]).cast("int"))


# --- aggregations ------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 15")
def group_count_topk(spark, d):
    return R.top_counts(t(spark, d, "events"), ["event_type"], 15)


@query("SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, d):
    out = None
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        n = t(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT 'o_orderpriority' AS facet, coalesce(nullif(trim(o_orderpriority), ''), 'none') AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', coalesce(nullif(trim(o_orderstatus), ''), 'open'), count(*) FROM orders GROUP BY 2")
def histogram_default(spark, d):
    return R.histograms(t(spark, d, "orders"), {"o_orderpriority": "none", "o_orderstatus": "open"})


@query("SELECT CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1")
def bucket_histogram(spark, d):
    return t(spark, d, "orders").groupBy(R.bucketed(F.col("o_totalprice"), [(300000, "high"), (100000, "medium")], "low").alias("band")).agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5")
def cross_tab_topk(spark, d):
    return R.top_per_group(t(spark, d, "events"), ["event_type"], "user_id", 5)


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def cross_tab_pivot(spark, d):
    pivoted = t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return pivoted.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("SELECT round(avg(l_extendedprice), 2) AS avg_price, CAST(trunc(quantile_cont(l_extendedprice, 0.5)) AS INTEGER) AS median_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem")
def stats_summary(spark, d):
    x = F.col("l_extendedprice")
    return t(spark, d, "lineitem").agg(F.round(F.avg(x), 2).alias("avg_price"), F.percentile(x, F.lit(0.5)).cast("int").alias("median_price"), F.min(x).alias("min_price"), F.max(x).alias("max_price"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def percentile_cutoffs(spark, d):
    q = lambda p: r6(F.percentile("l_quantity", F.lit(p)))
    return t(spark, d, "lineitem").where("l_quantity > 0").groupBy("l_returnflag").agg(q(0.25).alias("p25"), q(0.9).alias("p90"))


@query("SELECT count(*) AS clusters, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_clusters FROM (SELECT md5(text), count(*) AS n FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1)")
def dup_clusters_having(spark, d):
    return R.duplicate_clusters(t(spark, d, "documents"), F.md5("text"))


@query("SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    # Texts are ASCII-spaced here, so that both engines squeeze the same white space.
    docs = t(spark, d, "documents").where("trim(text) <> ''").select("doc_id", C.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT l_orderkey, l_linenumber, round((CASE WHEN l_discount > 0.02 THEN l_discount * 100 * 0.5 ELSE 0 END + l_tax * 100 * 0.3 + CASE WHEN l_quantity < 40 THEN l_quantity * 0.2 ELSE 0 END) / (CASE WHEN l_discount > 0.02 THEN 0.5 ELSE 0 END + 0.3 + CASE WHEN l_quantity < 40 THEN 0.2 ELSE 0 END), 6) AS score, round((CASE WHEN l_discount > 0.02 THEN 0.5 ELSE 0 END + 0.3 + CASE WHEN l_quantity < 40 THEN 0.2 ELSE 0 END) * 100, 6) AS coverage FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
def weighted_present_avg(spark, d):
    li = t(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp"))
    li = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("c"))
    score, coverage = R.weighted_present({"a": 0.5, "b": 0.3, "c": 0.2})
    return li.select("l_orderkey", "l_linenumber", r6(score).alias("score"), r6(coverage).alias("coverage"))


@query("SELECT l_shipmode, round(clicks, 2) AS clicks, round(clicks / shown, 6) AS ratio, round(place, 6) AS mean_place FROM (SELECT l_returnflag AS l_shipmode, sum(l_discount * l_quantity) AS clicks, sum(l_quantity) AS shown, avg(l_tax) AS place FROM lineitem GROUP BY 1)")
def ratio_of_sums(spark, d):
    a = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.sum(F.col("l_discount") * F.col("l_quantity")).alias("clicks"), F.sum("l_quantity").alias("shown"), F.avg("l_tax").alias("place"))
    return a.select("l_shipmode", F.round("clicks", 2).alias("clicks"), r6(F.col("clicks") / F.col("shown")).alias("ratio"), r6(F.col("place")).alias("mean_place"))


@query("SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice * power(0.5, r - 1)), 4) AS decayed, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC) AS r FROM lineitem) GROUP BY ALL")
def decay_rank_sum(spark, d):
    return R.decayed_sums(t(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_extendedprice", 0.5).withColumn("decayed", F.round("decayed", 4))


@query("SELECT trim(token) AS token, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS token FROM part) WHERE trim(token) <> '' GROUP BY 1")
def token_explode_hist(spark, d):
    return R.tokens(t(spark, d, "part"), "p_type", " ")


@query("SELECT event_type, count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL) AS with_k, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) AS avg_k, CAST(max(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS INTEGER) AS max_k FROM events GROUP BY event_type")
def json_extract_agg(spark, d):
    k = C.json_value(F.col("props"), "$.k", "int")
    return t(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("with_k"), r6(F.avg("k")).alias("avg_k"), F.max("k").alias("max_k"))


_STATUS = ["view", "click", "cart", "purchase"]


@query("""WITH s AS (SELECT user_id, event_type, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'cart' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS r FROM events WHERE value > 50 UNION ALL SELECT user_id, event_type, event_id + 1000000, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'cart' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END FROM events WHERE value <= 50)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, event_id DESC) AS rn FROM s) WHERE rn = 1""")
def best_status_by_key(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    both = e.where("value > 50").unionByName(e.where("value <= 50").withColumn("event_id", F.col("event_id") + 1000000))
    return R.best_status(both.withColumn("r", R.ranks(F.col("event_type"), _STATUS)), "user_id", "event_type", "r", "event_id")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_event_of_type(spark, d):
    return R.latest_per_key(t(spark, d, "events").select("event_type", "user_id", "event_id"), ["event_type"], ["event_id"])


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def distinct_counts(spark, d):
    return t(spark, d, "lineitem").agg(*[F.countDistinct(c).alias(n) for c, n in (("l_partkey", "parts"), ("l_suppkey", "suppliers"), ("l_returnflag", "flags"))])


# --- windows -----------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F'), o_orderkey) AS rn FROM orders) WHERE rn = 1")
def rep_per_cluster(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("alias"))
    return R.first_per_key(o, ["o_custkey"], ["alias", "o_orderkey"]).drop("alias")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def cluster_budget(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.within_budget(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY user_id) AS members, count(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id) AS strong FROM events")
def cluster_counts(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    per = e.groupBy("user_id").agg(F.count("*").alias("members"), F.count_if(F.col("value") > 50).alias("strong"))
    return e.join(per, "user_id").select("event_id", "event_type", "members", "strong")


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT event_id, user_id, changed, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS streak FROM i""")
def change_flag_streak(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return R.change_streaks(e, "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "changed", "streak")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t(spark, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query("SELECT o_orderkey, o_orderpriority, CAST(floor(n / w) AS BIGINT) AS round FROM (SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS w FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))")
def weighted_round_robin(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return R.round_robin(o, "o_orderpriority", {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_orderpriority", "round")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY (o_orderstatus <> 'F'), o_totalprice, o_orderkey LIMIT 200")
def plan_order(spark, d):
    return t(spark, d, "orders").orderBy(F.col("o_orderstatus") != "F", "o_totalprice", "o_orderkey").limit(200).select("o_orderkey", "o_orderstatus", "o_totalprice")


# --- sets --------------------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 5")
def set_difference(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_returnflag", "l_quantity")
    return li.where("l_returnflag = 'R' AND l_quantity < 3").select("partkey").subtract(li.where("l_returnflag = 'A' AND l_quantity < 5").select("partkey"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def key_union(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("""SELECT k, frame FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY frame, seq) AS rn FROM (
SELECT c_nationkey AS k, 0 AS frame, c_custkey AS seq FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier)) WHERE rn = 1""")
def ordered_union_first_seen(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(0).alias("frame"), F.col("c_custkey").alias("seq"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("frame"), F.col("s_suppkey").alias("seq"))
    return R.first_seen(c, s, key="k").select("k", "frame")


@query("""WITH a AS (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag)) AS x, list_sort(list(DISTINCT l_linestatus)) AS y FROM lineitem GROUP BY 1)
SELECT l_suppkey, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS only_x, array_to_string(list_sort(list_intersect(x, y)), ',') AS shared FROM a""")
def array_set_ops(spark, d):
    a = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("x"), F.collect_set("l_linestatus").alias("y"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return a.select("l_suppkey", text(F.array_except("x", "y")).alias("only_x"), text(F.array_intersect("x", "y")).alias("shared"))


# --- URLs and text -----------------------------------------------------------------------------------------------------


@query("SELECT page_id, ('0x' || substr(md5(url), 1, 8))::BIGINT::DOUBLE / 4294967296 < 0.25 AS sampled FROM pages WHERE (('0x' || substr(md5(url), 1, 8))::BIGINT::DOUBLE * 4294967296 + ('0x' || substr(md5(url), 9, 8))::BIGINT::DOUBLE) / 18446744073709551616.0 < 0.25")
def hash_sample(spark, d):
    return R.hash_sampled(t(spark, d, "pages").select("page_id", "url"), "url", 0.25).select("page_id", F.lit(True).alias("sampled"))


_URL = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


@query(f"SELECT page_id, lower(regexp_extract(url, '{_URL}(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '{_URL}[^/?#]*([^?#]*)', 1), ''), '/') AS path, lower(regexp_extract(coalesce(nullif(regexp_extract(url, '{_URL}[^/?#]*([^?#]*)', 1), ''), '/'), '^/*([^/]*)', 1)) AS first_segment, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", C.host(u).alias("host"), C.path(u).alias("path"), C.first_segment(u).alias("first_segment"), C.query(u).alias("query"))


@query(f"SELECT host, array_to_string(list_reverse(string_split(host, '.')), '.') AS reversed, n FROM (SELECT regexp_replace(lower(regexp_extract(url, '{_URL}([^/?#:]*)', 1)), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1)")
def reverse_domain(spark, d):
    hosts = t(spark, d, "pages").groupBy(C.domain_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return hosts.select("host", C.reversed_labels(F.col("host")).alias("reversed"), "n")


@query("SELECT page_id, CASE WHEN regexp_matches(q, '(^|&)(sort|order|view|variant)=') THEN 'canonical_candidate_duplicate' WHEN regexp_matches(q, '(^|&)(preview|amp|variant)=') THEN 'crawl_once_diagnostic' ELSE 'crawl_normally' END AS policy FROM (SELECT page_id, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages)")
def url_policy(spark, d):
    return t(spark, d, "pages").select("page_id", C.url_policy(F.col("url")).alias("policy"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q, lower(coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), ''), '/')) AS path FROM pages),
s AS (SELECT *, len(list_filter(string_split(q, '&'), lambda x: x <> '')) AS n, CAST(regexp_matches(q, '(^|&)page=') AS INTEGER) AS risky FROM p),
r AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(1.0, greatest(0.0, risky / n::DOUBLE * 0.7 + least(1.0, n / 10.0::DOUBLE) * 0.3)) END AS risk, CASE WHEN path = '/' THEN 1.0 ELSE 0.5 END AS importance, CASE WHEN path = '/' THEN 1.0 ELSE 0.25 END AS prominence FROM s)
SELECT page_id, round(greatest(0, least(999, importance * 220 + prominence * 140 + 0.55 * 45 - risk * 130 - 14)), 4) AS priority FROM r""")
def frontier_priority(spark, d):
    u = F.col("url")
    root = C.path(u) == "/"
    signals = {"template_importance": F.when(root, 1.0).otherwise(0.5), "internal_prominence": F.when(root, 1.0).otherwise(0.25), "canonical_confidence": F.lit(0.55), "query_risk": C.query_risk(u, ["page"])}
    return t(spark, d, "pages").select("page_id", C.frontier_priority(signals, F.lit(1)).alias("priority"))


_TRACKING = ", ".join(f"'{x}'" for x in sorted(C.TRACKING))


@query(f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, scheme || '://' || host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS normalized
FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({_TRACKING}))) AS k FROM u)""")
def url_normalize(spark, d):
    return t(spark, d, "pages").select("page_id", C.normalize_url("url").alias("normalized"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<script')) AS scripts FROM pages")
def page_regex_facts(spark, d):
    h = F.col("html")
    return t(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("raw_title"), F.regexp_count(h, F.lit("<a ")).cast("long").alias("links"), F.regexp_count(h, F.lit("<script")).cast("long").alias("scripts"))


@query()
def page_extract(spark, d):
    from .sources.html import extract

    return extract(t(spark, d, "pages"), "page_id", "url", "html").select("page_id", "title", "h1", "h1_count", "word_count", "internal_links_out", "external_links_out", "image_count", "canonical_url")


@query()
def page_classify(spark, d):
    from .functions.classify import classify
    from .sources.html import extract

    facts = extract(t(spark, d, "pages"), "page_id", "url", "html")
    return facts.select("page_id", classify(F.col("url"), F.col("title"), F.col("h1")).alias("c")).select("page_id", "c.page_type", "c.confidence")


# --- diff --------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, lang, source, n_chars FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, source, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents)
SELECT doc_id, 'lang' AS family, p.lang AS old_value, c.lang AS new_value, 'medium' AS severity FROM p JOIN c USING (doc_id) WHERE p.lang <> c.lang
UNION ALL SELECT doc_id, 'n_chars', CAST(p.n_chars AS VARCHAR), CAST(c.n_chars AS VARCHAR), 'low' FROM p JOIN c USING (doc_id) WHERE p.n_chars <> c.n_chars""")
def page_diff_unpivot(spark, d):
    from .plans.diff import unpivot_diffs

    p = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    c = p.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return unpivot_diffs(c, p, ["doc_id"], {"lang": ("medium", F.col("lang")), "source": ("low", F.col("source")), "n_chars": ("low", F.col("n_chars").cast("string"))})


# --- graph -------------------------------------------------------------------------------------------------------------

_ORPHAN = """SELECT n_nationkey AS node, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS inlinks, (SELECT count(*) FROM e WHERE src = n_nationkey) AS outlinks, CAST(EXISTS (SELECT 1 FROM e WHERE dst = n_nationkey AND src = 0) AS INTEGER) AS nav_linked_flag, CAST(((SELECT count(*) FROM e WHERE dst = n_nationkey) = 0 AND n_nationkey <> 0) AS INTEGER) AS orphan_risk_flag"""


@query(f"""WITH RECURSIVE {TRADE_SQL}, b(node, depth) AS (SELECT 0, 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 25)
{_ORPHAN}, (SELECT min(depth) FROM b WHERE b.node = n_nationkey) AS crawl_depth FROM nation""")
def degree_orphan_depth(spark, d):
    return G.link_metrics(_nations(spark, d), _trade(spark, d), 0).select("node", "inlinks", "outlinks", "nav_linked_flag", "orphan_risk_flag", "crawl_depth")


@query(f"""WITH RECURSIVE {TRADE_SQL}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, u.dst FROM r JOIN u ON r.b = u.src),
m AS (SELECT a AS node, min(b) AS root, count(*) AS size FROM r GROUP BY a), k AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) AS community_id FROM (SELECT DISTINCT root, size FROM m))
SELECT node, community_id, m.size FROM m JOIN k USING (root)""")
def components(spark, d):
    return G.communities(_nations(spark, d), _trade(spark, d))


_STEPS = 80


@query(f"""WITH RECURSIVE {TRADE_SQL}, n AS (SELECT n_nationkey AS node FROM nation), deg AS (SELECT src, count(*) AS k FROM e GROUP BY src), c AS (SELECT count(*) AS n FROM n),
it(i, node, score) AS (SELECT 0, node, 1.0 / (SELECT n FROM c) FROM n UNION ALL
SELECT i + 1, n.node, (0.15 / (SELECT n FROM c) + 0.85 * coalesce((SELECT sum(p.score) FROM it p WHERE p.node NOT IN (SELECT src FROM deg)), 0) / (SELECT n FROM c) + 0.85 * coalesce((SELECT sum(p.score / deg.k) FROM it p JOIN e ON e.src = p.node JOIN deg ON deg.src = p.node WHERE e.dst = n.node), 0))
FROM n, (SELECT max(i) AS i FROM it) WHERE i < {_STEPS})
SELECT node, round(score / (SELECT sum(score) FROM it WHERE i = {_STEPS}), 6) AS pagerank FROM it WHERE i = {_STEPS}""")
def pagerank(spark, d):
    return G.pagerank(_nations(spark, d), _trade(spark, d)).select("node", r6(F.col("pagerank")).alias("pagerank"))


@query(f"""WITH RECURSIVE {TRADE_SQL}, b(s, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT b.s, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 24),
m AS (SELECT s, node, min(depth) AS depth FROM b GROUP BY ALL), z AS (SELECT s, count(*) - 1 AS reached, sum(depth) AS total FROM m GROUP BY s)
SELECT s AS node, round(CASE WHEN total > 0 THEN reached / total::DOUBLE * reached / 24.0 ELSE 0 END, 6) AS closeness FROM z""")
def closeness(spark, d):
    return G.closeness(_nations(spark, d), _trade(spark, d)).select("node", r6(F.col("closeness")).alias("closeness"))


@query(f"""WITH RECURSIVE {TRADE_SQL}, b(s, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT b.s, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 24),
m AS (SELECT s, node, min(depth) AS depth FROM b GROUP BY ALL),
w(level, s, node, paths) AS (SELECT 0, n_nationkey, n_nationkey, 1::DOUBLE FROM nation UNION ALL
SELECT * FROM (SELECT any_value(w.level) + 1 AS level, w.s, e.dst, sum(w.paths) AS paths FROM w JOIN e ON e.src = w.node JOIN m ON m.s = w.s AND m.node = e.dst AND m.depth = w.level + 1 WHERE w.level < 24 GROUP BY w.s, e.dst)),
k AS (SELECT sv.node AS v, sum(sv.paths * vt.paths / st.paths) AS part FROM w sv JOIN w vt ON vt.s = sv.node JOIN w st ON st.s = sv.s AND st.node = vt.node AND st.level = sv.level + vt.level WHERE sv.s <> sv.node AND vt.node <> sv.node AND sv.s <> vt.node GROUP BY sv.node)
SELECT n_nationkey AS node, round(coalesce(part, 0) / (24 * 23), 6) AS betweenness FROM nation LEFT JOIN k ON k.v = n_nationkey""")
def betweenness(spark, d):
    return G.betweenness(_nations(spark, d), _trade(spark, d)).select("node", r6(F.col("betweenness")).alias("betweenness"))


@query(f"""WITH RECURSIVE {TRADE_SQL}, u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), v AS (SELECT n_nationkey AS x FROM nation),
r(x, a, b) AS (SELECT v.x, n.n_nationkey, n.n_nationkey FROM v JOIN nation n ON n.n_nationkey <> v.x UNION SELECT r.x, r.a, u.dst FROM r JOIN u ON r.b = u.src WHERE u.dst <> r.x),
k AS (SELECT x, count(DISTINCT least_b) AS parts FROM (SELECT x, a, min(b) AS least_b FROM r GROUP BY x, a) GROUP BY x),
r0(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r0.a, u.dst FROM r0 JOIN u ON r0.b = u.src), k0 AS (SELECT count(DISTINCT m) AS parts FROM (SELECT a, min(b) AS m FROM r0 GROUP BY a))
SELECT v.x AS node, CAST(k.parts > k0.parts AS INTEGER) AS bridge_flag FROM v JOIN k USING (x), k0""")
def articulation(spark, d):
    return G.bridges(_nations(spark, d), _trade(spark, d))


# --- rules and scores --------------------------------------------------------------------------------------------------


def _audit_pages(spark, d):
    """Pages of the driver's table as an audited site: facts of their HTML, one run."""
    from .functions.classify import classify
    from .sources.html import extract

    f = extract(t(spark, d, "pages"), "page_id", "url", "html")
    kind = classify(F.col("url"), F.col("title"), F.col("h1"), F.col("schema_types"))["page_type"]
    facts = f.select(
        "page_id",
        F.lit("run-1").alias("run_id"),
        F.col("url").alias("normalized_url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        kind.alias("page_type"),
        *["title", "meta_description", "h1", "h1_count", "canonical_url", "canonical_count", "word_count", "content_hash", "internal_links_out", "is_noindex", "data_nosnippet_count", "schema_parse_error_count", "rel_next", "rel_prev"],
        F.to_json("schema_types").alias("schema_types_json"),
    )
    return facts.withColumnsRenamed({"rel_next": "rel_next_url", "rel_prev": "rel_prev_url"})


@query()
def audit_findings(spark, d):
    from .plans.rules import enriched, findings

    pages = G.kept(_audit_pages(spark, d))
    return enriched(findings(pages), pages).select("url", "issue_code", "severity", "gate", "reach", "affected_count", "certainty_state", "priority_score")


@query()
def audit_scores(spark, d):
    from .plans.rules import enriched, findings
    from .plans.scoring import score_pages

    pages = G.kept(_audit_pages(spark, d))
    return score_pages(pages, enriched(findings(pages), pages))


# --- state, retention, read side ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, v, seen FROM (SELECT c_custkey, round(c_acctbal, 2) AS v, 'old' AS seen FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, round(max(o_totalprice), 2), 'new' FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)")
def keyed_upsert(spark, d):
    from .streaming.state import merged

    old = t(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("v"), F.lit("old").alias("seen"))
    new = t(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("v")).withColumn("seen", F.lit("new"))
    return merged(old, new, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' AND trim(l_returnflag) <> '{}' THEN '{}' ELSE l_returnflag END AS payload FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def retention_blanking(spark, d):
    from .sources.tables import blank_old

    runs = t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", F.col("l_returnflag").alias("payload"))
    return blank_old(rows, runs, "payload", "1995-01-02", 1).select(F.col("run_id").alias("l_orderkey"), "l_linenumber", "payload")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, CAST(least(99, floor(count(*) FILTER (WHERE event_type = 'purchase') * 100 / 10.0)) AS INTEGER) AS percent FROM events GROUP BY 1")
def event_progress(spark, d):
    from .streaming.state import progress

    return progress(t(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_type"), done="purchase")


@query("SELECT round(sum(l_quantity), 2) AS clicks, round(sum(l_extendedprice), 2) AS impressions, round(sum(l_quantity) / sum(l_extendedprice), 6) AS ctr, round(avg(l_tax), 4) AS position FROM lineitem")
def search_summary(spark, d):
    from .plans.resolution import search_summary as summary

    rows = t(spark, d, "lineitem").select(F.col("l_quantity").alias("clicks"), F.col("l_extendedprice").alias("impressions"), F.col("l_tax").alias("position"))
    return summary(rows).select(F.round("clicks", 2).alias("clicks"), F.round("impressions", 2).alias("impressions"), "ctr", "position")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def frontier_order(spark, d):
    from .plans.queue import frontier

    urls = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("url"), F.col("o_totalprice").alias("priority"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("cluster_key"))
    return frontier(urls, budget=2, most=100).select(F.col("url").alias("o_orderkey"), F.col("priority").alias("o_totalprice"))


@query("SELECT bot, count(*) AS blocked, array_to_string(list_sort(list(event_id))[1:3], ',') AS sample FROM (SELECT unnest(['googlebot', 'bingbot', 'gptbot']) AS bot, unnest([event_id % 3, event_id % 7, event_id % 2]) AS open, event_id FROM events WHERE value < 20) WHERE open = 0 GROUP BY bot")
def governance_blocked(spark, d):
    from .plans.resolution import governance_counts

    flags = {"googlebot": 3, "bingbot": 7, "gptbot": 2}
    e = t(spark, d, "events").where("value < 20").select(F.col("event_id").alias("normalized_url"), *[(F.col("event_id") % n).alias(k) for k, n in flags.items()])
    return governance_counts(e, list(flags), samples=3).select("bot", "blocked", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


from . import queries_site  # noqa: E402, F401  registers the queries over a made-up site
