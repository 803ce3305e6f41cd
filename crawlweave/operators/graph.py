"""Link-graph metrics: degrees, depth, PageRank, components, closeness, betweenness, articulation points.

Edges are a DataFrame (src, dst), nodes a DataFrame (node). Iterations cut their lineage with reliable checkpoints in
spark.checkpoint.dir. Betweenness, closeness and articulation need a whole component's adjacency at hand: they are bounded
by a number of nodes, beyond which they are 0 by definition, so what is broadcast is bounded too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import apex, host

# Sizes beyond which a metric is 0; damping, rounds and tolerance of PageRank.
MOST_BETWEENNESS, MOST_CLOSENESS = 450, 1500
DAMPING, ROUNDS, TOLERANCE = 0.85, 80, 1e-9
EVERY = 8


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if named is None:
            import tempfile

            named = tempfile.mkdtemp(prefix="crawlweave-")
        context.setCheckpointDir(named)
    return df.checkpoint()


def node_key(url: Column, home_host: str) -> Column:
    """A page's key in the graph: the home site's www and apex are one host."""
    bare = home_host.lower().removeprefix("www.")
    return F.when(apex(host(url)) == bare, F.regexp_replace(url, r"(?i)^([a-z]+://)(?:www\.)?" + bare.replace(".", r"\."), "$1" + bare)).otherwise(url)


def distinct_edges(links: DataFrame, source: str, target: str, internal: Column | None = None) -> DataFrame:
    rows = links if internal is None else links.where(internal)
    return rows.select(F.col(source).alias("src"), F.col(target).alias("dst")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def depths(edges: DataFrame, home: object) -> DataFrame:
    """node, depth of everything reachable from home, by rounds of frontier joins; nodes outside the page set count."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(home, 0)], f"node {edges.schema['src'].dataType.simpleString()}, depth int")
    frontier = seen
    for level in count(1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if level % EVERY == 0:
            seen = kept(seen)


def link_metrics(pages: DataFrame, edges: DataFrame, home: object) -> DataFrame:
    """node, inlinks, outlinks, crawl_depth (null: unreachable), nav_linked_flag and orphan_risk_flag of pages."""
    into = edges.groupBy("dst").agg(F.count("*").alias("inlinks"), F.max((F.col("src") == F.lit(home)).cast("int")).alias("nav_linked_flag")).withColumnRenamed("dst", "node")
    out = edges.groupBy("src").agg(F.count("*").alias("outlinks")).withColumnRenamed("src", "node")
    rows = pages.select("node").distinct().join(into, "node", "left").join(out, "node", "left").join(depths(edges, home).withColumnRenamed("depth", "crawl_depth"), "node", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("inlinks", "outlinks", "nav_linked_flag")})
    return rows.withColumn("orphan_risk_flag", ((F.col("inlinks") == 0) & (F.col("node") != F.lit(home))).cast("int"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """node, pagerank: the mass of nodes without links is spread evenly; stops when the change is below the tolerance."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = kept(edges.join(degree, "src").select("src", "dst", "degree"))
    linked = degree.select(F.col("src").alias("node"), F.lit(True).alias("linked"))
    scores = kept(nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("score")))
    for i in range(rounds):
        loose = scores.where(~F.col("linked")).agg(F.sum("score")).first()[0] or 0.0
        share = links.join(scores, links["src"] == scores["node"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("share"))
        new = scores.join(share, scores["node"] == share["dst"], "left").select("node", "linked", (F.lit((1 - DAMPING) / n + DAMPING * loose / n) + DAMPING * F.coalesce("share", F.lit(0.0))).alias("next"), "score")
        new = kept(new)
        change = new.agg(F.sum(F.abs(F.col("next") - F.col("score")))).first()[0]
        scores = new.select("node", "linked", F.col("next").alias("score"))
        if change <= tolerance:
            break
    total = scores.agg(F.sum("score")).first()[0]
    return scores.select("node", (F.col("score") / F.lit(total)).alias("pagerank"))


def component_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component. Labels spread over edges and jump to their labels' labels."""
    both = kept(undirected(edges).where("src <> dst"))
    labels = kept(nodes.select("node", F.col("node").alias("root")))
    while True:
        heard = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("root").alias("heard"))
        new = labels.join(heard, labels["node"] == heard["src"], "left").select("node", F.least("root", F.coalesce("heard", "root")).alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("node").alias("at"), F.col("root").alias("to"))
        new = kept(new.join(jump, new["root"] == jump["at"]).select("node", F.least("root", "to").alias("root"), "old"))
        changed = not new.where("root <> old").isEmpty()
        labels = new.select("node", "root")
        if not changed:
            return labels


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, community_id, size: components numbered from 1 by falling size, then by least node."""
    roots = component_roots(nodes, edges)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    numbers = sizes.withColumn("community_id", F.row_number().over(Window.orderBy(F.col("size").desc(), "root")).cast("long"))
    return roots.join(numbers, "root").select("node", "community_id", "size")


def _adjacency(nodes: DataFrame, edges: DataFrame, most: int) -> dict[object, list] | None:
    """Sorted adjacency of a graph of at most `most` nodes; None for a larger one."""
    names = [r[0] for r in nodes.select("node").distinct().limit(most + 1).collect()]
    if len(names) > most:
        return None
    out: dict[object, list] = {v: [] for v in names}
    # At most most^2 edges.
    for a, b in induced(edges, nodes).distinct().toLocalIterator():
        out[a].append(b)
    return {k: sorted(v) for k, v in out.items()}


def _zero(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select("node").distinct().withColumn(name, F.lit(0.0))


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, closeness over outgoing distances: (reached / sum of distances) * reached / (n - 1)."""
    adjacency = _adjacency(nodes, edges, MOST_CLOSENESS)
    if adjacency is None or len(adjacency) <= 1:
        return _zero(nodes, "closeness")
    n = len(adjacency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = []
            for source in frame["node"]:
                distance, queue = {source: 0}, deque([source])
                while queue:
                    v = queue.popleft()
                    for w in adjacency[v]:
                        if w not in distance:
                            distance[w] = distance[v] + 1
                            queue.append(w)
                reached, total = len(distance) - 1, sum(distance.values())
                scores.append(reached / total * reached / (n - 1) if total else 0.0)
            yield frame.assign(closeness=scores)

    rows = nodes.select("node").distinct()
    return rows.repartition("node").mapInPandas(run, f"node {rows.schema['node'].dataType.simpleString()}, closeness double")


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, betweenness: shares of shortest paths by Brandes' accumulation from each source, over (n - 1)(n - 2)."""
    adjacency = _adjacency(nodes, edges, MOST_BETWEENNESS)
    if adjacency is None or len(adjacency) <= 2:
        return _zero(nodes, "betweenness")
    scale = 1.0 / ((len(adjacency) - 1) * (len(adjacency) - 2))
    kind = nodes.schema["node"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[object, float] = {}
        for frame in frames:
            for source in frame["node"]:
                paths, distance, before, order = {source: 1.0}, {source: 0}, {source: []}, []
                queue = deque([source])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in adjacency[v]:
                        if w not in distance:
                            distance[w], paths[w], before[w] = distance[v] + 1, 0.0, []
                            queue.append(w)
                        if distance[w] == distance[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                owed = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        owed[v] += paths[v] / paths[w] * (1.0 + owed[w])
                    if w != source:
                        total[w] = total.get(w, 0.0) + owed[w]
        yield pd.DataFrame({"node": pd.Series(list(total), dtype=object if kind == "string" else None), "part": pd.Series(list(total.values()), dtype=float)})

    rows = nodes.select("node").distinct()
    parts = rows.repartition("node").mapInPandas(run, f"node {kind}, part double").groupBy("node").agg(F.sum("part").alias("part"))
    return rows.join(parts, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def cut_points(adjacency: dict[object, set]) -> set:
    """Nodes whose removal splits their component, by one depth-first walk without recursion."""
    seen: dict[object, int] = {}
    low: dict[object, int] = {}
    cut = set()
    for start in sorted(adjacency):
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        children = 0
        stack = [(start, None, iter(sorted(adjacency[start])))]
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if parent == start:
                        children += 1
                    elif low[v] >= seen[parent]:
                        cut.add(parent)
            elif w not in seen:
                seen[w] = low[w] = len(seen)
                stack.append((w, v, iter(sorted(adjacency[w]))))
            elif w != parent:
                low[v] = min(low[v], seen[w])
        if children > 1:
            cut.add(start)
    return cut


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, bridge_flag: articulation points of the undirected graph, one task for each component."""
    kind = nodes.schema["node"].dataType.simpleString()
    roots = component_roots(nodes, edges)
    both = undirected(edges).where("src <> dst")
    grouped = roots.join(both, roots["node"] == both["src"]).select("root", "src", "dst")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict[object, set] = {}
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            adjacency.setdefault(a, set()).add(b)
        return pd.DataFrame({"node": pd.Series(sorted(cut_points(adjacency)), dtype=frame["src"].dtype)})

    cut = grouped.groupBy("root").applyInPandas(run, f"node {kind}").withColumn("bridge_flag", F.lit(1))
    return nodes.select("node").distinct().join(cut, "node", "left").select("node", F.coalesce("bridge_flag", F.lit(0)).alias("bridge_flag"))


def graph_metrics(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """All metrics of the nodes, over the edges between them."""
    edges = kept(induced(links, nodes))
    return (
        pagerank(nodes, edges)
        .withColumnRenamed("pagerank", "internal_pagerank")
        .join(betweenness(nodes, edges), "node")
        .join(closeness(nodes, edges), "node")
        .join(communities(nodes, edges).drop("size"), "node")
        .join(bridges(nodes, edges), "node")
    )
