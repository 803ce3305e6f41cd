"""Graph metrics against small cases and brute force."""

from __future__ import annotations

import itertools
import random
from unittest.mock import MagicMock

import pytest

from crawlweave.operators import graph as G


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(list(edges), "src string, dst string")


def as_dict(df, column):
    return {r["node"]: r[column] for r in df.collect()}


BRIDGE = (["home", "hub", "service", "blog", "article", "isolated", "child"], [("home", "hub"), ("hub", "service"), ("service", "hub"), ("hub", "blog"), ("blog", "article"), ("article", "hub"), ("isolated", "child"), ("child", "isolated")])


def test_depth_and_orphans(spark):
    nodes, edges = frames(spark, ["home", "about", "contact", "orphan"], [("home", "about"), ("about", "contact"), ("about", "outside"), ("outside", "contact")])
    rows = {r["node"]: r for r in G.link_metrics(nodes, edges, "home").collect()}
    assert [rows[n]["crawl_depth"] for n in ("home", "about", "contact", "orphan")] == [0, 1, 2, None]
    assert rows["orphan"]["orphan_risk_flag"] == 1 and rows["home"]["orphan_risk_flag"] == 0
    assert rows["about"]["nav_linked_flag"] == 1 and rows["about"]["outlinks"] == 2


def test_depths_go_on_until_the_frontier_is_empty(spark, monkeypatch):
    """1200 levels, as of a chain of pages, with stand-ins for the frames."""
    levels = iter([False] * 1200 + [True])
    frontier = MagicMock()
    frontier.isEmpty.side_effect = lambda: next(levels)
    monkeypatch.setattr(G, "kept", lambda df: frontier)
    G.depths(MagicMock(), "home")
    assert next(levels, None) is None


def test_www_is_folded(spark):
    df = spark.createDataFrame([("https://www.example.com/a",), ("https://example.com/a",), ("https://blog.example.com/a",)], "u string")
    assert [r[0] for r in df.select(G.node_key(df.u, "example.com")).collect()] == ["https://example.com/a", "https://example.com/a", "https://blog.example.com/a"]


def test_bridge_graph(spark):
    nodes, edges = frames(spark, *BRIDGE)
    rows = {r["node"]: r for r in G.graph_metrics(nodes, edges).collect()}
    assert rows["hub"]["bridge_flag"] == 1 and rows["service"]["bridge_flag"] == 0
    assert rows["hub"]["internal_pagerank"] > rows["home"]["internal_pagerank"]
    assert rows["hub"]["betweenness"] > max(rows["service"]["betweenness"], rows["blog"]["betweenness"])
    assert rows["hub"]["closeness"] > rows["service"]["closeness"]
    assert rows["hub"]["community_id"] == 1 and rows["isolated"]["community_id"] == 2
    assert sum(r["internal_pagerank"] for r in rows.values()) == pytest.approx(1)


def test_random_graph_against_brute_force(spark):
    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(14)]
    links = {(a, b) for a, b in itertools.permutations(names, 2) if rng.random() < 0.09}
    nodes, edges = frames(spark, names, links)
    # Shortest paths by powers of the adjacency relation.
    paths = {a: {a: (0, 1)} for a in names}
    for a in names:
        level, d = {a: 1}, 0
        while level:
            d += 1
            following: dict = {}
            for v, n in level.items():
                for s, w in links:
                    if s == v and w not in paths[a]:
                        following[w] = following.get(w, 0) + n
            paths[a] |= {w: (d, n) for w, n in following.items()}
            level = following
    close, between = {}, dict.fromkeys(names, 0.0)
    for a in names:
        total, reached = sum(d for d, _ in paths[a].values()), len(paths[a]) - 1
        close[a] = reached / total * reached / 13 if total else 0.0
        for b in paths[a]:
            for v in names:
                if v not in (a, b) and a != b and v in paths[a] and b in paths[v] and paths[a][v][0] + paths[v][b][0] == paths[a][b][0]:
                    between[v] += paths[a][v][1] * paths[v][b][1] / paths[a][b][1]
    assert as_dict(G.closeness(nodes, edges), "closeness") == pytest.approx(close)
    assert as_dict(G.betweenness(nodes, edges), "betweenness") == pytest.approx({v: x / (13 * 12) for v, x in between.items()})

    def parts(without):
        left, n = set(names) - {without}, 0
        while left:
            n += 1
            todo = [left.pop()]
            while todo:
                v = todo.pop()
                for s, w in links:
                    for x, y in ((s, w), (w, s)):
                        if x == v and y in left:
                            left.discard(y)
                            todo.append(y)
        return n

    whole = parts(None)
    assert as_dict(G.bridges(nodes, edges), "bridge_flag") == {v: int(parts(v) > whole) for v in names}


def test_larger_graphs_are_zero(spark):
    nodes, edges = frames(spark, [f"n{i}" for i in range(G.MOST_BETWEENNESS + 1)], [("n0", "n1"), ("n1", "n2")])
    assert set(as_dict(G.betweenness(nodes, edges), "betweenness").values()) == {0.0}
