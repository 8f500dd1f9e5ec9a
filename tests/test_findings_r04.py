"""The finding of round 4: links meet as numbers, and rounds of the rank carry only the edges that they change."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlsight.operators import graph, site
from crawlsight.plans import adapters
from test_findings_r03 import SMALL, against_sql


@pytest.mark.parametrize("name", ["link_graph_seo_pagerank", "link_graph_pagerank"])
def test_ranks_equal_the_sql(spark, monkeypatch, name):
    monkeypatch.setattr(site, "link_rows", None)
    monkeypatch.setattr(graph, "link_rows", None)  # no link is formed on its own
    against_sql(spark, SMALL, name)


def test_numbers_spell_the_links(spark):
    found = adapters.numbered_links(spark, SMALL).select(adapters.address(F.col("src")).alias("src"), adapters.address(F.col("dst")).alias("dst"))
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, adapters.links_of(spark, SMALL).select("src", "dst").collect()))


def plain(edges, n_nodes, rounds=graph.ROUNDS):
    out = Counter(s for s, _ in edges)
    score = dict.fromkeys(n_nodes, 1 / len(n_nodes))
    for _ in range(rounds):
        score = {k: 0.15 + 0.85 * sum(score[s] / out[s] for s, d in edges if d == k) for k in score}
    low, high = min(score.values()), max(score.values())
    return {k: round((v - low) / (high - low), 6) for k, v in score.items()}


EDGES = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "y"), ("a", "y"), ("z", "x"), ("y", "w"), ("b", "y")]


@pytest.mark.parametrize("rounds", [1, 2, 3, 6, 20])
def test_rounds_read_only_edges_between_linked_and_linking_pages(spark, monkeypatch, rounds):
    kept = {}
    real = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: kept.setdefault(name, real(df, name)) if name == "rank-edges" else real(df, name))
    names = sorted({x for e in EDGES for x in e} | {"alone"})
    got = graph.pagerank(spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame([(x,) for x in names], "id string"), rounds=rounds)
    assert {r["id"]: r["score"] for r in got.collect()} == plain(EDGES, names, rounds)
    # z alone isn't linked; w alone links nowhere.
    assert kept["rank-edges"].count() == len(EDGES) - 1 and kept["rank-edges"].filter("inner").count() == len(EDGES) - 2


def test_edges_of_pages_that_nothing_links_to_alone(spark):
    """No round has an edge to read."""
    edges = [("a", "b"), ("c", "b"), ("c", "d")]
    got = graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in "abcd"], "id string"))
    assert {r["id"]: r["score"] for r in got.collect()} == plain(edges, "abcd")
    none = graph.pagerank(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("a",), ("b",)], "id string"))
    assert {tuple(r) for r in none.collect()} == {("a", 0.0), ("b", 0.0)}


@pytest.mark.parametrize("useful", [False, True])
def test_numbered_links_are_the_graph_of_the_pages(spark, useful):
    """Addresses with one key, dead and older pages, files, the cart as source and target, self links and links to nothing known."""
    host = "https://x.example"
    texts = [f"{host}{x}" for x in ("/a", "/a#top", "/b/", "/b", "/c", "/d.pdf", "/cart", "/pages/dead", "/e", "/pages/unknown", "/a?utm_source=m", "/f", "/account/only")]
    at = {t.removeprefix(host): i for i, t in enumerate(texts)}
    pages = [("/a", 200, 1), ("/a#top", 200, 2), ("/b", 200, 3), ("/c", 200, 4), ("/cart", 200, 5), ("/pages/dead", 404, 6), ("/d.pdf", 200, 7), ("/e", 200, 8), ("/alone", 200, 9)]
    linked = {
        "/a": ["/pages/unknown"], "/a#top": ["/b/", "/b", "/a", "/c", "/d.pdf", "/cart"], "/b": ["/a?utm_source=m", "/a", "/c", "/e"], "/c": ["/a#top", "/b/"], "/cart": ["/f", "/a"],
        "/pages/dead": ["/pages/unknown", "/c"], "/d.pdf": ["/a", "/e"], "/e": ["/cart", "/account/only", "/e"],
    }
    own = spark.createDataFrame([(f"{host}{p}", f"{host}{p}", "page", s, i, [(f"{host}{x}", True) for x in linked.get(p, [])]) for p, s, i in pages], "url string, finalUrl string, pageType string, status int, crawl_seq long, links array<struct<href string, internal boolean>>")
    own = site.keyed(own).withColumn("discoverySource", F.lit(None).cast("string"))
    edges = graph.edges(own)
    nodes = graph.nodes(edges, own)
    want = (graph.seo_pagerank if useful else graph.pagerank)(edges, nodes)
    numbers = [(at[p], at[x]) for p in linked for x in linked[p]] * 2
    address = lambda n: F.get(F.array(*map(F.lit, texts)), n.cast("int"))
    got = graph.pagerank_of_links(own, spark.createDataFrame(numbers + [(None, 1), (1, None)], "src long, dst long"), address, useful)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() > 6
