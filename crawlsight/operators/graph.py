"""The link graph: edges, nodes, degrees, PageRank and depth.

Loops run on the driver and hold only plans; every few rounds the lineage is cut
by a table in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as u
from .lineage import portions, saved
from .rules import not_in_html
from .site import link_rows

ROUNDS, DAMPING, CUT_EVERY = 20, 0.85, 5
LINKS_A_TASK, RANKED_A_TASK = 150_000, 1_000_000
#: An address whose path ends as a file's does that isn't a page.
ASSET = r"^(?:[a-z]+://[^/]+)?+[^?]*(?i:" + "|".join(e.replace(".", r"\.") for e in u.SKIPPED_EXTENSIONS) + r")(?:\?|\z)"


def edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` of answering pages' internal links, without assets and self links; of pages with one final URL the last one counts."""
    own = pages.filter("status < 400").select("finalUrl", "pageType", "status", "crawl_seq", "graph_key", "links")
    last = own.groupBy("graph_key").agg(F.max("crawl_seq").alias("_last"))
    # Whole pages are met before their links are exploded; by the key alone, so that links stay where they are to become distinct.
    # As many tasks as the links call for: links alike are a few bytes each once compressed, by which the shuffle would otherwise be cut up.
    n = portions(pages.sparkSession, own.agg(F.sum(F.size("links"))).first()[0] or 0, LINKS_A_TASK)
    met = own.repartition(n, "graph_key").join(last, "graph_key").filter("crawl_seq = _last")
    rows = link_rows(met, "graph")
    return rows.filter(~F.col("dst").rlike(ASSET)).select("src", "dst").filter("src <> dst").distinct()


def nodes(edge_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, type, crawled, source)``: sources, targets and answering pages without links."""
    ids = edge_rows.select(F.col("src").alias("id")).unionByName(edge_rows.select(F.col("dst").alias("id"))).unionByName(pages.filter("status < 400").select(F.col("graph_key").alias("id"))).distinct()
    known = pages.groupBy(F.col("graph_key").alias("id")).agg(F.min_by(F.struct("discoverySource"), "crawl_seq")["discoverySource"].alias("source"), F.lit(True).alias("crawled"))
    return ids.join(known, "id", "left").select("id", type_of("id").alias("type"), F.coalesce("crawled", F.lit(False)).alias("crawled"), "source")


def type_of(column: str) -> Column:
    """The node type that a URL tells; its path is found once, not for each type."""
    return u.bound(path_of(column), u.node_type)


def path_of(column: str) -> Column:
    path = F.regexp_replace(F.regexp_replace(column, r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def degrees(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    into = edge_rows.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("inbound_count"))
    out = edge_rows.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outbound_count"))
    return node_rows.join(into, "id", "left").join(out, "id", "left").fillna({"inbound_count": 0, "outbound_count": 0})


def inbound_rows(edge_rows: DataFrame) -> DataFrame:
    """``(url, source)``: all sources of all nodes, as rows; a node that every page links to would not fit an array."""
    return edge_rows.select(F.col("dst").alias("url"), F.col("src").alias("source"))


def typed_edges(edge_rows: DataFrame) -> DataFrame:
    """``(source, target, source_type, target_type)``, in order of source and target."""
    # Types after the order, which reads the edges twice.
    rows = edge_rows.select(F.col("src").alias("source"), F.col("dst").alias("target")).orderBy(tx.collated("source"), tx.collated("target"), "source", "target")
    return rows.select("source", "target", type_of("source").alias("source_type"), type_of("target").alias("target_type"))


#: Views of a graph by name, as conditions on its summary.
VIEWS = {"all": "true", "hubs": "is_hub", "orphans": "is_orphan", "catalog": "type in ('collection', 'product')", "seo": "not is_utility"}


def described(edge_rows: DataFrame, node_rows: DataFrame, summary_rows: DataFrame) -> DataFrame:
    """Nodes with their summaries; a node that only one of the tables has, or only the edges, gets what its URL tells and nought for the rest."""
    ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    own = node_rows.select("id", F.col("type").alias("_type"), F.col("crawled").alias("_crawled"))
    told = summary_rows.select(F.col("url").alias("id"), *[c for c in summary_rows.columns if c not in ("url", "inbound_sources")])
    rows = ends.join(own, "id", "full_outer").join(told, "id", "full_outer")
    rows = rows.withColumn("type", F.coalesce("type", "_type", type_of("id"))).withColumn("crawled", F.coalesce("crawled", "_crawled", F.lit(False)))
    rows = rows.withColumn("is_utility", F.coalesce("is_utility", u.is_utility(path_of("id")))).drop("_type", "_crawled")
    return rows.fillna(0, ["inbound_count", "outbound_count", "pagerank_score", "seo_pagerank_score"]).fillna(False, ["is_orphan", "is_sink", "is_hub"])


def view(edge_rows: DataFrame, described_rows: DataFrame, name: str = "all", text: str = "") -> tuple[DataFrame, DataFrame]:
    """The edges and nodes of one of ``VIEWS``, of nodes whose URL holds ``text``."""
    kept = described_rows.filter(VIEWS[name]).filter(F.contains(F.lower("id"), F.lit(text.strip().lower())))
    ids = kept.select("id")
    inside = edge_rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside, kept


def inbound_sample(edge_rows: DataFrame, most: int = 100) -> DataFrame:
    """Sorted sources of each node, the first ``most``, for a row's display; ``inbound_rows`` has them all."""
    ranked = edge_rows.withColumn("_r", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).filter(F.col("_r") <= most)
    return ranked.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("inbound_sources"))


def hubs(degree_rows: DataFrame) -> DataFrame:
    """Add ``is_hub``: as many outbound links as the node at a tenth of the descending order; ties count.

    The threshold comes from counts by degree, a table far smaller than the nodes.
    """
    degree_rows = saved(degree_rows, "degrees")
    total = degree_rows.count()
    place = max(1, -(-total // 10))
    by_degree = degree_rows.groupBy("outbound_count").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("outbound_count")).rowsBetween(Window.unboundedPreceding, 0))
    found = by_degree.withColumn("upto", upto).filter(F.col("upto") >= place).agg(F.max("outbound_count").alias("t")).first()["t"]
    return degree_rows.withColumn("is_hub", (F.col("outbound_count") > 0) & (F.col("outbound_count") >= F.lit(found if found is not None else 0)))


def pagerank(edge_rows: DataFrame, node_rows: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(id, score)``: ``1 - d + d * sum(score / outbound)`` for a fixed number of rounds, from 1 / N; then scaled to 0..1 by least and greatest."""
    ids = saved(node_rows.select("id", F.monotonically_increasing_id().alias("_n")), "rank-nodes")
    # Rounds carry numbers, not addresses.
    rows = edge_rows.join(ids.select(F.col("id").alias("src"), F.col("_n").alias("_from")), "src").join(ids.select(F.col("id").alias("dst"), F.col("_n").alias("_to")), "dst")
    rows = saved(rows.select("_from", "_to"), "rank-rows")
    linked = rows.select(F.col("_to").alias("_from"), F.lit(True).alias("linked")).distinct()
    sources = ids.select(F.col("_n").alias("_from")).join(linked, "_from", "left").fillna({"linked": False})
    lists = listed(rows, sources, portions(rows.sparkSession, rows.count(), RANKED_A_TASK))
    return scaled(ids, *flows(lists), ids.count(), rounds, damping)


def listed(rows: DataFrame, sources: DataFrame, tasks: int) -> DataFrame:
    """``(_from, targets, linked)``: the targets of each of ``sources``, ``(_from, linked)``; they are a page's links."""
    lists = rows.repartition(tasks, "_from").groupBy("_from").agg(F.array_distinct(F.collect_list("_to")).alias("targets"))
    return saved(lists.join(sources, "_from"), "rank-lists")


def flows(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(_n, steady)`` and ``(_from, out, _to, inner)``.

    Sources that nothing links to all have one score, so what they send is summed once for all rounds. Of the other edges, those to
    targets without links (not ``inner``) are read in the last round only: nothing hangs on such a target's score.
    Sums by target are aggregated before the shuffle, so a target of all pages isn't gathered anywhere.
    """
    sent = lists.filter("not linked").select((1.0 / F.size("targets")).alias("share"), F.explode("targets").alias("_n"))
    steady = saved(sent.groupBy("_n").agg(F.sum("share").alias("steady")), "rank-steady")
    core = lists.filter("linked")
    ends = core.select(F.col("_from").alias("_to"), F.lit(True).alias("inner"))
    edges = core.select("_from", F.size("targets").alias("out"), F.explode("targets").alias("_to")).join(ends, "_to", "left")
    return steady, saved(edges.select("_from", "out", "_to", F.coalesce("inner", F.lit(False)).alias("inner")), "rank-edges")


def scaled(ids: DataFrame, steady: DataFrame, edges: DataFrame, n: int, rounds: int, damping: float) -> DataFrame:
    """``(id, score)`` of ``(id, _n)`` by the rounds over ``flows``; an id whose number is null has no links at all."""
    if n == 0 or rounds == 0:
        return ids.select("id", F.lit(0.0).alias("score"))
    tasks = portions(edges.sparkSession, edges.filter("inner").count(), RANKED_A_TASK)
    # Sorted once, as every round meets them by their source; scores come to them in as many tasks, or the planner would shuffle both sides anew.
    inner = edges.filter("inner").select("_from", "_to", "out").repartition(tasks, "_from").sortWithinPartitions("_from").persist(StorageLevel.DISK_ONLY)
    own = saved(edges.select(F.col("_from").alias("_n")).distinct().join(steady, "_n", "left").fillna({"steady": 0.0}), "rank-own")
    scores, alone = own.select("_n", F.lit(1.0 / n).alias("score")), 1.0 / n

    def step(rows: DataFrame, ends: DataFrame, how: str) -> DataFrame:
        """One round: scores of ``ends``, ``(_n, steady)``, by what the edges ``rows`` send them."""
        sent = rows.join(scores.withColumnRenamed("_n", "_from").repartition(tasks, "_from"), "_from").groupBy(F.col("_to").alias("_n")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        got = F.coalesce("steady", F.lit(0.0)) * alone + F.coalesce("got", F.lit(0.0))
        return ends.join(sent, "_n", how).select("_n", (F.lit(1 - damping) + damping * got).alias("score"))

    for i in range(1, rounds):
        scores, alone = step(inner, own, "left"), 1 - damping
        if i % CUT_EVERY == 0 or i == rounds - 1:
            scores = saved(scores, "rank")
    inner.unpersist()
    found = saved(step(edges, steady, "full_outer"), "rank")
    ends = found.agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count(F.lit(1)).alias("n")).first()
    others = [1 - damping] if ends["n"] < n else []  # ids that nothing links to
    a, b = (use([x for x in (ends["a"], ends["b"]) if x is not None] + others) for use in (min, max))
    score = F.round((F.coalesce("score", F.lit(1 - damping)) - a) / (b - a), 6) if b > a else F.lit(0.0)
    return ids.join(found, "_n", "left").select("id", score.alias("score"))


def pagerank_of_links(pages: DataFrame, links: DataFrame, address: Callable[[Column], Column], useful: bool = False, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``pagerank`` (``useful``: ``seo_pagerank``) of pages whose links are numbers ``(src, dst)`` that ``address`` spells out.

    The same graph as that of ``edges`` and ``nodes``, but an address is spelled, formed and judged once, not for each link to it.
    """
    links = saved(links.filter("src is not null and dst is not null").select("src", "dst"), "links")
    ends = links.select(F.col("src").alias("_a"), F.lit(False).alias("to")).distinct().unionByName(links.select(F.col("dst").alias("_a"), F.lit(True).alias("to")).distinct())
    spelled = ends.groupBy("_a").agg(F.max("to").alias("to")).select("_a", "to", address(F.col("_a")).alias("finalUrl"))
    spelled = saved(spelled.withColumn("id", u.form("finalUrl", "graph", F.col("finalUrl"))), "addresses")
    # The least number of the addresses that share a key is the key's own.
    keys = spelled.groupBy("id").agg(F.min("_a").alias("_n"), F.max("to").alias("linked"), (F.count(F.lit(1)) > 1).alias("many"))
    live = pages.filter("status < 400").select("finalUrl", "crawl_seq", "graph_key")
    last = live.groupBy("graph_key").agg(F.max("crawl_seq").alias("_last"))
    kept = live.join(last, "graph_key").filter("crawl_seq = _last").select("finalUrl", F.lit(True).alias("kept")).distinct()
    utility = u.is_utility(path_of("id")) if useful else F.lit(False)
    judged = spelled.join(keys, "id").join(kept, "finalUrl", "left").select("_a", "id", "_n", "linked", "many", F.coalesce("kept", F.lit(False)).alias("kept"), F.col("id").rlike(ASSET).alias("asset"), utility.alias("utility"))
    judged = saved(judged, "judged")

    # Few addresses aren't what their number says; the planner ships a table this small to the links.
    odd = saved(judged.filter("asset or utility or many").select("_a", "_n", "kept", "asset", "utility"), "odd")
    start, end = (odd.select([F.col(c).alias(f"{c}{side}") for c in odd.columns]) for side in ("_src", "_dst"))
    rows = links.join(start, F.col("src") == F.col("_a_src"), "left").join(end, F.col("dst") == F.col("_a_dst"), "left")
    rows = rows.filter(F.coalesce("kept_src", F.lit(True)) & ~F.coalesce("asset_dst", F.lit(False)))
    rows = rows.select(F.coalesce("_n_src", "src").alias("_from"), F.coalesce("_n_dst", "dst").alias("_to"), (F.coalesce("utility_src", F.lit(False)) | F.coalesce("utility_dst", F.lit(False))).alias("_aside")).filter("_from <> _to")
    sources = judged.filter("kept").groupBy(F.col("_n").alias("_from")).agg(F.max("linked").alias("linked"))

    inside = rows.filter("not _aside").select("_from", "_to")
    steady, edges = flows(listed(inside, sources, portions(links.sparkSession, links.count(), RANKED_A_TASK)))
    aside = rows.filter("_aside").join(sources, "_from", "left_semi").select(F.col("_to").alias("_n"))
    reached = steady.select("_n").unionByName(edges.select(F.col("_to").alias("_n"))).unionByName(aside).distinct()
    known = judged.filter("_a = _n").select("id", "_n")
    ids = known.join(reached, "_n", "left_semi").select("id").unionByName(live.select(F.col("graph_key").alias("id"))).distinct()
    ids = saved(ids.join(known, "id", "left").withColumn("utility", u.is_utility(path_of("id")) if useful else F.lit(False)), "rank-nodes")
    ranked = ids.filter("not utility")
    found = scaled(ranked, steady, edges, ranked.count(), rounds, damping)
    return found.unionByName(ids.filter("utility").select("id", F.lit(0.0).alias("score")))


def seo_pagerank(edge_rows: DataFrame, node_rows: DataFrame, **how) -> DataFrame:
    """The same without utility pages, which score 0."""
    useful = node_rows.filter(~u.is_utility(path_of("id")))
    inside = edge_rows.filter(~u.is_utility(path_of("src")) & ~u.is_utility(path_of("dst")))
    return node_rows.select("id").join(pagerank(inside, useful, **how), "id", "left").fillna({"score": 0.0})


def depths(edge_rows: DataFrame, node_rows: DataFrame, most: int | None = None) -> DataFrame:
    """``(id, depth)`` from the home pages by breadth, as deep as they lead unless ``most`` levels are asked for; null where none leads. One join a level, frontier against unseen nodes."""
    seen = saved(node_rows.filter("type = 'home'").select("id", F.lit(0).alias("depth")), "depth")
    frontier, level = seen, 0
    while most is None or level < most:
        level += 1
        reached = frontier.select(F.col("id").alias("src")).join(edge_rows, "src").select(F.col("dst").alias("id")).distinct()
        frontier = saved(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)), "depth")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % CUT_EVERY == 0:
            seen = saved(seen, "depth")
    return node_rows.select("id").join(seen, "id", "left")


def summary(edge_rows: DataFrame, node_rows: DataFrame, listed: int = 100, ranks: bool = True) -> DataFrame:
    """All that is known of each node; its scores are null without ``ranks``, for those who don't read them."""
    edge_rows, node_rows = saved(edge_rows, "edges"), saved(node_rows, "nodes")
    base = hubs(degrees(edge_rows, node_rows))
    if ranks:
        base = base.join(pagerank(edge_rows, node_rows).withColumnRenamed("score", "pagerank_score"), "id").join(seo_pagerank(edge_rows, node_rows).withColumnRenamed("score", "seo_pagerank_score"), "id")
    else:
        base = base.withColumns({c: F.lit(None).cast("double") for c in ("pagerank_score", "seo_pagerank_score")})
    depth = depths(edge_rows, node_rows).withColumnRenamed("depth", "depth_from_home")
    found = base.join(depth, "id", "left").join(inbound_sample(edge_rows, listed), "id", "left")
    return found.select(
        F.col("id").alias("url"), "type", "crawled", "inbound_count", "outbound_count", "pagerank_score", "seo_pagerank_score", "depth_from_home",
        ((F.col("type") != "home") & (F.col("inbound_count") == 0) & ~not_in_html(F.col("source"))).alias("is_orphan"), (F.col("outbound_count") == 0).alias("is_sink"), "is_hub",
        u.is_utility(path_of("id")).alias("is_utility"), F.coalesce("inbound_sources", F.array().cast("array<string>")).alias("inbound_sources"),
    )


def frontier(edge_rows: DataFrame, seeds: DataFrame, max_pages: int = 5000, max_depth: int = 10) -> DataFrame:
    """``(url, depth)`` that a crawl of a recorded site would visit: level by level, first discovery wins, caps on number and depth."""
    def first(urls: DataFrame, room: int, level: int) -> tuple[DataFrame, int]:
        """All of them, or the first ones where there is no room for all."""
        found = saved(urls.withColumn("depth", F.lit(level)), "frontier")
        n = found.count()
        return (found, n) if n <= room else (saved(found.orderBy("url").limit(room), "frontier"), room)

    seen, held = first(seeds.select("url").distinct(), max_pages, 0)
    last, level = seen, 0
    while held < max_pages and level < max_depth:
        level += 1
        new = last.select(F.col("url").alias("src")).join(edge_rows, "src").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        last, n = first(new, max_pages - held, level)
        if n == 0:
            break
        seen, held = seen.unionByName(last), held + n
    return seen
