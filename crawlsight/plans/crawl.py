"""A crawl over recorded pages: the queue, generation by generation.

The queue is first in, first out, so all addresses that one generation of pages adds
come before what the next one adds, and a generation is one set of joins: candidates
in the form that the queue keys on, the first of each, without those seen before, in
order, cut at the cap. What is in the queue is a small table of addresses; pages are
joined to it and parsed only when their turn comes, each once.

An address's order is its page's place in the queue, links before probes, and its place
there. Links count below the depth limit; products that a probe of a collection finds are
added at the depth limit too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as u
from ..operators import extract
from ..operators.lineage import numbered, saved
from ..sources import probes as pr
from ..sources.recorded import may_be_probed
from . import audit

QUEUE = "key string, depth int, source string, via string, place long"


@dataclass(frozen=True)
class Limits:
    """``pages``: addresses that the queue takes; ``depth``: of the pages whose links are followed, one less."""

    pages: int = 500
    depth: int = 5
    follow: bool = True


@dataclass(frozen=True)
class Crawl:
    """``queue``: ``(key, depth, source, via, place, state)``, states being page, not_html and no_record; ``pages``: the page table with place, depth and source of the queue; ``probes`` as of a log, if there was one."""

    queue: DataFrame
    pages: DataFrame
    probes: pr.Probes | None


def _accept(candidates: DataFrame, seen: DataFrame | None, base: str, room: int, taken: int, limits: Limits, name: str) -> DataFrame:
    """Candidates ``(url, depth, source, via, at)`` that enter the queue, ``at`` being their order."""
    root = F.lit(base)
    key = u.form("url", "tracking", base=root, idn=True)
    keyed = candidates.filter(F.col("depth") <= limits.depth).withColumn("key", key).filter("key is not null")
    first = keyed.groupBy("key").agg(F.min(F.struct("at", "depth", "source", "via")).alias("x")).select("key", "x.at", "x.depth", "x.source", "x.via")
    if seen is not None:
        first = first.join(seen.select("key"), "key", "left_anti")
    first = saved(first.filter(~u.should_skip(u.parts("key"), u.parts(root))), f"{name}-new")
    placed = numbered(first, [F.col("at")], name, "_n").filter(F.col("_n") <= room)
    return saved(placed.select("key", "depth", "source", "via", (F.col("_n") + taken).alias("place")), f"{name}-queue")


def crawl(raw: DataFrame, seeds: DataFrame, base: str, limits: Limits = Limits(), probe_log: DataFrame | None = None, keep_query: bool = False) -> Crawl:
    """Crawl ``raw`` (the schema of raw pages) from ``seeds``, ``(url, source, n)`` in order of ``n``. Of records with one address the first by ``crawl_seq`` is its page."""
    spark = raw.sparkSession
    stored = extract.with_redirect(raw).withColumn("_key", u.form("url", "tracking", base=F.lit(base), idn=True)).filter("_key is not null")
    first = stored.groupBy("_key").agg(F.min("crawl_seq").alias("crawl_seq"))
    stored = saved(stored.join(first, ["_key", "crawl_seq"], "left_semi"), "crawl-records")
    probed = pr.probe(probe_log, base) if probe_log is not None else None

    candidates = seeds.select("url", F.lit(0).alias("depth"), "source", F.lit(None).cast("string").alias("via"), _at(F.lit(0), F.lit(0), F.col("n"), F.lit(0)))
    queue, pages, states, taken, generation = [], [], [], 0, 0
    while taken < limits.pages:
        seen = _all(spark, queue, QUEUE) if queue else None
        new = _accept(candidates, seen, base, limits.pages - taken, taken, limits, f"crawl-{generation}")
        number = new.count()
        if number == 0:
            break
        queue.append(new)
        taken += number
        met = stored.drop("depth", "discoverySource").join(new.select(F.col("key").alias("_key"), "depth", F.col("source").alias("discoverySource"), "place"), "_key")
        parsed = saved(extract.pages(met, keep_query), f"crawl-{generation}-pages")
        pages.append(parsed)
        states.append(new.join(met.select("place"), "place", "left_semi").select("place"))
        if not limits.follow:
            break
        links = parsed.filter(F.col("depth") < limits.depth).select("place", "depth", "finalUrl", F.posexplode("links").alias("pos", "link")).filter("link.internal")
        candidates = links.select(F.col("link.href").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("source"), F.col("finalUrl").alias("via"), _at(F.col("place"), F.lit(0), F.col("pos"), F.lit(0)))
        if probed is not None:
            able = parsed.filter(may_be_probed(u.parts("finalUrl"), F.col("status"))).select("place", "depth", F.col("finalUrl").alias("collection_url"))
            found = able.join(probed.products.select("collection_url", "product_url", "page_no", F.col("place").alias("_pos")), "collection_url")
            candidates = candidates.unionByName(found.select(F.col("product_url").alias("url"), F.least(F.col("depth") + 1, F.lit(limits.depth)).alias("depth"), F.lit("pagination_probe").alias("source"), F.col("collection_url").alias("via"), _at(F.col("place"), F.lit(1), F.col("page_no"), F.col("_pos"))))
        generation += 1
    everything = _all(spark, queue, QUEUE)
    if not pages:
        empty = stored.limit(0).withColumn("place", F.lit(0).cast("long"))
        return Crawl(everything.withColumn("state", F.lit("no_record")), extract.pages(empty.drop("_key"), keep_query), probed)
    table = pages[0]
    for more in pages[1:]:
        table = table.unionByName(more)
    table = table.drop("_key")
    answered = states[0]
    for more in states[1:]:
        answered = answered.unionByName(more)
    met = answered.withColumn("_met", F.lit(True)).join(table.select("place", F.lit(True).alias("_page")), "place", "left")
    state = F.when(F.col("_page"), "page").when(F.col("_met"), "not_html").otherwise("no_record")
    return Crawl(everything.join(met, "place", "left").select(*[c.split()[0] for c in QUEUE.split(", ")], state.alias("state")), table, probed)


def _at(place: Column, kind: Column, n: Column, m: Column) -> Column:
    return F.struct(place.cast("long").alias("place"), kind.cast("int").alias("kind"), n.cast("long").alias("n"), m.cast("long").alias("m")).alias("at")


def _all(spark, tables: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for t in tables:
        out = out.unionByName(t)
    return out


def seed_rows(urls: DataFrame, products: DataFrame | None = None, unlisted: DataFrame | None = None, collections: DataFrame | None = None) -> DataFrame:
    """``(url, source, n)``: given addresses ``(url, n)``, then products of the interface, of sitemaps alone, and collections of the interface, each ``(url, n)``."""
    kinds = ((urls, None), (products, "api_probe"), (unlisted, "sitemap_unlisted"), (collections, "api_probe"))
    parts = [df.select("url", F.lit(source).cast("string").alias("source"), F.struct(F.lit(i).alias("kind"), F.col("n").cast("long").alias("n")).alias("o")) for i, (df, source) in enumerate(kinds) if df is not None]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return numbered(out, [F.col("o"), F.col("url")], "crawl-seeds", "n").select("url", "source", "n")


def counts(crawled: Crawl) -> DataFrame:
    """One row of what the queue took, by where it came from, and what probes did."""
    q = crawled.queue
    took = q.agg(
        F.count(F.lit(1)).alias("queued"), F.count_if(F.col("state") == "page").alias("pages"), F.count_if(F.col("state") == "not_html").alias("skipped_non_html"), F.count_if(F.col("state") == "no_record").alias("without_record"),
        F.count_if((F.col("source") == "api_probe") & F.col("key").rlike("^[a-z]+://[^/]+/products/")).alias("api_seeded_products"), F.count_if((F.col("source") == "api_probe") & F.col("key").rlike("^[a-z]+://[^/]+/collections/")).alias("api_seeded_collections"),
        F.count_if(F.col("source") == "sitemap_unlisted").alias("sitemap_only_products"), F.count_if(F.col("source") == "pagination_probe").alias("probe_discovered_products"), F.count_if(F.col("source").isNull() & (F.col("depth") > 0)).alias("followed_links"),
    )
    if crawled.probes is None:
        return took
    met = probe_summary(crawled)
    return took.join(met.agg(F.coalesce(F.sum("attempted"), F.lit(0)).alias("probe_collections_attempted"), F.coalesce(F.sum("exhausted"), F.lit(0)).alias("probe_collections_exhausted"), F.coalesce(F.sum("failed"), F.lit(0)).alias("probe_collections_failed"), F.coalesce(F.sum("probe_pages_fetched"), F.lit(0)).alias("probe_total_pages_fetched")))  # one row on either side


def probe_summary(crawled: Crawl) -> DataFrame:
    """The probes of collections that the crawl met, with how many of their products the queue took from each."""
    took = crawled.queue.filter("source = 'pagination_probe'").groupBy(F.col("via").alias("collection_url")).agg(F.count(F.lit(1)).alias("discovered_products"))
    able = crawled.pages.filter(may_be_probed(u.parts("finalUrl"), F.col("status"))).select(F.col("finalUrl").alias("collection_url")).distinct()
    return crawled.probes.collections.join(able, "collection_url", "left_semi").join(took, "collection_url", "left").fillna({"discovered_products": 0})


def run(raw: DataFrame, seeds: DataFrame, base: str, path: str, limits: Limits = Limits(), left: audit.Recorded = audit.Recorded(), probe_log: DataFrame | None = None) -> dict[str, DataFrame]:
    """Crawl and write every report table of the pages met, and those of the queue."""
    done = crawl(raw, seeds, base, limits, probe_log)
    more = {"crawl_queue": done.queue.orderBy("place"), "crawl_counts": counts(done)}
    if done.probes is not None:
        more |= {"probe_summary": probe_summary(done), "probe_read_pages": done.probes.pages}
    return audit.write(audit.tables(audit.prepared(done.pages.drop("place")), left), path, more)
