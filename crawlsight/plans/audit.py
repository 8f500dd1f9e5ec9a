"""A whole run: from raw pages and what else a crawl recorded to every report table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robots as rb
from ..functions import text as tx
from ..functions import url as u
from ..operators import extract, graph, registry, reports, rules, site
from ..operators.lineage import saved
from ..schema import FETCH_LOG, ISSUE_COLUMNS, PROBE_LOG, SITEMAP
from ..sources import recorded, sinks

#: Columns of the issue table, in order.
ISSUES = (
    "url", "pageType", "severity", "category", "code", "issue", "handle", "noindex_source", "noindex_removable", "message", "recommendation", "evidence", "inbound_sources", "reachable_via",
)


@dataclass(frozen=True)
class Recorded:
    """What a crawl left besides its pages; whatever is missing counts as empty."""

    sitemap_urls: DataFrame | None = None
    sitemaps: DataFrame | None = None
    probe_log: DataFrame | None = None
    attempts: DataFrame | None = None
    page_speed: DataFrame | None = None
    usages: DataFrame | None = None
    target: str = ""
    at: str = ""


def prepared(pages: DataFrame, settings: rules.Settings = rules.Settings()) -> DataFrame:
    """Parsed pages, keyed and prepared, as a table."""
    return saved(rules.prepare(site.keyed(pages), settings), "pages")


def page_table(raw: DataFrame, settings: rules.Settings = rules.Settings()) -> DataFrame:
    """Raw pages parsed once; whether they were redirected follows from their addresses."""
    return prepared(extract.pages(extract.with_redirect(raw)), settings)


def issue_table(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Issues with all columns that the sinks know."""
    source = rb.noindex_source(F.col("meta.robots"), F.col("xRobotsTag"), rules.canonical_reason() == "different_page")
    own = pages.select(F.col("finalUrl").alias("url"), "crawl_seq", source.alias("s")).groupBy("url").agg(F.max_by("s", "crawl_seq").alias("noindex_source"))
    own = own.filter("noindex_source is not null").withColumn("code", F.lit("noindex_page"))
    path = graph.path_of("url")
    named = F.col("code").isin("orphaned_collection", "broken_collection_link")
    rows = found.join(own, ["url", "code"], "left")
    rows = rows.withColumn("issue", F.col("message")).withColumn("handle", F.when(named, u.segment_after(path, "collections"))).withColumn("noindex_removable", F.when(F.col("noindex_source").isNotNull(), F.col("noindex_source") == "meta_robots"))
    for c in ("inbound_sources", "reachable_via"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.select(*ISSUES, "metric")


def tables(pages: DataFrame, left: Recorded = Recorded(), settings: rules.Settings = rules.Settings()) -> dict[str, DataFrame]:
    """Every report by name, from a page table as ``page_table`` makes it. Shared inputs are tables, so nothing is computed twice."""
    spark = pages.sparkSession
    log = left.probe_log if left.probe_log is not None else spark.createDataFrame([], PROBE_LOG)
    attempts = left.attempts if left.attempts is not None else spark.createDataFrame([], FETCH_LOG)
    listed = left.sitemap_urls if left.sitemap_urls is not None else spark.createDataFrame([], SITEMAP)
    answered = pages.filter("status < 400")
    edges = saved(graph.edges(pages), "edges")
    nodes = saved(graph.nodes(edges, pages), "nodes")
    summary = saved(graph.summary(edges, nodes), "graph-summary")
    by_page = saved(registry.run(answered, rules.families(settings)).unionByName(registry.run(pages, [rules.fetch()])), "page-issues")
    whole = site.issues(pages, edges, left.sitemap_urls)
    found = saved(by_page.unionByName(whole, allowMissingColumns=True), "issues")
    usages = left.usages if left.usages is not None else extract.image_usages(pages)
    groups, membership = site.cannibalization_tables(pages)
    probes = saved(recorded.probe(log), "probes")
    unreachable = saved(reports.unreachable_products(pages, found, summary, recorded.memberships(log)), "unreachable")
    plain = found.select(*ISSUE_COLUMNS)
    out = {
        "pages": reports.flat_pages(pages),
        "issues": issue_table(pages, found),
        "action_plan": reports.action_plan(plain),
        "site_profile": reports.site_profile(pages, plain, left.target, left.at),
        "dashboard": reports.dashboard(plain, pages),
        "indexability": reports.indexability_table(pages, listed, by_page),
        "redirects": reports.redirect_table(pages, by_page),
        "content_cannibalization": groups,
        "content_cannibalization_pages": membership,
        "image_inventory": reports.image_inventory(usages).orderBy(*reports.inventory_order()),
        "image_seo_summary": reports.image_summary(pages, usages, plain),
        "image_issue_counts": reports.image_issue_counts(plain),
        "image_alt_patterns": reports.alt_patterns(usages),
        "image_summary_rows": reports.image_summary_rows(reports.image_summary(pages, usages, plain), reports.alt_patterns(usages)),
        "image_top_missing_alt": reports.top_missing_alt(plain, pages),
        "link_graph_nodes": nodes.select("id", "type", "crawled").orderBy(tx.collated("id"), "id"),
        "link_graph_edges": graph.typed_edges(edges),
        "link_graph_summary": summary,
        "link_graph_inbound": graph.inbound_rows(edges),
        "unreachable_products": unreachable.orderBy(tx.collated("source"), tx.collated("url"), "url"),
        "crawl_stats": reports.crawl_table(pages, plain, summary, unreachable, attempts, probes, generated_at=left.at),
        "collection_probe": probes,
        "probe_pages": recorded.probe_pages(log),
        "probe_totals": recorded.probe_totals(probes),
    }
    if left.page_speed is not None:
        out["page_speed"] = recorded.page_speed_table(left.page_speed)
    if left.sitemaps is not None:
        out["sitemaps"] = recorded.sitemap_inventory(left.sitemaps, listed)
    return out


def probe_only(log: DataFrame) -> dict[str, DataFrame]:
    """A run of pagination probes alone: collections, the pages that were read, and totals."""
    probes = saved(recorded.probe(log), "probes")
    return {"collection_probe": probes, "probe_pages": recorded.probe_pages(log), "probe_totals": recorded.probe_totals(probes)}


def run(raw: DataFrame, path: str, left: Recorded = Recorded(), settings: rules.Settings = rules.Settings()) -> dict[str, DataFrame]:
    """Raw pages in, every table out, as CSV and JSON below ``path``."""
    return write(tables(page_table(raw, settings), left, settings), path)


def write(made: dict[str, DataFrame], path: str, more: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Write the tables of a run, and ``more`` beside them, below ``path``."""
    made = made | (more or {})
    sinks.write_issues(made["issues"], f"{path}/issues")
    sinks.write_report({n: df for n, df in made.items() if n != "issues"}, path)
    return made
