"""Reports: what comes out of pages, issues and the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images as img
from ..functions import text as tx
from ..functions import url as u
from ..schema import SEVERITIES
from .rules import is_fetch_failure


def severity_rank(column: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(column)).cast("int")


def action_plan(issues: DataFrame, samples: int = 5) -> DataFrame:
    """A task for each (severity, category, code, recommendation), numbered by severity and number of issues."""
    keys = ["severity", "category", "code", "recommendation"]
    counted = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("affectedUrls"), F.min("message").alias("message"))
    # A rank in which a repeated URL counts once: each task cuts its own issues, and none are gathered to become distinct first.
    first = issues.select(*keys, "url").withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("url"))).filter(F.col("_r") <= samples)
    listed = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("url")), "|").alias("sampleUrls"))
    order = Window.orderBy(severity_rank(), F.desc("affectedUrls"), "code", "recommendation")
    return counted.join(listed, keys).withColumn("priority", F.row_number().over(order)).select("priority", "severity", "category", "code", F.col("recommendation").alias("task"), "affectedUrls", "sampleUrls")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def top_codes(issues: DataFrame, n: int = 12) -> DataFrame:
    return issue_counts(issues).orderBy(F.desc("n"), "code").limit(n)


def site_profile(pages: DataFrame, issues: DataFrame, target: str = "", crawled_at: str = "") -> DataFrame:
    """One row: pages, pages by type, platform, apps and issues by code, maps in JSON-ready form."""
    one = pages.agg(F.lit(target).alias("targetUrl"), F.lit(crawled_at).alias("crawledAt"), F.count(F.lit(1)).alias("totalPages"), F.coalesce(F.bool_or("shopify.isShopify"), F.lit(False)).alias("isShopify"))
    apps = pages.select(F.explode("shopify.detectedApps").alias("a")).agg(F.array_sort(F.collect_set("a")).alias("detectedApps"))

    def as_map(rows: DataFrame, key: str, name: str) -> DataFrame:
        counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias(name))

    return one.join(apps).join(as_map(pages, "pageType", "pageTypes")).join(as_map(issues, "code", "commonIssues"))  # one row on either side


def redirect_report(pages: DataFrame, *more: str) -> DataFrame:
    state = F.when(~F.col("redirected"), "no_redirect").when(F.col("redirectCount") > 1, "redirect_chain").otherwise("single_redirect")
    advice = F.when(state == "no_redirect", "None.").when(state == "redirect_chain", "Redirect in one step.").otherwise("Link to the final URL.")
    return pages.select("url", "finalUrl", "pageType", "status", "redirected", "redirectCount", state.alias("redirectStatus"), advice.alias("recommendation"), *more)


def issue_codes(issues: DataFrame) -> DataFrame:
    """``(url, issueCodes)``: the different codes of each page, sorted and joined; the catalogue of codes bounds a row."""
    return issues.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("code")), "|").alias("issueCodes"))


def redirect_table(pages: DataFrame, page_issues: DataFrame) -> DataFrame:
    """The redirect report with what was asked for, the canonical URL and the page's codes."""
    rows = redirect_report(pages.withColumn("canonical", tx.blank(F.col("meta.canonical"))), "canonical").withColumnRenamed("url", "requestedUrl").withColumn("url", F.col("finalUrl"))
    out = rows.join(issue_codes(page_issues), "url", "left").fillna({"issueCodes": ""})
    return out.select("url", "requestedUrl", "finalUrl", "status", "pageType", "redirected", "redirectCount", "redirectStatus", "canonical", "issueCodes", "recommendation")


def indexability_table(pages: DataFrame, sitemap_urls: DataFrame, page_issues: DataFrame) -> DataFrame:
    """The indexability report with alternates and the page's codes."""
    rows = indexability_report(pages, sitemap_urls, True).join(issue_codes(page_issues), "url", "left").fillna({"issueCodes": ""})
    return rows.select(
        "url", "status", "pageType", "indexable", "indexabilityStatus", "inSitemap", "canonical", "canonicalTarget", F.col("selfReferencing").alias("canonicalSelfReferencing"), F.col("metaRobots").alias("robots"),
        tx.blank(F.col("xRobotsTag")).alias("xRobotsTag"), "alternateCount", "hreflangValues", "issueCodes",
    )


def indexability_report(pages: DataFrame, sitemap_urls: DataFrame, alternates: bool = False) -> DataFrame:
    listed = sitemap_urls.select(u.form("url", "compare", F.col("url"), idn=True).alias("compare_key"), F.lit(True).alias("_in")).distinct()
    named = F.filter("meta.alternates", lambda a: tx.blank(a["hreflang"]) != "")
    more = [F.size("meta.alternates").alias("alternateCount"), F.array_join(F.transform(named, lambda a: a["hreflang"]), "|").alias("hreflangValues")] if alternates else []
    return pages.join(listed, "compare_key", "left").select(
        *more,
        F.col("finalUrl").alias("url"), "pageType", "status", F.col("indexability.indexable").alias("indexable"), F.col("indexability.status").alias("indexabilityStatus"), F.col("meta.robots").alias("metaRobots"),
        F.col("xRobotsTag"), F.col("meta.canonical").alias("canonical"), F.col("indexability.canonicalTarget").alias("canonicalTarget"), F.col("indexability.selfReferencing").alias("selfReferencing"), F.coalesce("_in", F.lit(False)).alias("inSitemap"),
    )


def _values(column: str) -> Column:
    """The different values of a small vocabulary that aren't blank, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(tx.blank(F.col(column)) != "", F.col(column)))), "|")


def image_inventory(usages: DataFrame, samples: int = 10) -> DataFrame:
    """A row for each (image, alternative text). Pages are listed up to ``samples``, counted in full."""
    key = ["imageUrl", "alt"]
    counted = usages.groupBy(*key).agg(
        F.count(F.lit(1)).alias("usedCount"), F.count_distinct("pageUrl").alias("pagesUsed"), F.array_join(F.array_sort(F.collect_set("pageType")), "|").alias("pageTypes"),
        F.count_if(F.coalesce("lazy", F.lit(False))).alias("lazyCount"), F.count_if(~F.coalesce("lazy", F.lit(False))).alias("eagerCount"),
        *[_values(c).alias(f"{n}Values") for c, n in (("width", "width"), ("height", "height"), ("fetchPriority", "fetchPriority"))],
    )
    first = usages.select(*key, "pageUrl").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("pageUrl"))).filter(F.col("_r") <= samples)
    listed = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("pageUrl")), "|").alias("samplePages"))
    missing = (tx.trimmed(F.col("alt")) == "") & img.needs_alt(F.col("imageUrl"))
    return counted.join(listed, key).withColumn("filename", img.filename(F.col("imageUrl"))).withColumn("missingAlt", missing)


def inventory_order() -> list:
    return [F.desc("missingAlt"), F.desc("usedCount"), tx.collated("imageUrl"), tx.collated("alt"), "imageUrl", "alt"]


def alt_patterns(usages: DataFrame) -> DataFrame:
    """Missing texts by where they are mended; places without any keep a row."""
    missing = usages.filter((tx.trimmed(tx.blank(F.col("alt"))) == "") & img.needs_alt(F.col("imageUrl"))).withColumn("pattern", img.fix_place(F.col("imageUrl")))
    counted = missing.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pageUrl").alias("p"))
    first = missing.select("pattern", "imageUrl").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("pattern").orderBy("imageUrl"))).filter("_r <= 3")
    listed = first.groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("imageUrl")), "|").alias("s"))
    places = usages.sparkSession.createDataFrame([(n, f, b) for n, _, f, b in img.FIX_PLACES], "pattern string, fix_location string, bulk_fix_possible boolean")
    out = places.join(counted, "pattern", "left").join(listed, "pattern", "left")
    return out.select("pattern", F.coalesce("n", F.lit(0)).alias("missing_alt_count"), F.coalesce("p", F.lit(0)).alias("pages_affected"), "fix_location", "bulk_fix_possible", F.coalesce("s", F.lit("")).alias("sample_urls"))


def top_missing_alt(issues: DataFrame, pages: DataFrame, n: int = 25) -> DataFrame:
    own = issues.filter("code = 'missing_image_alt'").groupBy("url").agg(F.sum("metric").alias("missingAltImages"))
    types = pages.groupBy(F.col("finalUrl").alias("url")).agg(F.max_by("pageType", "crawl_seq").alias("pageType"))
    return own.join(types, "url", "left").select("url", F.coalesce("pageType", F.lit("unknown")).alias("pageType"), "missingAltImages").orderBy(F.desc("missingAltImages"), "url").limit(n)


def image_summary(pages: DataFrame, usages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of counts; pages are counted by different URL, issues by row."""
    def pages_with(code: str) -> Column:
        return F.count_distinct(F.when(F.col("code") == code, F.col("url")))

    p = pages.agg(
        F.count(F.lit(1)).alias("totalPages"), F.count_if(F.size("images") > 0).alias("pagesWithImages"), F.coalesce(F.sum(F.size("images")), F.lit(0)).alias("totalImagesStored"),
        F.coalesce(F.sum("speed.largeImageUrlCount"), F.lit(0)).cast("long").alias("largeImageUrlCount"), F.count_if(F.col("speed.largeImageUrlCount") > 0).alias("pagesWithLargeImageUrls"),
    )
    v = usages.agg(F.count(F.lit(1)).alias("totalImageUsages"), F.count_distinct("imageUrl", "alt").alias("uniqueImageRows"))
    i = issues.agg(
        F.coalesce(F.sum(F.when(F.col("code") == "missing_image_alt", F.col("metric"))), F.lit(0)).alias("missingAltImages"), pages_with("missing_image_alt").alias("pagesWithMissingAlt"),
        pages_with("image_alt_duplicate_on_page").alias("duplicateAltIssuePages"), F.coalesce(F.sum(F.when(F.col("code") == "image_missing_dimensions", F.col("metric"))), F.lit(0)).alias("missingDimensionImages"),
        pages_with("image_missing_dimensions").alias("pagesWithMissingDimensions"), pages_with("lazy_loading_missing").alias("lazyLoadingIssuePages"), pages_with("primary_image_lazy_loaded").alias("primaryImageLazyPages"),
    )
    return p.join(v).join(i)  # one row each


def image_summary_rows(summary: DataFrame, patterns: DataFrame) -> DataFrame:
    """Summary and patterns as the rows of one flat table."""
    return summary.withColumn("section", F.lit("summary")).unionByName(patterns.withColumn("section", F.lit("alt_text_pattern_analysis")), allowMissingColumns=True)


def image_issue_counts(issues: DataFrame) -> DataFrame:
    own = (F.col("category") == "images") | F.col("code").isin("image_count_high", "large_image_url_width", "primary_image_lazy_loaded", "lazy_loading_missing")
    return issues.filter(F.col("category").isin("images", "page_speed") & own).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def status_families(pages: DataFrame) -> DataFrame:
    family = F.when(F.col("status").between(200, 299), "2xx").when(F.col("status").between(300, 399), "3xx").when(F.col("status").between(400, 499), "4xx").when(F.col("status").between(500, 599), "5xx").otherwise("other")
    return pages.groupBy(family.alias("family"), "status").agg(F.count(F.lit(1)).alias("n"))


def load_times(pages: DataFrame) -> DataFrame:
    """Mean rounded to a whole number, nearest-rank percentiles and maximum; all null without pages."""
    return pages.agg(F.round(F.avg("loadTimeMs")).alias("avg"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY loadTimeMs)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY loadTimeMs)").alias("p95"), F.max("loadTimeMs").alias("max"))


def retries(attempts: DataFrame) -> DataFrame:
    """Attempts after the first, by the status or error that called for them."""
    again = attempts.filter("attempt > 0")
    return again.groupBy(F.coalesce(F.col("status").cast("string"), F.lit("error")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def clamped(x: Column, low: int, high: int, otherwise: int) -> Column:
    """A whole number within bounds; ``otherwise`` for what isn't one."""
    number = F.floor(x.cast("string").try_cast("double"))
    return F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number))).otherwise(F.lit(otherwise)).cast("long")


def backoff_ms(retry_after: Column, attempt: Column, delay_ms: int = 3000) -> Column:
    return F.when(retry_after > 0, retry_after * 1000).otherwise((attempt + 2) * delay_ms)


def network(graph: DataFrame) -> DataFrame:
    """Counts and averages of the graph, and the first node in URL order with the most of each."""
    def most(column: str, where: Column | None = None) -> Column:
        value = F.when(where, F.col(column)) if where is not None else F.col(column)
        return F.min_by("url", F.struct(-value, F.col("url")))

    return graph.agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("outbound_count"), F.lit(0)).alias("edges"), F.count_if("is_orphan").alias("orphans"), F.count_if("is_sink").alias("sinks"), F.count_if("is_hub").alias("hubs"),
        F.round(F.avg("inbound_count"), 2).alias("average_inbound"), F.round(F.avg("depth_from_home"), 2).alias("average_depth"), most("inbound_count").alias("most_linked"),
        most("outbound_count").alias("most_linking"), most("seo_pagerank_score").alias("highest_seo_rank"),
    )


def crawl_stats(pages: DataFrame, issues: DataFrame, graph: DataFrame, unreachable: DataFrame) -> DataFrame:
    """One row of all run figures: one-row aggregates side by side."""
    def family(low: int, high: int) -> Column:
        return F.count_if(F.col("status").between(low, high))

    p = pages.agg(
        F.count(F.lit(1)).alias("pages"), family(200, 299).alias("status_2xx"), family(300, 399).alias("status_3xx"), family(400, 499).alias("status_4xx"), family(500, 599).alias("status_5xx"),
        F.count_if(~F.col("status").between(200, 599)).alias("status_other"), F.count_if("redirected").alias("redirected_pages"),
    )
    i = issues.agg(F.count_if(is_fetch_failure(F.col("code"))).alias("fetch_failures"), F.count_if(F.col("code") == "orphaned_collection").alias("orphaned_collections"))
    b = unreachable.agg(F.count(F.lit(1)).alias("unreachable_products"), *[F.count_if(F.col("bucket") == k).alias(n) for k, n in (("A_no_collection", "unreachable_a"), ("B_collection_crawled_not_linked", "unreachable_b"), ("C_collection_not_crawled", "unreachable_c"))])
    return p.join(load_times(pages)).join(i).join(network(graph)).join(b)


def crawl_table(pages: DataFrame, issues: DataFrame, graph: DataFrame, unreachable: DataFrame, attempts: DataFrame, probes: DataFrame, skipped: int = 0, generated_at: str = "") -> DataFrame:
    """All run figures as one flat row. ``attempts`` is the fetch log, ``probes`` the probe's row for each collection."""
    def discovered(*sources: str) -> Column:
        return F.count_if(F.col("discoverySource").isin(*sources) & (F.col("pageType") == "product"))

    p = pages.agg(
        discovered("api_seed", "api_probe").alias("api_seeded_products"), F.count_if(F.col("discoverySource").isin("api_seed", "api_probe") & (F.col("pageType") == "collection")).alias("api_seeded_collections"),
        discovered("pagination_probe").alias("probe_discovered_products"), discovered("sitemap_unlisted").alias("sitemap_only_products"),
    )

    def as_json(rows: DataFrame, key: str, name: str) -> DataFrame:
        counted = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return counted.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias(name))

    again = attempts.filter("attempt > 0")
    a = attempts.agg(F.count(F.lit(1)).alias("totalRequested"))
    r = again.agg(F.count(F.lit(1)).alias("totalRetries"), F.count_if(F.col("status").isNotNull()).alias("statusRetries"), F.count_if(F.col("status").isNull()).alias("errorRetries"))
    q = probes.agg(
        F.count(F.lit(1)).alias("probe_collections_attempted"), F.count_if(F.col("stop_reason") == "zero_new_products").alias("probe_collections_exhausted"),
        F.count_if(F.col("stop_reason").isin("empty_response", "failed_status", "both_tiers_failed", "parse_or_fetch_error")).alias("probe_collections_failed"), F.coalesce(F.sum("pages_probed"), F.lit(0)).alias("probe_total_pages_fetched"),
    )
    buckets = as_json(unreachable, "bucket", "unreachable_product_buckets")
    best = graph.agg(F.max(F.struct("seo_pagerank_score")).alias("s"), F.min_by("url", F.struct(-F.col("pagerank_score"), F.col("url"))).alias("top_pagerank_url"))
    stats = crawl_stats(pages, issues, graph, unreachable)
    one = stats.join(p).join(a).join(r).join(q).join(buckets).join(best).join(as_json(pages, "status", "exactStatusCounts")).join(as_json(again, "status", "retryStatusCounts"))  # one row each
    return one.select(
        F.lit(generated_at).alias("generatedAt"), "totalRequested", F.col("pages").alias("totalCrawled"), *[F.col(f"status_{s}").alias(f"status{s.capitalize() if s == 'other' else s}") for s in ("2xx", "3xx", "4xx", "5xx", "other")], "exactStatusCounts",
        F.col("fetch_failures").alias("fetchFailedCount"), F.lit(skipped).cast("long").alias("skippedNonHtmlCount"), "api_seeded_products", "api_seeded_collections", "probe_discovered_products", "probe_collections_attempted",
        "probe_collections_exhausted", "probe_collections_failed", "probe_total_pages_fetched", "sitemap_only_products", F.col("orphaned_collections").alias("orphaned_collection_count"), "unreachable_product_buckets",
        F.col("redirected_pages").alias("redirectedCount"), "totalRetries", "statusRetries", "errorRetries", "retryStatusCounts", F.col("avg").alias("avgLoadTimeMs"), F.col("p50").alias("p50LoadTimeMs"), F.col("p95").alias("p95LoadTimeMs"), F.col("max").alias("maxLoadTimeMs"),
        F.col("nodes").alias("total_nodes"), F.col("edges").alias("total_edges"), F.col("orphans").alias("orphan_count"), F.col("sinks").alias("sink_count"), F.col("hubs").alias("hub_count"), F.col("average_inbound").alias("avg_inbound_links"),
        F.col("most_linked").alias("max_inbound_url"), F.col("average_depth").alias("avg_depth_from_home"), "top_pagerank_url", F.col("highest_seo_rank").alias("top_seo_pagerank_url"), F.coalesce("s.seo_pagerank_score", F.lit(0.0)).alias("top_seo_pagerank_score"),
    )


def dashboard(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages, issues, issues by severity, and the most frequent codes in order."""
    one = pages.agg(F.count(F.lit(1)).alias("pageRows")).join(issues.agg(F.count(F.lit(1)).alias("issueCount")))
    by = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severityCounts"))
    top = top_codes(issues).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["code"].alias("code"), (-x["n"]).alias("n"))).alias("topIssueCodes"))
    return one.join(by).join(top)  # one row each


def unreachable_products(pages: DataFrame, issues: DataFrame, graph: DataFrame, memberships: DataFrame) -> DataFrame:
    """Products without an HTML link to them, in buckets by whether a collection that holds them was crawled."""
    hidden = issues.filter("code = 'no_html_inbound_link'").groupBy("url").agg(F.min("reachable_via").alias("reachable_via"))
    rows = hidden.join(pages.groupBy(F.col("finalUrl").alias("url")).agg(F.max_by(F.struct("status", "pageType", "discoverySource", "graph_key", F.col("_p.path").alias("path"), F.col("_p.origin").alias("origin")), "crawl_seq").alias("p")), "url")
    rows = rows.filter(u.segment_after(F.col("p.path"), "products").isNotNull()).withColumn("product_handle", u.segment_after(F.col("p.path"), "products"))
    crawled = pages.filter(F.col("_p.path").rlike("^/collections/[^/]+/?$") & (F.col("status") < 400)).select(u.segment_after(F.col("_p.path"), "collections").alias("collection_handle")).distinct()
    held = memberships.distinct().join(crawled.withColumn("_c", F.lit(True)), "collection_handle", "left").groupBy("product_handle").agg(
        F.array_join(F.array_sort(F.collect_set("collection_handle")), "|").alias("collections"), F.count_distinct("collection_handle").alias("held_by"), F.coalesce(F.bool_or("_c"), F.lit(False)).alias("crawled")
    )
    ranked = graph.select(F.col("url").alias("graph_key"), "inbound_count", "pagerank_score")
    out = rows.withColumn("graph_key", F.col("p.graph_key")).join(held, "product_handle", "left").join(ranked, "graph_key", "left")
    bucket = F.when(F.col("collections").isNull(), "A_no_collection").when(F.col("crawled"), "B_collection_crawled_not_linked").otherwise("C_collection_not_crawled")
    return out.select("url", "product_handle", F.col("p.status").alias("status"), F.col("p.discoverySource").alias("source"), "reachable_via", F.coalesce("inbound_count", F.lit(0)).alias("inbound_count"), F.coalesce("pagerank_score", F.lit(0.0)).alias("pagerank_score"), F.coalesce("collections", F.lit("no_collection")).alias("in_collections"), F.coalesce("crawled", F.lit(False)).alias("collection_crawled"), F.coalesce("held_by", F.lit(0)).alias("collections_count"), bucket.alias("bucket"))


def bucket_counts(unreachable: DataFrame) -> DataFrame:
    return unreachable.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def flat_pages(pages: DataFrame) -> DataFrame:
    """The page table as flat columns, for text sinks."""
    meta = [F.col(f"meta.{f.name}").alias(f.name if f.name[:2] in ("og", "tw") else f"meta_{f.name}") for f in pages.schema["meta"].dataType.fields if f.name != "alternates"]
    speed = [F.array_join(F.col(f"speed.{f.name}"), "|").alias(f.name) if "Hosts" in f.name else F.col(f"speed.{f.name}").alias(f.name) for f in pages.schema["speed"].dataType.fields]
    heads = [F.array_join(F.col(f"headings.{h}"), " | ").alias(h) for h in ("h1", "h2", "h3")]
    links = [F.size("links").alias("linkCount"), F.size(F.filter("links", lambda x: x["internal"])).alias("internalLinkCount"), F.size("images").alias("storedImageCount"), F.size("meta.alternates").alias("hreflangCount")]
    plain = [c for c in ("url", "finalUrl", "discoverySource", "redirected", "redirectCount", "status", "depth", "contentType", "xRobotsTag", "loadTimeMs", "pageType", "wordCount", "textHash") if c in pages.columns]
    return pages.select(*plain, *meta, *heads, *links, F.col("shopify.isShopify").alias("isShopify"), F.array_join("shopify.detectedApps", "|").alias("detectedApps"), *speed)
