"""Recorded inputs: what a crawl, its interfaces and probes left behind, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as u
from ..schema import RAW_PAGE


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetch records in the schema of raw pages."""
    return spark.read.schema(RAW_PAGE).parquet(path)


def header_columns(headers: Column, html: Column) -> Column:
    """The headers that reports show, by lower-case name, and the size of the body."""
    def h(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at(headers, F.lit(n)) for n in names])

    return F.struct(
        h("x-robots-tag").alias("xRobotsTag"), h("content-type").alias("contentType"), h("last-modified").alias("lastModified"), h("etag").alias("etag"), h("cache-control").alias("cacheControl"),
        h("server").alias("server"), h("cf-cache-status").alias("cfCacheStatus"), h("cdn-cache", "x-cache", "x-cache-status").alias("cdnCacheStatus"), h("content-length").alias("contentLength"), F.octet_length(html).cast("long").alias("responseSizeBytes"),
    )


# --- sitemaps ---------------------------------------------------------------------------------------


def sitemap_lines(robots: DataFrame, text: str = "value") -> DataFrame:
    """Sitemap URLs that robots.txt names."""
    line = F.explode(F.split(F.col(text), r"\r?\n"))
    return robots.select(line.alias("l")).select(F.trim(F.regexp_extract("l", r"(?i)^\s*sitemap:\s*(.+)$", 1)).alias("sitemap")).filter("sitemap <> ''").distinct()


def looks_like_sitemap(xml: Column) -> Column:
    return xml.rlike(r"(?i)<(urlset|sitemapindex)[\s>]")


def sitemap_kind(url: Column) -> Column:
    low = F.lower(url)
    out = F.when(F.contains(low, F.lit("product")), "product").when(F.contains(low, F.lit("collection")), "collection")
    return out.when(F.contains(low, F.lit("blog")) | F.contains(low, F.lit("article")), "blog").when(F.contains(low, F.lit("page")), "page").when(F.contains(low, F.lit("polic")), "policy").otherwise("other")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``(sitemap, pos, url)`` from ``(sitemap, xml)``: the addresses of urlsets, in order, empty ones left out."""
    plain = F.regexp_replace("xml", r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")
    rows = sitemaps.filter(looks_like_sitemap(F.col("xml"))).select("sitemap", F.posexplode(F.xpath(plain, F.lit("/urlset/url/loc/text()"))).alias("pos", "url"))
    return rows.withColumn("url", F.trim("url")).filter("url <> ''")


#: Where a sitemap is looked for if robots.txt names none (fixed values).
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap_products_1.xml")


def detected_sitemaps(robots: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(sitemap, found_by)``: those of robots.txt, or else the first usual path that answered with a sitemap. ``candidates``: ``(sitemap, status, xml)``."""
    named = sitemap_lines(robots).withColumn("found_by", F.lit("robots"))
    place = F.array_position(F.array(*[F.lit(p) for p in SITEMAP_PATHS]), F.regexp_replace("sitemap", "^https?://[^/]+", ""))
    usual = candidates.filter((F.col("status") < 400) & looks_like_sitemap(F.col("xml")) & (place > 0)).agg(F.min_by("sitemap", place).alias("sitemap")).filter("sitemap is not null")
    any_named = named.agg((F.count(F.lit(1)) > 0).alias("_any"))
    return named.unionByName(usual.join(any_named).filter("not _any").select("sitemap", F.lit("common").alias("found_by")))  # one row on either side


def sitemap_children(sitemaps: DataFrame) -> DataFrame:
    plain = F.regexp_replace("xml", r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")
    return sitemaps.filter(looks_like_sitemap(F.col("xml"))).select("sitemap", F.explode(F.xpath(plain, F.lit("/sitemapindex/sitemap/loc/text()"))).alias("child")).withColumn("child", F.trim("child")).filter("child <> ''")


def select_sitemaps(entries: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Add ``selected``: entries whose URL and kind hold an included and no excluded text; if none does, all are."""
    text = F.lower(F.concat_ws(" ", "sitemap", "kind"))
    hit = F.lit(not include)
    for word in include:
        hit = hit | F.contains(text, F.lit(word.lower()))
    for word in exclude:
        hit = hit & ~F.contains(text, F.lit(word.lower()))
    any_hit = entries.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_any"))
    return entries.withColumn("_hit", hit).join(any_hit).select(*entries.columns, (F.col("_hit") | ~F.col("_any")).alias("selected"))  # one row on the right


def crawl_list(urls: DataFrame, most: int) -> DataFrame:
    """The first ``most`` different URLs in the order of sitemap and place."""
    first = urls.groupBy("url").agg(F.min(F.struct("sitemap", "pos")).alias("at"))
    return first.orderBy("at").limit(most).select("url")


def sitemap_inventory(entries: DataFrame, urls: DataFrame) -> DataFrame:
    counted = urls.groupBy("sitemap").agg(F.count(F.lit(1)).alias("urls"))
    return entries.join(counted, "sitemap", "left").fillna({"urls": 0})


# --- interfaces -------------------------------------------------------------------------------------


def api_url(origin: Column, kind: str, page: Column, limit: int = 250) -> Column:
    return F.concat(origin, F.lit(f"/{kind}.json?limit={limit}&page="), page.cast("string"))


def probe_url(origin: Column, handle: Column, page: Column, tier: str = "json", limit: int = 250) -> Column:
    if tier == "json":
        return F.concat(origin, F.lit("/collections/"), handle, F.lit(f"/products.json?limit={limit}&page="), page.cast("string"))
    return F.concat(origin, F.lit("/collections/"), handle, F.lit(f"?limit={limit}&page="), page.cast("string"))


def api_handles(bodies: DataFrame, kind: str) -> DataFrame:
    """Handles in order from JSON bodies ``(page_no, body)``; bodies of another shape hold none. The list ends at the first page without any."""
    parsed = F.from_json("body", f"{kind} array<struct<handle:string>>")[kind]
    rows = bodies.select("page_no", F.coalesce(F.transform(parsed, lambda x: x["handle"]), F.array().cast("array<string>")).alias("h"))
    stop = rows.filter(F.size("h") == 0).agg(F.coalesce(F.min("page_no"), F.lit(2**31 - 1)).alias("stop"))
    kept = rows.join(stop).filter("page_no < stop")  # one row on the right
    return kept.select(F.explode("h").alias("handle"), "page_no").filter("handle is not null and handle <> ''").groupBy("handle").agg(F.min("page_no").alias("page_no"))


def may_be_probed(p: Column, status: Column) -> Column:
    s = u.segments(p["path"])
    return (status == 200) & (p["query"] == "") & (F.get(s, 0) == "collections") & (F.size(s) >= 2) & (F.coalesce(F.get(s, 2), F.lit("")) != "products") & (F.get(s, 1) != "all")


def stops_probe(status: Column) -> Column:
    return (status == 404) | (status >= 500)


def probe(log: DataFrame, max_pages: int = 20) -> DataFrame:
    """Pagination probes from ``(collection, page_no, product_handle)``: pages read until one brings no new product.

    A handle is new where it occurs first; that and the sums by page are aggregates, no collection is sorted as a whole.
    """
    inside = log.filter(F.col("page_no") <= max_pages)
    first = inside.groupBy("collection", "product_handle").agg(F.min("page_no").alias("page_no"))
    new = first.groupBy("collection", "page_no").agg(F.count(F.lit(1)).alias("new_products"))
    seen = inside.groupBy("collection", "page_no").agg(F.count_distinct("product_handle").alias("products_found"))
    pages = seen.join(new, ["collection", "page_no"], "left").fillna({"new_products": 0})
    stop = pages.groupBy("collection").agg(F.min(F.when(F.col("new_products") == 0, F.col("page_no"))).alias("stop_page"), F.max("page_no").alias("last_page"))
    read = pages.join(stop, "collection").filter(F.col("stop_page").isNull() | (F.col("page_no") <= F.col("stop_page")))
    reason = F.when(F.max("stop_page").isNotNull(), "zero_new_products").when(F.max("last_page") >= max_pages, "max_probe_pages").otherwise("empty_response")
    return read.groupBy("collection").agg(F.count(F.lit(1)).alias("pages_probed"), F.sum("products_found").alias("products_seen"), F.sum("new_products").alias("unique_products"), reason.alias("stop_reason"))


def probe_pages(log: DataFrame, max_pages: int = 20) -> DataFrame:
    """``(collection, page, products_found, new)`` for each page that a probe read."""
    inside = log.filter(F.col("page_no") <= max_pages)
    first = inside.groupBy("collection", "product_handle").agg(F.min("page_no").alias("page_no"))
    new = first.groupBy("collection", "page_no").agg(F.count(F.lit(1)).alias("new"))
    seen = inside.groupBy("collection", "page_no").agg(F.count_distinct("product_handle").alias("products_found")).join(new, ["collection", "page_no"], "left").fillna({"new": 0})
    stop = seen.filter("new = 0").groupBy("collection").agg(F.min("page_no").alias("_stop"))
    read = seen.join(stop, "collection", "left").filter(F.col("_stop").isNull() | (F.col("page_no") <= F.col("_stop")))
    return read.select("collection", F.col("page_no").alias("page"), "products_found", "new")


def probe_totals(probes: DataFrame) -> DataFrame:
    """One row for a run of probes alone."""
    return probes.agg(F.count(F.lit(1)).alias("total_collections_probed"), F.coalesce(F.sum("unique_products"), F.lit(0)).alias("total_products_discovered"), F.lit(True).alias("probe_only_mode"))


def html_handles(bodies: DataFrame, collection: str) -> DataFrame:
    """Product handles in order from listing pages ``(page_no, body)`` of a collection, those of its own host, where the JSON interface doesn't answer; stops as ``api_handles`` does."""
    hrefs = F.regexp_extract_all("body", F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    own = u.parts(F.lit(collection))["origin"]
    found = F.transform(hrefs, lambda h: u.bound(u.parts(h, F.lit(collection)), lambda p: F.when(p["origin"] == own, u.segment_after(p["path"], "products"))))
    found = F.array_distinct(F.filter(found, lambda h: h.isNotNull()))
    rows = bodies.select("page_no", F.coalesce(found, F.array().cast("array<string>")).alias("h"))
    stop = rows.filter(F.size("h") == 0).agg(F.coalesce(F.min("page_no"), F.lit(2**31 - 1)).alias("stop"))
    kept = rows.join(stop).filter("page_no < stop")  # one row on the right
    return kept.select(F.explode("h").alias("handle"), "page_no").groupBy("handle").agg(F.min("page_no").alias("page_no"))


def memberships(log: DataFrame) -> DataFrame:
    return log.select("product_handle", F.col("collection").alias("collection_handle")).distinct()


def unlisted_products(sitemap: DataFrame, seeded: DataFrame) -> DataFrame:
    """Products of sitemaps that no interface named."""
    p = u.parts("url", idn=True)
    handles = sitemap.filter(sitemap_kind(F.col("sitemap")) == "product").withColumn("_p", p).select(F.concat(F.col("_p.origin"), F.lit("/products/"), u.segment_after(F.col("_p.path"), "products")).alias("url")).filter("url is not null").distinct()
    return handles.join(seeded.select("url"), "url", "left_anti")


# --- page speed interface ---------------------------------------------------------------------------

_AUDIT = "struct<title:string,score:double,numericValue:double,details:struct<overallSavingsMs:double>>"
_PSI = f"lighthouseResult struct<categories:map<string,struct<score:double>>,audits:map<string,{_AUDIT}>>"


def page_speed(results: DataFrame, most: int = 5) -> DataFrame:
    """Scores, metrics and the audits that would save most, from ``(url, body)``. The layout shift keeps its fraction."""
    r = F.from_json("body", _PSI)["lighthouseResult"]

    def score(name: str) -> Column:
        return F.round(F.try_element_at(F.col("r.categories"), F.lit(name))["score"] * 100).cast("int")

    def metric(name: str, digits: int = 0) -> Column:
        return F.round(F.try_element_at(F.col("r.audits"), F.lit(name))["numericValue"], digits)

    saving = lambda a: F.coalesce(a["details"]["overallSavingsMs"], F.lit(0.0))
    chances = F.filter(F.map_values("r.audits"), lambda a: saving(a) > 0)
    ordered = F.array_sort(chances, lambda a, b: F.when(saving(a) != saving(b), F.when(saving(a) > saving(b), -1).otherwise(1)).otherwise(F.when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1).otherwise(0)))
    return results.withColumn("r", r).select(
        "url", score("performance").alias("performance"), score("seo").alias("seo"), metric("largest-contentful-paint").alias("lcp_ms"), metric("total-blocking-time").alias("tbt_ms"), metric("cumulative-layout-shift", 3).alias("cls"),
        F.array_join(F.transform(F.slice(ordered, 1, most), lambda a: a["title"]), " | ").alias("opportunities"), F.when(F.col("r").isNull(), "error").otherwise("ok").alias("state"),
    )


_FULL_AUDIT = "struct<id:string,title:string,displayValue:string,numericValue:double,details:struct<type:string,overallSavingsMs:double>>"
_FULL_PSI = (
    f"lighthouseResult struct<fetchTime:string,categories:map<string,struct<score:double>>,audits:map<string,{_FULL_AUDIT}>>, "
    "loadingExperience struct<metrics:map<string,struct<percentile:bigint>>>"
)


def page_speed_table(results: DataFrame, most: int = 5) -> DataFrame:
    """All columns of the page-speed report from ``(url, strategy, error, body)``; without a result, the row keeps only what was asked and the error."""
    def score(name: str) -> Column:
        return F.round(F.try_element_at(F.col("r.lighthouseResult.categories"), F.lit(name))["score"] * 100).cast("int")

    def metric(name: str, digits: int = 0) -> Column:
        return F.round(F.try_element_at(F.col("r.lighthouseResult.audits"), F.lit(name))["numericValue"], digits)

    def field(name: str) -> Column:
        return F.try_element_at(F.col("r.loadingExperience.metrics"), F.lit(name))["percentile"]

    saving = lambda a: F.coalesce(a["details"]["overallSavingsMs"], F.lit(0.0))
    chances = F.filter(F.map_values("r.lighthouseResult.audits"), lambda a: a["details"]["type"] == "opportunity")
    placed = F.array_sort(F.transform(chances, lambda a, i: F.struct((-saving(a)).alias("s"), i.alias("i"), F.concat(F.coalesce(a["title"], a["id"]), F.lit(": "), F.coalesce(a["displayValue"], F.concat(F.round(saving(a)).cast("long").cast("string"), F.lit(" ms")))).alias("t"))))
    ok = F.col("r.lighthouseResult").isNotNull()
    return results.withColumn("r", F.from_json("body", _FULL_PSI)).select(
        "url", "strategy", F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, "").otherwise(F.coalesce("error", F.lit("no result"))).alias("error"), F.coalesce("r.lighthouseResult.fetchTime", F.lit("")).alias("fetchTime"),
        score("performance").alias("performanceScore"), score("accessibility").alias("accessibilityScore"), score("best-practices").alias("bestPracticesScore"), score("seo").alias("seoScore"),
        metric("first-contentful-paint").alias("firstContentfulPaintMs"), metric("largest-contentful-paint").alias("largestContentfulPaintMs"), metric("speed-index").alias("speedIndexMs"), metric("total-blocking-time").alias("totalBlockingTimeMs"),
        metric("cumulative-layout-shift", 3).alias("cumulativeLayoutShift"), metric("interactive").alias("interactiveMs"), field("LARGEST_CONTENTFUL_PAINT_MS").alias("cruxLargestContentfulPaintMs"),
        field("CUMULATIVE_LAYOUT_SHIFT_SCORE").alias("cruxCumulativeLayoutShift"), field("INTERACTION_TO_NEXT_PAINT").alias("cruxInteractionToNextPaintMs"),
        F.coalesce(F.array_join(F.transform(F.slice(placed, 1, most), lambda x: x["t"]), " | "), F.lit("")).alias("topOpportunities"),
    )


def page_speed_sample(pages: DataFrame, results: DataFrame, most_pages: int, strategy: str = "mobile", most: int = 5) -> DataFrame:
    """The page-speed report of the first ``most_pages`` answering pages in the order of the crawl, a row for each address, from ``(url, strategy, error, body)``; a page without a result is an error."""
    first = pages.filter("status = 200").groupBy(F.col("finalUrl").alias("url")).agg(F.min("crawl_seq").alias("place")).orderBy("place", "url").limit(most_pages)
    known = results.filter(F.col("strategy") == strategy).select("url", "error", "body")
    asked = first.join(known, "url", "left").select("url", F.lit(strategy).alias("strategy"), "error", "body", "place")
    return page_speed_table(asked, most).join(first, "url")


def first_occurrence(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Flag the first row of each key."""
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1)
