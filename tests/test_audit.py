"""A whole run over a small site, and the parts of the engine that a run doesn't reach by itself."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlsight import schema
from crawlsight.functions import url as u
from crawlsight.operators import extract, graph, lineage, reports, rules, site
from crawlsight.plans import audit
from crawlsight.sources import recorded, sinks
from crawlsight.streaming import live

HOST = "https://ex.com"


def html(title, links=(), body="", head=""):
    anchors = "".join(f'<a href="{x}">go to {x}</a>' for x in links)
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title}</title>{head}</head><body><h1>{title}</h1><p>{body}</p>{anchors}</body></html>'


SITE = [
    (1, "/", "/", None, 200, html("Home of the shop with many things", ["/collections/c", "/products/a", "/old", "/cart"])),
    (2, "/collections/c", "/collections/c", None, 200, html("Shirts in one collection", ["/products/a", "/products/b", "/"])),
    (3, "/products/a", "/products/a", None, 200, html("Blue cotton shirt for summer days", ["/collections/c"], "cotton in stock", '<meta name="robots" content="noindex">')),
    (4, "/products/b", "/products/b", None, 200, html("Blue cotton shirt for summer days", ["/collections/c", "/collections/gone"], "cotton sold out")),
    (5, "/old", "/pages/new", None, 200, html("A page that moved to another place")),
    (6, "/collections/gone", "/collections/gone", None, 404, html("Not found")),
    (7, "/products/hidden", "/products/hidden", "pagination_probe", 200, html("Hidden thing without any link to it")),
    (8, "/collections/lost", "/collections/lost", None, 200, html("Lost collection that no page links to", ["/products/a"])),
    (9, "/pages/err", "/pages/err", None, 503, html("Error")),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(n, HOST + a, HOST + b, s, False, int(a != b), status, 0, "text/html", None, 100 * n, x) for n, a, b, s, status, x in SITE]
    return extract.with_redirect(spark.createDataFrame(rows, schema.RAW_PAGE))


@pytest.fixture(scope="module")
def left(spark):
    sitemap = spark.createDataFrame([("https://ex.com/sitemap_products_1.xml", f"{HOST}/products/a", 0), ("https://ex.com/sitemap_products_1.xml", f"{HOST}/products/unlisted", 1)], "sitemap string, url string, pos int")
    log = spark.createDataFrame([("c", 1, "a"), ("c", 1, "hidden"), ("c", 2, "a"), ("far", 1, "hidden")], schema.PROBE_LOG)
    attempts = spark.createDataFrame([("u", 200, 10, False, 0, "", ""), ("u", 503, 10, False, 1, "", ""), ("u", None, 10, False, 1, "ETIMEDOUT", "")], schema.FETCH_LOG)
    body = '{"lighthouseResult":{"fetchTime":"t","categories":{"performance":{"score":0.505},"seo":{"score":1}},"audits":{"speed-index":{"numericValue":12.4},"x":{"title":"X","details":{"type":"opportunity","overallSavingsMs":5}},"y":{"id":"y","displayValue":"much","details":{"type":"opportunity","overallSavingsMs":9}},"z":{"title":"Z","details":{"type":"table","overallSavingsMs":99}}}},"loadingExperience":{"metrics":{"INTERACTION_TO_NEXT_PAINT":{"percentile":80}}}}'
    speed = spark.createDataFrame([(HOST, "mobile", None, body), (f"{HOST}/x", "mobile", "timed out", None)], "url string, strategy string, error string, body string")
    sitemaps = spark.createDataFrame([("https://ex.com/sitemap_products_1.xml", "product")], "sitemap string, kind string")
    return audit.Recorded(sitemap, sitemaps, log, attempts, speed, None, HOST, "2026-01-01")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("run"))


@pytest.fixture(scope="module")
def made(spark, raw, left, folder):
    """The tables of a run, as they were written and read back."""
    tables = audit.run(raw, folder, left)
    return {n: spark.read.schema(df.schema).json(f"{folder}/{n}/json") for n, df in tables.items()}


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def test_redirects_follow_from_the_urls(raw, made):
    assert {r["url"] for r in raw.filter("redirected").collect()} == {f"{HOST}/old"}
    got = {r["requestedUrl"]: r for r in rows(made["redirects"])}
    assert made["redirects"].columns == ["url", "requestedUrl", "finalUrl", "status", "pageType", "redirected", "redirectCount", "redirectStatus", "canonical", "issueCodes", "recommendation"]
    assert got[f"{HOST}/old"]["redirectStatus"] == "single_redirect" and got[f"{HOST}/"]["redirectStatus"] == "no_redirect" and "missing_canonical" in got[f"{HOST}/"]["issueCodes"]


def test_issues_of_a_run(made):
    assert made["issues"].columns == [*audit.ISSUES, "metric"]
    found = {}
    for r in rows(made["issues"]):
        found.setdefault(r["code"], []).append(r)
    for code, url in (
        ("duplicate_title", "/products/a"), ("broken_collection_link", "/collections/gone"), ("orphaned_collection", "/collections/lost"), ("no_html_inbound_link", "/products/hidden"), ("fetch_server_error", "/pages/err"),
        ("url_redirects", "/old"), ("internal_link_to_redirect", "/"), ("indexable_page_missing_from_sitemap", "/products/b"), ("sitemap_url_not_indexable", "/products/a"),
    ):
        assert f"{HOST}{url}" in {r["url"] for r in found[code]}, code
    (noindex,) = found["noindex_page"]
    assert (noindex["url"], noindex["noindex_source"], noindex["noindex_removable"]) == (f"{HOST}/products/a", "meta_robots", True)
    assert found["broken_collection_link"][0]["inbound_sources"] == f"{HOST}/products/b" and found["orphaned_collection"][0]["handle"] == "lost"
    assert found["no_html_inbound_link"][0]["reachable_via"] == "pagination_probe"


def test_reports_of_a_run(made):
    stats = rows(made["crawl_stats"])[0]
    assert len(stats) == 41
    assert (stats["totalCrawled"], stats["status2xx"], stats["status4xx"], stats["status5xx"], stats["fetchFailedCount"], stats["redirectedCount"]) == (9, 7, 1, 1, 2, 1)
    assert (stats["totalRequested"], stats["totalRetries"], stats["statusRetries"], stats["errorRetries"], stats["probe_collections_attempted"], stats["orphaned_collection_count"]) == (3, 2, 1, 1, 2, 1)
    assert stats["exactStatusCounts"] == '{"200":7,"404":1,"503":1}' and stats["unreachable_product_buckets"] == '{"B_collection_crawled_not_linked":1}'
    speed = {r["url"]: r for r in rows(made["page_speed"])}
    assert len(made["page_speed"].columns) == 19
    assert speed[HOST]["topOpportunities"] == "y: much | X: 5 ms" and speed[HOST]["performanceScore"] == 51 and speed[HOST]["speedIndexMs"] == 12 and speed[HOST]["cruxInteractionToNextPaintMs"] == 80
    assert speed[f"{HOST}/x"]["status"] == "error" and speed[f"{HOST}/x"]["error"] == "timed out"
    hidden = rows(made["unreachable_products"])[0]
    assert (hidden["product_handle"], hidden["collections_count"], hidden["collection_crawled"]) == ("hidden", 2, True)
    board = rows(made["dashboard"])[0]
    assert board["pageRows"] == 9 and sum(board["severityCounts"].values()) == board["issueCount"] == made["issues"].count() and len(board["topIssueCodes"]) == 12
    edges = rows(made["link_graph_edges"])
    assert {"source": f"{HOST}/", "target": f"{HOST}/products/a", "source_type": "home", "target_type": "product"} in edges
    assert made["link_graph_inbound"].count() == len(edges)
    assert rows(made["probe_totals"]) == [{"total_collections_probed": 2, "total_products_discovered": 3, "probe_only_mode": True}]
    assert {(r["collection"], r["page"], r["products_found"], r["new"]) for r in rows(made["probe_pages"])} == {("c", 1, 2, 2), ("c", 2, 1, 0), ("far", 1, 1, 1)}
    assert rows(made["sitemaps"])[0]["urls"] == 2
    state = {r["url"]: r for r in rows(made["indexability"])}
    assert len(made["indexability"].columns) == 14 and state[f"{HOST}/products/a"]["inSitemap"] and not state[f"{HOST}/products/a"]["indexable"]


def test_competing_pages_are_listed_in_full(made):
    groups, pages = rows(made["content_cannibalization"]), rows(made["content_cannibalization_pages"])
    assert [g["group_id"] for g in groups] == [f"CAN-{i + 1:04d}" for i in range(len(groups))] if groups else pages == []
    assert all(sum(p["group_id"] == g["group_id"] for p in pages) == g["size"] for g in groups)


def test_a_run_writes_every_table(spark, made, folder, raw, tmp_path):
    for name in made:
        assert spark.read.option("header", True).csv(f"{folder}/{name}/csv").columns, name
    sinks.write_checkpoint(raw, made["issues"], str(tmp_path / "checkpoint"))
    progress = spark.read.json(str(tmp_path / "checkpoint" / "progress")).first()
    assert (progress["totalCrawled"], progress["issueCount"]) == (9, made["issues"].count())


def test_a_run_without_pages(spark):
    made = audit.tables(audit.page_table(spark.createDataFrame([], schema.RAW_PAGE)))
    assert made["issues"].isEmpty() and made["link_graph_edges"].isEmpty() and made["content_cannibalization"].isEmpty()


def test_parts_without_python_agree_with_the_parser(spark):
    urls = [
        "https://ex.com", "https://ex.com/", "http://a-b.ex.com/x/y.html?z=1&b=2", "https://ex.com/a/../b", "https://ex.com/a/./b", "https://EX.com/a", "https://ex.com:8080/a", "https://ex.com/a#t", "https://ex.com/a b", "/rel?x", "", "nope",
        "https://ex.com//a", "https://ex.com/%41", "https://ex.com/a?", "https://ex.com/.well", "https://ex.com/a..b", "https://1.2.3.4/x", "mailto:a@b", "https://ex.com/a?q='x'", "https://user@ex.com/a", "https://ex.com/ä", None, "https://ex.com/a/?b/c:d@e",
    ]
    frame = spark.createDataFrame([(x, HOST + "/base/") for x in urls], "u string, b string")
    for r in frame.select("u", u.parts("u", "b").alias("p")).collect():
        assert tuple(r["p"]) == u.take_apart(r["u"], HOST + "/base/"), r["u"]


def test_numbers_without_one_task(spark):
    frame = spark.createDataFrame([(i * 7 % 1000, i % 3) for i in range(1000)], "x int, g int")
    got = lineage.numbered(frame, [F.desc("g"), F.col("x")], "numbers", "n").collect()
    want = sorted(((r["x"], r["g"]) for r in got), key=lambda r: (-r[1], r[0]))
    assert [(r["x"], r["g"]) for r in sorted(got, key=lambda r: r["n"])] == want and {r["n"] for r in got} == set(range(1, 1001))


def test_graph_parts_and_depth_without_a_limit(spark):
    edges = spark.createDataFrame([(f"{HOST}/pages/{i}" if i else f"{HOST}/", f"{HOST}/pages/{i + 1}") for i in range(12)], schema.EDGE)
    nodes = spark.createDataFrame([(f"{HOST}/",), *[(f"{HOST}/pages/{i}",) for i in range(1, 13)]], "id string").withColumn("type", u.node_type(graph.path_of("id")))
    assert max(r["depth"] for r in graph.depths(edges, nodes).collect()) == 12 and max(r["depth"] or 0 for r in graph.depths(edges, nodes, 3).collect()) == 3


def test_views_of_a_graph(spark, made):
    edges = made["link_graph_edges"].select(F.col("source").alias("src"), F.col("target").alias("dst")).unionByName(spark.createDataFrame([(f"{HOST}/", f"{HOST}/products/unknown")], schema.EDGE))
    rows_ = graph.described(edges, made["link_graph_nodes"], made["link_graph_summary"])
    by_id = {r["id"]: r for r in rows_.collect()}
    new = by_id[f"{HOST}/products/unknown"]
    assert (new["type"], new["crawled"], new["inbound_count"], new["is_orphan"], new["is_utility"]) == ("product", False, 0, False, False) and by_id[f"{HOST}/products/a"]["inbound_count"] == 3
    inside, kept = graph.view(edges, rows_, "catalog", " PRODUCTS ")
    assert {r["id"] for r in kept.collect()} == {i for i in by_id if "/products/" in i} and inside.count() == 0
    assert {r["id"] for r in graph.view(edges, rows_, "seo")[1].collect()} == set(by_id) - {f"{HOST}/cart"}
    assert {n: graph.view(edges, rows_, n)[1].count() for n in ("hubs", "orphans")} == {n: sum(r[f"is_{n[:-1]}"] for r in by_id.values()) for n in ("hubs", "orphans")}


def test_small_parts(spark, made):
    frame = spark.createDataFrame([("7.9",), ("-3",), ("900",), ("x",), (None,)], "v string")
    assert [r[0] for r in frame.select(reports.clamped(F.col("v"), 0, 100, 5)).collect()] == [7, 0, 100, 5, 5]
    log = spark.createDataFrame([("c", 1, "a")], schema.PROBE_LOG)
    assert audit.probe_only(log)["probe_totals"].first()["total_collections_probed"] == 1
    assert sorted(r["section"] for r in rows(made["image_summary_rows"])) == ["alt_text_pattern_analysis"] * 4 + ["summary"]


def test_metadata_summary(spark, raw):
    pages = rules.prepare(extract.pages(raw))
    got = {r["finalUrl"]: r["m"] for r in pages.select("finalUrl", rules.metadata_summary().alias("m")).collect()}
    m = got[f"{HOST}/products/a"]
    assert (m["hasNoIndex"], m["isCanonicalValid"], m["hasOpenGraphProductData"], m["ogPriceMismatch"], m["hasViewportIssue"], m["hreflangCount"]) == (True, False, False, False, True, 0)


def test_sitemap_discovery(spark):
    xml, index = "<urlset><url><loc>https://ex.com/a</loc></url></urlset>", "<sitemapindex><sitemap><loc> https://ex.com/s2.xml </loc></sitemap></sitemapindex>"
    usual = spark.createDataFrame([("https://ex.com/sitemap.xml", 404, xml), ("https://ex.com/sitemap_index.xml", 200, index), ("https://ex.com/sitemap_products_1.xml", 200, xml)], "sitemap string, status int, xml string")
    robots = spark.createDataFrame([("Sitemap: https://ex.com/s.xml",)], "value string")
    assert [tuple(r) for r in recorded.detected_sitemaps(robots, usual).collect()] == [("https://ex.com/s.xml", "robots")]
    assert [tuple(r) for r in recorded.detected_sitemaps(robots.limit(0), usual).collect()] == [("https://ex.com/sitemap_index.xml", "common")]
    assert [tuple(r) for r in recorded.sitemap_children(usual).collect()] == [("https://ex.com/sitemap_index.xml", "https://ex.com/s2.xml")]
    urls = spark.createDataFrame([("s1", 1, "b"), ("s1", 0, "a"), ("s2", 0, "b"), ("s2", 1, "c")], "sitemap string, pos int, url string")
    assert [r["url"] for r in recorded.crawl_list(urls, 2).collect()] == ["a", "b"]
    assert {r["sitemap"]: r["urls"] for r in recorded.sitemap_inventory(spark.createDataFrame([("s1",), ("s3",)], "sitemap string"), urls).collect()} == {"s1": 2, "s3": 0}
    listed = spark.createDataFrame([("https://ex.com/sitemap_products.xml", f"{HOST}/products/{x}") for x in "ab"], "sitemap string, url string")
    assert [r["url"] for r in recorded.unlisted_products(listed, spark.createDataFrame([(f"{HOST}/products/a",)], "url string")).collect()] == [f"{HOST}/products/b"]


def test_interfaces_and_probes(spark):
    one = spark.range(1)
    assert one.select(recorded.api_url(F.lit(HOST), "products", F.lit(2))).first()[0] == f"{HOST}/products.json?limit=250&page=2"
    assert one.select(recorded.probe_url(F.lit(HOST), F.lit("c"), F.lit(2))).first()[0] == f"{HOST}/collections/c/products.json?limit=250&page=2"
    assert one.select(recorded.probe_url(F.lit(HOST), F.lit("c"), F.lit(2), "html")).first()[0] == f"{HOST}/collections/c?limit=250&page=2"
    assert [tuple(one.select(recorded.stops_probe(F.lit(s))).first()) for s in (200, 403, 404, 500)] == [(False,), (False,), (True,), (True,)]
    bodies = spark.createDataFrame([(1, '<a href="/collections/c/products/a?x"><a href="/products/b"><a href="https://other.example/products/far">'), (2, "<a href='/products/a'>"), (3, "none"), (4, '<a href="/products/z">')], "page_no int, body string")
    assert {(r["handle"], r["page_no"]) for r in recorded.html_handles(bodies, f"{HOST}/collections/c").collect()} == {("a", 1), ("b", 1)}
    headers = F.create_map(F.lit("server"), F.lit("s"), F.lit("x-cache"), F.lit("HIT"))
    got = one.select(recorded.header_columns(headers, F.lit("äb")).alias("h")).first()["h"]
    assert (got["server"], got["cdnCacheStatus"], got["etag"], got["responseSizeBytes"]) == ("s", "HIT", None, 3)
    flagged = recorded.first_occurrence(spark.createDataFrame([("a", 2), ("a", 1)], "k string, o int"), ["k"], "o").collect()
    assert {r["o"]: r["is_first"] for r in flagged} == {1: True, 2: False}


def test_what_a_crawl_skips(spark):
    for url, want in ((f"{HOST}/a.pdf", True), (f"{HOST}/products/a", False), ("https://o.com/a", True), (f"{HOST}/a?sort_by=x", True), ("mailto:a@b", True), ("nope", True)):
        frame = spark.createDataFrame([(url, HOST)], "u string, b string")
        assert frame.select(u.should_skip(u.parts("u"), u.parts("b"))).first()[0] is want, url


def test_stored_pages_are_compact(raw, spark, tmp_path):
    pages = extract.pages(raw)
    small = extract.compact(pages, links=1, images=0, chars=5).collect()
    assert max(len(r["links"]) for r in small) == 1 and max(len(r["textSample"]) for r in small) == 5
    raw.write.parquet(str(tmp_path / "raw"))
    assert recorded.raw_pages(spark, str(tmp_path / "raw")).count() == 9
    assert extract.resolve(pages.select("finalUrl", F.col("links")), ["finalUrl"], "links", "rawHref", "finalUrl").select("parts.href").distinct().count() > 3
    assert site.with_indexability(pages).select("indexability.indexable").count() == 9


def test_image_issue_counts(spark):
    frame = spark.createDataFrame([("u", "page", "low", "images", "missing_image_alt", "", "", "", 1), ("u", "page", "low", "page_speed", "image_count_high", "", "", "", 1), ("u", "page", "low", "page_speed", "dom_size_large", "", "", "", 1)], schema.ISSUE)
    assert {r["code"]: r["n"] for r in reports.image_issue_counts(frame).collect()} == {"missing_image_alt": 1, "image_count_high": 1}


def test_streams(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "in"))
    issues = live.issue_stream(live.raw_stream(spark, str(tmp_path / "in")))
    issues.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rules.page_issues(extract.pages(raw)).count()
    at = dt.datetime(2026, 1, 1)
    log = spark.createDataFrame([("a", 200, at), ("a", 200, at), ("b", 500, at + dt.timedelta(minutes=7))], "finalUrl string, status int, at timestamp")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    for name, made, mode in (("first", live.first_discoveries(stream, "at"), "append"), ("windows", live.status_windows(stream, "at"), "complete")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {r["finalUrl"] for r in spark.table("first").collect()} == {"a", "b"} and spark.table("first").count() == 2
    assert sorted((r["fetches"], r["failures"]) for r in spark.table("windows").collect()) == [(1, 1), (2, 0)]


def test_rules_that_the_store_never_breaks(spark):
    """One page for each of the rarer codes."""
    long = "a very long text for one image that goes on and on and on " * 3
    cases = [
        ("/collections/all-things", "Products", "", "", "", ("collection_title_too_generic",)),
        ("/collections/c/tag", "A tagged part of one collection", "", "", "", ("indexable_collection_tag_url",)),
        ("/collections/c/products/a", "A product below a collection page", '<link rel="canonical" href="/products/other">', "", "", ("duplicate_product_url_bad_canonical",)),
        ("/products/long-alt", "A product with a long alternative", "", f'<img src="/cdn/shop/files/x.jpg" alt="{long}">', "", ("image_alt_too_long",)),
        ("/pages/brand", "Acme", "", "", "", ("serp_brand_only_title",)),
        ("/pages/canonical", "A page with a broken canonical URL", '<link rel="canonical" href="http://">', "", "", ("invalid_canonical_url",)),
        ("/pages/meta", "A page with directives in its markup", '<meta name="robots" content="max-video-preview:0, noimageindex, unavailable_after: 2030-01-01">', "", "", ("meta_robots_max_video_preview_limited", "meta_robots_noimageindex", "meta_robots_unavailable_after")),
        ("/pages/header", "A page with directives in its header", "", "", "max-image-preview:none, max-snippet:5, noarchive, nosnippet", ("x_robots_tag_max_image_preview_restricted", "x_robots_tag_max_snippet_limited", "x_robots_tag_noarchive", "x_robots_tag_nosnippet")),
    ]
    raw = [(n, HOST + path, HOST + path, None, False, 0, 200, 0, "text/html", header, 1, html(title, (), body, head)) for n, (path, title, head, body, header, _) in enumerate(cases)]
    found = rules.page_issues(extract.pages(spark.createDataFrame(raw, schema.RAW_PAGE)), rules.Settings(brands=("Acme",))).select("url", "code").collect()
    by_url = {}
    for r in found:
        by_url.setdefault(r["url"], set()).add(r["code"])
    for path, _, _, _, _, codes in cases:
        assert set(codes) <= by_url[HOST + path], (path, codes, sorted(by_url[HOST + path]))
    everywhere = set().union(*by_url.values())
    for _, _, _, _, _, codes in cases:
        assert all(sum(c in x for x in by_url.values()) == 1 for c in codes if c != "indexable_collection_tag_url"), codes
    assert "fetch_http_error" not in everywhere
