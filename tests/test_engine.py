"""The engine on small hand-made inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from crawlsight import schema
from crawlsight.functions import images as img
from crawlsight.functions import robots as rb
from crawlsight.functions import text as tx
from crawlsight.functions import url as u
from crawlsight.operators import extract, graph, reports, rules, site
from crawlsight.sources import recorded, sinks
from crawlsight.streaming import live


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,base,want",
    [
        ("https://Ex.com:443/a/../b", None, "https://ex.com/b"), ("/x?y=1#z", "https://ex.com/p/q", "https://ex.com/x?y=1#z"), ("//cdn.ex.com/i.png", "https://ex.com", "https://cdn.ex.com/i.png"),
        ("a b", "https://ex.com/p/", "https://ex.com/p/a%20b"), ("https://ex.com", None, "https://ex.com/"), ("nope", None, None), ("http://", None, None), ("mailto:a@b", "https://ex.com", "mailto:a@b"), ("../../up", "https://ex.com/a/b/c", "https://ex.com/up"),
    ],
)
def test_urls_are_taken_apart(url, base, want):
    assert u.take_apart(url, base)[0] == want


def test_url_forms(spark):
    def form(mode, url):
        return one(spark, u.normalized(u.parts("u"), mode), u=url)

    url = "https://ex.com/p/?utm_source=x&b=2&a=1#h"
    assert form("page", url) == form("compare", url) == "https://ex.com/p"
    assert form("graph", url) == "https://ex.com/p?utm_source=x&b=2&a=1"
    assert form("tracking", url) == "https://ex.com/p?a=1&b=2"
    assert form("sitemap", url) == "https://ex.com/p/?utm_source=x&b=2&a=1"
    assert form("page", "https://ex.com/") == "https://ex.com/" and form("page", "bad") is None
    for mode in ("page", "graph", "compare", "sitemap"):
        assert form(mode, form(mode, url)) == form(mode, url)


def test_page_types(spark):
    for path, page, node in (("/", "home", "home"), ("/products/a", "product", "product"), ("/collections/c/products/a", "product", "collection"), ("/blogs/b/a", "article", "blog"), ("/blogs/b", "blog", "blog"), ("/policies/x", "policy", "other"), ("/cart", "cart", "other")):
        assert one(spark, u.classify(F.col("p")), p=path) == page and one(spark, u.node_type(F.col("p")), p=path) == node
    for path, want in (("/account/login", True), ("/cart", True), ("/products/cartoon-x", False), ("/search", True), ("/passwords", False)):
        assert one(spark, u.is_utility(F.col("p")), p=path) is want


def test_text(spark):
    assert one(spark, tx.clean(F.col("t")), t="a  \n b ") == "a b"
    assert one(spark, tx.truncated(F.col("t"), 8), t="abcdefghij") == "abcde..."
    assert one(spark, tx.overlaps(F.col("a"), F.col("b")), a="red cotton shirt", b="shirt shirt blue") is True
    assert one(spark, tx.overlaps(F.col("a"), F.col("b")), a="red", b="") is True
    assert one(spark, tx.intent_key(F.col("t")), t="Blue T-Shirts for Men, oversized fit") == "fit oversized tshirt"
    assert one(spark, tx.price_mismatch(F.col("a"), F.col("b")), a="1,299.00", b="now Rs. 1,299 only") is False
    assert one(spark, tx.price_mismatch(F.col("a"), F.col("b")), a="999", b="now INR 1,299 only") is True
    found = one(spark, tx.variant_attributes(F.col("t")), t="Navy shirt D12 pack of 3 combo")
    assert found["signals"] == ["color_variant", "model_code_variant", "pack_variant", "combo_variant"]


def test_robots(spark):
    header = "googlebot: noindex, otherbot: max-snippet:10, unavailable_after: 25 Jun 2010 15:00:00 PST, nosnippet"
    d = one(spark, rb.directives(F.col("h")), h=header)
    assert d["noindex"] and d["nosnippet"] and not d["nofollow"] and d["max_snippet"] == "10"
    assert not one(spark, rb.flag(F.col("h"), "noindex|none"), h="max-image-preview:none")
    assert one(spark, rb.flag(F.col("h"), "nofollow|none"), h="NONE")
    state = rb.summary(F.lit(200), F.col("r"), F.col("x"), F.col("c"), F.col("f"), F.lit("2026-01-01").cast("timestamp"))
    base = {"r": "", "x": "", "c": "", "f": "https://ex.com/a"}
    assert one(spark, state, **base)["indexable"]
    assert one(spark, state, **(base | {"x": "noindex", "r": "noindex"}))["status"] == "noindex_x_robots_tag"
    assert one(spark, state, **(base | {"c": "/b"}))["status"] == "canonicalized"
    assert one(spark, state, **(base | {"c": "/a/?x=1"}))["selfReferencing"]
    assert one(spark, state, **(base | {"r": "unavailable_after: 2020-01-01"}))["status"] == "unavailable_after_meta_robots"


def test_images(spark):
    assert one(spark, img.filename(F.col("s")), s="https://x.com/a/b%20c.jpg?width=3") == "b c.jpg"
    assert not one(spark, img.needs_alt(F.col("s")), s="https://x.com/logo.png") and one(spark, img.needs_alt(F.col("s")), s="https://x.com/a.png")
    assert one(spark, img.wide(F.col("s")), s="https://x.com/a.png?v=1&width=1600") and not one(spark, img.wide(F.col("s")), s="https://x.com/a.png?width=80")


HTML = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Red &amp; blue</title><meta name="description" content="d">
<meta property="og:title" content="OG"><link rel="alternate" hreflang="en" href="/en"><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="stylesheet" href="a.css">
<script src="https://x.judge.me/a.js"></script></head><body><h1>Red <b>shirt</b></h1><p>Text<script>no()</script> here</p><a href="/p?x=1#t">One</a><a href="https://o.com/">Out</a>
<img src="/cdn/shop/files/a.jpg?width=2000" alt=" A "><img data-src="//c.com/l.png"></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    raw = spark.createDataFrame([(1, "https://ex.com/products/a", "https://ex.com/products/a", None, False, 0, 200, 0, "text/html", None, 5, HTML), (2, "https://ex.com/x", "https://ex.com/x", None, False, 0, 200, 0, "image/png", None, 5, "binary")], schema.RAW_PAGE)
    return extract.pages(raw)


def test_extraction(page):
    rows = page.collect()
    assert len(rows) == 1
    p = rows[0].asDict(True)
    assert p["meta"]["title"] == "Red & blue" and p["meta"]["ogTitle"] == "OG" and p["meta"]["charsetWithinFirst1024"] and len(p["meta"]["alternates"]) == 2
    assert p["headings"]["h1"] == ["Red shirt"] and "no()" not in p["textSample"]
    assert [(x["href"], x["internal"]) for x in p["links"]] == [("https://ex.com/p", True), ("https://o.com/", False)]
    assert [i["src"] for i in p["images"]] == ["https://ex.com/cdn/shop/files/a.jpg?width=2000", "https://c.com/l.png"] and p["images"][1]["lazy"]
    assert p["speed"]["largeImageUrlCount"] == 1 and p["speed"]["thirdPartyScriptHosts"] == ["x.judge.me"] and p["shopify"]["productHandle"] == "a"


def test_broken_markup_is_read():
    for html in (None, "", "<h1>open <a href=x>link", "<title>t", "<<<>>>", "<p" * 50):
        assert set(extract.parse(html)) == set(schema.PARSED.names)


def test_page_rules(page):
    codes = {r["code"] for r in rules.page_issues(page).collect()}
    assert {"title_length", "missing_canonical", "thin_product_content", "missing_image_alt", "product_low_image_count"} <= codes
    assert not codes & {"missing_title", "missing_h1", "fetch_http_error", "thin_article"}


def test_fetch_failures(spark):
    for status, code, message, want in ((403, "", "", "fetch_blocked_403"), (503, "ETIMEDOUT", "", "fetch_server_error"), (0, "ETIMEDOUT", "", "fetch_timeout"), (0, "", "getaddrinfo x", "fetch_dns_error"), (0, "", "bad Certificate", "fetch_tls_error"), (0, "", "reset", "fetch_unknown_error")):
        assert one(spark, rules.fetch_failure(F.col("s"), F.col("c"), F.col("m")), s=status, c=code, m=message) == want


def _edges(spark, pairs):
    return spark.createDataFrame([(f"https://ex.com{a}", f"https://ex.com{b}") for a, b in pairs], schema.EDGE)


def test_link_graph(spark):
    pairs = [("/", "/collections/c"), ("/collections/c", "/products/a"), ("/products/a", "/products/b"), ("/products/b", "/products/a"), ("/products/a", "/cart")]
    edges = _edges(spark, pairs)
    ids = sorted({x for p in pairs for x in p} | {"/pages/alone"})
    nodes = spark.createDataFrame([(f"https://ex.com{x}", True, None) for x in ids], "id string, crawled boolean, source string").withColumn("type", u.node_type(graph.path_of("id")))
    got = {r["url"].removeprefix("https://ex.com"): r for r in graph.summary(edges, nodes).collect()}
    a = got["/products/a"]
    assert (a["inbound_count"], a["outbound_count"], a["depth_from_home"], a["is_orphan"], a["is_sink"]) == (2, 2, 2, False, False)
    assert got["/pages/alone"]["is_orphan"] and got["/pages/alone"]["depth_from_home"] is None and got["/cart"]["seo_pagerank_score"] == 0 and got["/cart"]["is_utility"]
    assert all(0 <= r["pagerank_score"] <= 1 for r in got.values())


def test_rank_and_depth_against_plain_python(spark):
    rng = random.Random(3)
    names = ["/"] + [f"/products/{i}" for i in range(25)]
    pairs = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(80)) if a != b})
    edges = _edges(spark, pairs)
    nodes = spark.createDataFrame([(f"https://ex.com{x}",) for x in names], "id string").withColumn("type", u.node_type(graph.path_of("id")))
    score = dict.fromkeys(names, 1 / len(names))
    out = {x: sum(a == x for a, _ in pairs) for x in names}
    for _ in range(20):
        score = {x: 0.15 + 0.85 * sum(score[a] / out[a] for a, b in pairs if b == x) for x in names}
    low, high = min(score.values()), max(score.values())
    got = {r["id"].removeprefix("https://ex.com"): r["score"] for r in graph.pagerank(edges, nodes).collect()}
    assert all(abs(got[x] - (score[x] - low) / (high - low)) < 2e-6 for x in names)
    depth, level = {"/": 0}, ["/"]
    while level:
        level = sorted({b for a, b in pairs if a in level} - set(depth))
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    assert {r["id"].removeprefix("https://ex.com"): r["depth"] for r in graph.depths(edges, nodes).collect()} == {x: depth.get(x) for x in names}


def test_load_times(spark):
    rows = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, 50, 60)], "loadTimeMs long")
    assert tuple(reports.load_times(rows).first()) == (35, 30, 60, 60)
    assert tuple(reports.load_times(rows.limit(0)).first()) == (None,) * 4


def test_duplicates_skip_blank_values(spark):
    rows = spark.createDataFrame([(f"u{i}", "page", t, d, h) for i, (t, d, h) in enumerate([("a", "", "x"), ("a", "", "y"), ("", "d", "y"), ("", "d", "z")])], "finalUrl string, pageType string, title string, description string, textHash string")
    rows = rows.withColumn("meta", F.struct("title", "description"))
    got = sorted((r["url"], r["code"]) for r in site.duplicates(rows).collect())
    assert got == [("u0", "duplicate_title"), ("u1", "duplicate_content"), ("u1", "duplicate_title"), ("u2", "duplicate_content"), ("u2", "duplicate_meta_description"), ("u3", "duplicate_meta_description")]


def test_action_plan_orders_by_severity_then_number(spark):
    rows = [("u1", "page", "low", "c", "b", "m", "r", "", None), ("u2", "page", "low", "c", "b", "m", "r", "", None), ("u1", "page", "critical", "c", "a", "m", "r", "", None), ("u1", "page", "low", "c", "z", "m", "r", "", None)]
    got = [(r["priority"], r["code"], r["affectedUrls"]) for r in reports.action_plan(spark.createDataFrame(rows, schema.ISSUE)).orderBy("priority").collect()]
    assert got == [(1, "a", 1), (2, "b", 2), (3, "z", 1)]


def test_sitemaps_and_interfaces(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x.com/a </loc></url><url><loc></loc></url></urlset>'
    frame = spark.createDataFrame([("s", xml), ("t", "<html/>")], "sitemap string, xml string")
    assert [(r["sitemap"], r["url"]) for r in recorded.sitemap_urls(frame).collect()] == [("s", "https://x.com/a")]
    robots = spark.createDataFrame([("User-agent: *\nSitemap: https://x.com/s.xml\nsitemap:https://x.com/t.xml",)], "value string")
    assert {r["sitemap"] for r in recorded.sitemap_lines(robots).collect()} == {"https://x.com/s.xml", "https://x.com/t.xml"}
    bodies = spark.createDataFrame([(1, '{"products":[{"handle":"a"},{"handle":"b"}]}'), (2, '{"products":[{"handle":"a"},{"handle":"c"}]}'), (3, "oops"), (4, '{"products":[{"handle":"d"}]}')], "page_no int, body string")
    assert {(r["handle"], r["page_no"]) for r in recorded.api_handles(bodies, "products").collect()} == {("a", 1), ("b", 1), ("c", 2)}
    log = spark.createDataFrame([("c", 1, "a"), ("c", 1, "b"), ("c", 2, "a"), ("c", 3, "z")], schema.PROBE_LOG)
    assert tuple(recorded.probe(log).first()) == ("c", 2, 3, 2, "zero_new_products")


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "b", c\nd', ["x", "y"])], "i int, t string, l array<string>")
    sinks.write_csv(frame, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, str(tmp_path / "csv"), schema.ddl("i INT, t STRING, l STRING")).first()
    assert tuple(back) == (1, 'a "b", c\nd', "x,y")


def test_stream_appends_once(spark, tmp_path):
    raw = spark.createDataFrame([(1, "https://ex.com/products/a", "https://ex.com/products/a", None, False, 0, 200, 0, "text/html", None, 5, HTML)], schema.RAW_PAGE)
    raw.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        live.append_issues(live.raw_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(out).count() == rules.page_issues(extract.pages(raw)).count()


def test_entry_and_catalogue(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
