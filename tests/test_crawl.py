"""Addresses, probes and the crawl against plain Python."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from crawlsight import schema
from crawlsight.functions import url as u
from crawlsight.operators import extract, site
from crawlsight.plans import audit, crawl
from crawlsight.sources import probes

HOST = "https://ex.com"
BITS = [
    "https://", "http:", "HTTP://", "//", "/", "\\", "..", ".", "%2e", "%2E.", "a", "B-", "?", "#", "x=1", "&", "é", "漢", " ", "\t", "\n", "@", "user:pw@", ":80", ":443", ":8080", ":099999", ":", "ex.com", "Ex.COM", "bücher.de", "straße.de", "παράδειγμα.gr", "пример.рф",
    "日本語.jp", "mañana.com", "[::1]", "[zz]", "mailto:", "ftp://", "javascript:", "'", '"', "|", "{", "}", "`", "^", "~", "-", "_", "😀", "%zz", "%20", "data:,", "tel:+1", "+", "é.com", "\x00", "\x7f", "xn--a", "ü-ü.x",
]
BASES = [None, HOST, f"{HOST}/a/b?q=1#h", "http://ex.com:8080/x/", "mailto:a@b", "nope", "https://user@bücher.de/ä/b", "ftp://f.org/d/e", "foo://h/p/q"]


@pytest.fixture(scope="module")
def addresses(spark):
    rng = random.Random(11)
    rows = [(("https://" + rng.choice(["ex.com", "Bücher.de", "a.b:81", "пример.рф"]) + "/" if rng.random() < 0.4 else "") + "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))), rng.choice(BASES)) for _ in range(4000)]
    rows += [(None, None), ("", None), ("", f"{HOST}/a#b"), (f"{HOST}/a-", None), ("-x", f"{HOST}/"), (f"{HOST}/.?-", None), (f"{HOST}/a\n", None), (f"{HOST}/a/b/?x=1", None), (f"{HOST}/a/../b", None)]
    return spark.createDataFrame(rows, "u string, b string").repartition(4)


def test_native_parts_are_those_of_python(addresses):
    for r in addresses.select("u", "b", u.parts("u", "b", idn=True).alias("p")).collect():
        assert tuple(r["p"]) == u.take_apart(r["u"], r["b"]), (r["u"], r["b"])


def test_no_address_reaches_python(addresses):
    plan = addresses.select(u.parts("u", "b", idn=True), u.form("u", "graph", base="b"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("mode", ["page", "compare", "graph", "page_query"])
def test_addresses_in_their_form_are_seen_as_such(addresses, mode):
    assert addresses.filter(~u.form("u", mode, F.col("u"), "b").eqNullSafe(u.normalized(u.parts("u", "b"), mode, F.col("u")))).count() == 0


def test_long_addresses_neither_stop_the_machine_nor_take_long(spark):
    urls = [HOST + "/ab" * 100_000, "/x" * 100_000, f"{HOST}/é" + "/ab" * 100_000, f"{HOST}/" + "a%20" * 100_000 + "?" + "b=1&" * 100_000, f"{HOST}/../x" + "/ab" * 3000, f"{HOST}/" + "a" * 1_000_000]
    began = time.time()
    for r in spark.createDataFrame([(x,) for x in urls], "u string").select("u", u.parts("u", F.lit(HOST)).alias("p")).collect():
        assert tuple(r["p"]) == u.take_apart(r["u"], HOST)
    assert time.time() - began < 60


def test_a_page_of_many_links_is_read_in_seconds(spark):
    body = "".join(f'<a href="/p/{i % 15_000}">x</a>' for i in range(20_000))
    raw = spark.createDataFrame([(1, HOST, HOST, None, False, 0, 200, 0, "text/html", None, 1, f"<html>{body}")], schema.RAW_PAGE)
    began = time.time()
    links = extract.pages(raw).first()["links"]
    assert len(links) == 15_000 and links[0]["href"] == f"{HOST}/p/0" and time.time() - began < 60


def test_competing_pages_of_a_run(spark):
    rows = [(i, f"{HOST}{p}", f"{HOST}{p}", None, False, 0, 200, 0, "text/html", None, 1, f"<html><head><title>Blue cotton shirt for summer days</title></head><body><h1>{p}</h1>text {p}</body></html>") for i, p in enumerate(("/products/a", "/products/b", "/pages/c"))]
    pages = audit.page_table(spark.createDataFrame(rows, schema.RAW_PAGE))
    groups, members = site.cannibalization_tables(pages)
    (group,) = groups.filter("code = 'content_cannibalization_duplicate_title'").collect()
    assert group["size"] == 3 and group["group_id"].startswith("CAN-000")
    assert {r["url"] for r in members.filter(F.col("group_id") == group["group_id"]).collect()} == {f"{HOST}{p}" for p in ("/products/a", "/products/b", "/pages/c")}
    found = audit.tables(pages)["issues"].filter("code = 'content_cannibalization_duplicate_title'").collect()
    assert [r["url"] for r in found] == [group["primary_url"]]


# Probes


def plain_probe(log, collection):
    """The loop itself: stop reason, pages asked for, requests, and (page, listed, new) of the pages read."""
    seen, tier, requests, read = set(), "json", 0, []
    for page in range(1, probes.MAX_PAGES + 1):
        requests += 1
        found = log.get((collection, page, tier))
        if page == 1 and found is not None and found[0] == 404 and not found[2]:
            tier, requests = "html", requests + 1
            found = log.get((collection, page, tier))
            if found is not None and not found[2] and (found[0] == 404 or found[0] >= 500 or not found[1].strip()):
                return "both_tiers_failed", page, requests, read
        if found is None or found[2]:
            return "parse_or_fetch_error", page, requests, read
        status, body, _ = found
        if status == 404 or status >= 500:
            return "failed_status", page, requests, read
        if not body.strip():
            return "empty_response", page, requests, read
        if tier == "json":
            try:
                parsed = json.loads(body)
            except ValueError:
                return "parse_or_fetch_error", page, requests, read
            items = parsed.get("products") if isinstance(parsed, dict) else None
            handles = [x.get("handle") for x in items] if isinstance(items, list) else []
            listed = len(handles)
        else:
            handles = list(dict.fromkeys(p[4].split("/products/")[1] for p in (u.take_apart(a["rawHref"], collection) for a in extract.parse(body)["anchors"]) if p[1] == HOST and "/products/" in p[4]))
            listed = len(handles)
        new = {h.strip() for h in handles if isinstance(h, str) and h.strip() and not h.strip().endswith(".json")} - seen
        seen |= new
        read.append((page, listed, len(new)))
        if not new:
            return "zero_new_products", page, requests, read
    return "max_probe_pages", probes.MAX_PAGES, requests, read


def test_probes_against_the_loop(spark):
    rng, log = random.Random(4), {}
    for c in range(90):
        kind, url = c % 9, f"{HOST}/collections/c{c}"
        last = 22 if kind == 0 else rng.randint(1, 9)
        for page in range(1, last + 1):
            handles = [rng.choice(["", " ", "x.json", f"p{rng.randint(0, 9)}"]) for _ in range(3)] + ([f" n{page}"] if kind < 8 else [])
            body = json.dumps({"products": [{"handle": h} for h in handles] + [{"handle": 5}, {"id": 1}]})
            page_html = "".join(f'<a href="{rng.choice(["/products/", "/collections/z/products/", "https://o.example/products/"])}{h.strip()}?a#b">' for h in handles if h.strip())
            status = rng.choice([200, 200, 200, 301, 403, 404, 500]) if kind == 3 else 404 if kind in (1, 2) and page == 1 else 200
            broken = rng.choice(["", " \n", '{"products":', "[]", '"x"', '{"products":{}}']) if kind == 4 and page == last else body
            log[url, page, "json"] = (status, broken, "ETIMEDOUT" if kind == 5 and page == last else None)
            if kind in (1, 2):
                log[url, page, "html"] = (rng.choice([200, 503, 404]) if kind == 2 else 200, rng.choice(["", page_html]) if kind == 2 else page_html, None)
        if kind == 6:
            log.pop((url, rng.randint(1, last), "json"))
    log = {k: v for k, v in log.items()}
    frame = spark.createDataFrame([(*k, *v) for k, v in log.items()], "collection_url string, page_no int, tier string, status int, body string, error string")
    got = probes.probe(frame, HOST)
    pages = {}
    for r in got.pages.collect():
        pages.setdefault(r["collection_url"], []).append((r["page"], r["products_found"], r["new"]))
    reasons = set()
    for r in got.collections.collect():
        reason, stop, requests, read = plain_probe(log, r["collection_url"])
        reasons.add(reason)
        assert (r["stop_reason"], r["probe_pages_fetched"], r["requests"]) == (reason, stop, requests), r
        assert sorted(pages.get(r["collection_url"], [])) == read and r["products_found"] == sum(n for *_, n in read)
        assert (r["failed"], r["exhausted"]) == (int(reason in probes.FAILURES), int(reason == "zero_new_products"))
    assert reasons == {*probes.FAILURES, "zero_new_products", "max_probe_pages"}
    assert {tuple(r) for r in probes.memberships(got.products).limit(3).collect()} and got.products.groupBy("collection_url", "product_url").count().filter("count > 1").isEmpty()


# The crawl


def plain_crawl(pages, seeds, most, depth, found):
    """One queue, first in, first out."""
    seen, queue, out = {}, [], []

    def add(url, at, source, via):
        if len(seen) >= most or at > depth or url in seen or "/cart" in url:
            return
        seen[url] = None
        queue.append((url, at, source, via))

    for url, source in seeds:
        add(url, 0, source, None)
    while queue:
        url, at, source, via = queue.pop(0)
        page = pages.get(url)
        out.append((url, at, source, via, len(out) + 1, "no_record" if page is None else "page"))
        if page is None:
            continue
        if at < depth:
            for link in dict.fromkeys(page):
                add(HOST + link, at + 1, None, url)
        for product in found.get(url, ()):
            add(product, min(at + 1, depth), "pagination_probe", url)
    return out


@pytest.mark.parametrize("most,depth", [(25, 6), (500, 2), (500, 6), (1, 1)])
def test_crawl_against_a_queue(spark, most, depth):
    rng = random.Random(most + depth)
    paths = [f"/pages/p{i}" for i in range(40)] + [f"/collections/c{i}" for i in range(5)] + ["/products/s1"]
    pages = {HOST + p: [rng.choice([*paths, "/missing", "/cart"]) for _ in range(rng.randint(0, 6))] for p in paths}
    log, found = [], {}
    for i in range(5):
        handles = [f"s{rng.randint(1, 6)}" for _ in range(4)]
        log += [(f"{HOST}/collections/c{i}", 1, "json", 200, json.dumps({"products": [{"handle": h} for h in handles]}), None), (f"{HOST}/collections/c{i}", 2, "json", 200, '{"products":[]}', None)]
        found[f"{HOST}/collections/c{i}"] = [f"{HOST}/products/{h}" for h in dict.fromkeys(handles)]
    raw = [(i, p, p, None, False, 0, 200, 0, "text/html", None, 1, "<html>" + "".join(f'<a href="{x}">x</a>' for x in links)) for i, (p, links) in enumerate(pages.items())]
    raw.append((99, *raw[0][1:-1], "<html>a second record of the same address"))
    seeds = crawl.seed_rows(spark.createDataFrame([(HOST + paths[0], 0), (HOST + paths[0], 1), (HOST + paths[41], 2)], "url string, n long"), unlisted=spark.createDataFrame([(HOST + "/products/s2", 0)], "url string, n long"))
    done = crawl.crawl(spark.createDataFrame(raw, schema.RAW_PAGE), seeds, HOST, crawl.Limits(most, depth), spark.createDataFrame(log, "collection_url string, page_no int, tier string, status int, body string, error string"))
    want = plain_crawl(pages, [(HOST + paths[0], None), (HOST + paths[0], None), (HOST + paths[41], None), (HOST + "/products/s2", "sitemap_unlisted")], most, depth, found)
    assert [tuple(r) for r in done.queue.orderBy("place").collect()] == want
    assert {(r["url"], r["depth"], r["discoverySource"]) for r in done.pages.collect()} == {(x[0], x[1], x[2]) for x in want if x[5] == "page"}
    count = crawl.counts(done).first()
    assert (count["queued"], count["pages"], count["probe_discovered_products"]) == (len(want), sum(x[5] == "page" for x in want), sum(x[2] == "pagination_probe" for x in want))


def test_a_crawl_without_seeds_or_pages(spark):
    seeds = spark.createDataFrame([], "url string, source string, n long")
    done = crawl.crawl(spark.createDataFrame([], schema.RAW_PAGE), seeds, HOST)
    assert done.queue.isEmpty() and done.pages.isEmpty()
