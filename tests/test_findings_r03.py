"""The findings of round 3: what each one got wrong, on small tables."""

from __future__ import annotations

import glob
import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from crawlsight.functions import url as u
from crawlsight.operators import extract, graph, registry, reports, rules, site
from crawlsight.plans import adapters, catalogue, recordings
from crawlsight.sources import probes


def against_sql(spark, folder: str, name: str) -> None:
    """A query's rows are those of its SQL."""
    with duckdb.connect() as con:
        for path in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
        want = Counter(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    got = __spark_entry__.queries()[name](spark, folder)
    assert Counter(map(tuple, got.collect())) == want and want


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory) -> str:
    """Pages whose titles end in the midst of a reference."""
    folder = str(tmp_path_factory.mktemp("pages"))
    rows = []
    for i, cut in enumerate(("a &amp;&amp", "a &amp;&amp", "b &lt;&am", "c &quot", "d &amp;", "d &amp;", "e & f", "g &notin h")):
        rows.append((i, f"http://x.example/{i}", f"<html><title>{cut}</title><body><h1>{cut}</h1><p>words &amp; &lt;more&gt;</p><a href=\"/y?a=1&copy=2\">z</a></body></html>"))
    with duckdb.connect() as con:
        con.execute("CREATE TABLE p (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
        con.execute(f"COPY p TO '{folder}/pages.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["page_headings_links", "page_titles_duplicates", "page_visible_text"])
def test_references_without_semicolon(spark, cut_pages, name):
    against_sql(spark, cut_pages, name)


@pytest.mark.parametrize("name", ["page_headings_links", "page_titles_duplicates", "page_visible_text"])
def test_references_and_spaces_that_the_sql_does_not_know(spark, tmp_path, name):
    odd = "it&#x27;s &nbsp; &eacute; &AMP; &amp;amp; &lt;c&gt;\t d"
    with duckdb.connect() as con:
        con.execute("CREATE TABLE p (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO p VALUES (?, ?, ?)", [(i, f"http://x.example/{i}", f"<html><title>{odd}</title><body><h1>{odd}</h1><p>{odd} a\u00a0\u3000b\u2003 c &am<b>p;</b></p>&copy; &middot;\u00a0 </body></html>") for i in range(3)])
        con.execute(f"COPY p TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    against_sql(spark, str(tmp_path), name)


def test_references_as_browsers_read_them():
    assert extract.parse("<title>a &amp b</title>")["meta"]["title"] == "a & b"
    assert extract.parse("<title>a &amp b &copy; &copy2; &#38; &x;</title>", cut_references=False)["meta"]["title"] == "a &amp b \u00a9 &copy2; & &x;"


SMALL = "/root/testdata/sf0.001"


def test_a_small_file_of_parts_is_dealt_out(spark):
    """The parts of a store are one file; its pages are made in as many tasks as run at once."""
    assert adapters.spread(spark, SMALL, adapters.STORE).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["unreachable_products", "link_graph_summary"])
def test_ranks_are_left_out_where_nobody_reads_them(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "pagerank", None)
    against_sql(spark, SMALL, name)


def test_facts_of_images_are_found_once(spark):
    found = registry.compile_family(adapters.store(spark, SMALL, links=False, images=True), rules.images())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("/products/|/cdn/shop/files/|/cdn/shop/products/") == 1


def test_rounds_of_the_rank_carry_numbers(spark, monkeypatch):
    """Whatever is saved in the rounds has no addresses."""
    kept = []
    real = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: kept.append((name, df.columns)) or real(df, name))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = {r["id"]: r["score"] for r in graph.pagerank(edges, nodes).collect()}
    score = dict.fromkeys("abcd", 0.25)
    for _ in range(graph.ROUNDS):
        score = {k: 0.15 + 0.85 * sum(score[s] for s, d in (("a", "b"), ("b", "a"), ("c", "a")) if d == k) for k in score}
    low, high = min(score.values()), max(score.values())
    assert got == {k: round((v - low) / (high - low), 6) for k, v in score.items()}
    assert all(not {"src", "dst"} & set(columns) for _, columns in kept) and sum("id" in columns for _, columns in kept) == 1


def test_samples_of_a_plan_are_cut_before_any_shuffle(spark):
    rows = [("high", "c", "x", "t", "m", u) for u in ("b", "a", "a", "f", "e", "d", "c", "b")] + [("low", "c", "y", "t", "m", "z")] * 3
    plan = reports.action_plan(spark.createDataFrame(rows, "severity string, category string, code string, recommendation string, message string, url string"))
    assert [(r["code"], r["affectedUrls"], r["sampleUrls"]) for r in plan.orderBy("priority").collect()] == [("x", 8, "a|b|c|d|e"), ("y", 3, "z")]
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert "Partial" in text and "keys=[severity#" in text and not any("url#" in line.split("functions=")[0] for line in text.splitlines() if "Aggregate(keys=" in line)


def test_filters_of_pages_do_not_go_back_to_one_file(spark):
    """A filter on what is made of a part stays behind the dealing out."""
    pages = adapters.store(spark, SMALL, links=False).filter("indexability.indexable")
    assert "Repartition" not in pages._jdf.queryExecution().optimizedPlan().toString()
    assert pages.select("finalUrl").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_links_of_the_store_become_distinct_as_numbers(spark):
    found = adapters.links_of(spark, SMALL)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, adapters.flat(spark, SMALL, adapters.LINKS).collect()))
    assert [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "l_suppkey" not in line] == []


def test_inbound_links_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(site, "LINKS_A_TASK", 1)
    address = lambda x: f"https://x.example/{x}"
    linked = {"a": "bbcd", "b": "acz", "c": "cb", "d": ""}
    rows = [(address(k), address(k), "collection" if k == "a" else "page", 200, i, [(address(x), True) for x in v]) for i, (k, v) in enumerate(linked.items())] + [(address("a"), address("a"), "page", 200, 9, [(address("b"), True)])]
    pages = spark.createDataFrame(rows, "compare_key string, finalUrl string, pageType string, status int, crawl_seq int, links array<struct<href string, internal boolean>>")
    found = site.inbound(pages)
    assert {tuple(r) for r in found.select("compare_key", "inbound", "from_collection").collect()} == {(address("a"), 1, False), (address("b"), 2, True), (address("c"), 2, True), (address("d"), 1, True)}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_the_graph_keeps_no_more_of_a_page_than_it_reads(spark, monkeypatch):
    kept = {}
    real = catalogue.saved
    monkeypatch.setattr(catalogue, "saved", lambda df, name: kept.setdefault(name, df.schema) and real(df, name))
    assert catalogue.network_summary(spark, SMALL).count() == 1
    assert not {"meta", "speed", "textSample", "indexability", "images"} & set(kept["store"].names) and kept["store"]["links"].dataType.elementType.names == ["href", "internal"]


ODD_PAGES = [
    '<a href="/products/a">a</a><A\n class="b" HREF="/collections/z/products/b?v=1">b</A ><br/><a href="/products/a/">again</a>', '<a href="https://x.example/products/c">c</a><a href="https://o.example/products/d">d</a><a href="//x.example/products/e#f">e</a>',
    '<a href="/products/é f">f</a><a href="/products/../products/g">g</a><a href="products/h">h</a><a href="?x=/products/i">i</a><a href="/products//j/k">j</a><a href="/products/">none</a><a href="/products/products/l">l</a>',
    '<a href="/x" href="/products/m">m</a><a href="/products/n" href="/x">n</a><a data-href="/products/o" href="/products/p">p</a><a name="q">q</a><a href="mailto:a@b">r</a><abbr href="/products/s">s</abbr>',
    "<a href='/products/t'>t</a><a href=/products/u>u</a>", '<a href="/products/v?a=1&amp;b=2">v</a>', '<script>"<a href=\\"/products/w\\">"</script><a href="/products/x">x</a>', '<!-- <a href="/products/y">y</a> --><a href="/products/z">z</a>',
    '<title><a href="/products/a1">t</a></title>', '<a href="/products/a2">1 < 2</a>', '<a href="/products/a3', '<a title="a > b" href="/products/a4">a4</a>', "text", "", None, '<textarea><a href="/products/a5">x</a></textarea><a href="/products/a6">6</a>',
    "<a " + "".join(f'x{i}="y" ' for i in range(25)) + 'href="/products/a7">7</a>', '<p>a &lt; b &amp c</p><a rel="x"   href="/products/a8" >8</a>',
]


@pytest.mark.parametrize("root", ["https://x.example/collections/c", "https://x.example", "https://X.example/collections/c", "https://x.example:81/collections/c"])
def test_links_of_plain_markup_are_those_of_the_parser(spark, root):
    rows = spark.createDataFrame([(i, root, x) for i, x in enumerate([*ODD_PAGES, "".join(x for x in ODD_PAGES[:4])])], "page_no int, collection_url string, body string")
    want = {r["page_no"]: (r["_count"], r["_handles"]) for r in probes._html_pages(rows).collect()}
    plain = rows.filter(probes._has_plain_tags())
    got = {r["page_no"]: (r["_count"], r["_handles"]) for r in probes._plain_html_pages(plain).collect()}
    assert got == {i: want[i] for i in got} and (set(got) == {0, 1, 2, 3, 12, 13, 17, 18} if root[8] == "x" and ":81" not in root else not got)


def test_plain_pages_of_a_probe_need_no_python(spark, monkeypatch):
    """Only markup that isn't plain is parsed, each product is told by a short text, and addresses are in no group."""
    parsed, kept = [], {}
    real, save = probes._html_pages, probes.saved
    monkeypatch.setattr(probes, "_html_pages", lambda rows: parsed.append(rows.count()) or real(rows))
    monkeypatch.setattr(probes, "saved", lambda df, name: kept.setdefault(name, df) and save(df, name))
    against_sql(spark, SMALL, "probe_stop_reasons")
    assert parsed == [0] and kept["probe-products"].columns == ["_collection", "_product", "_at"]
    assert "SortAggregate" not in kept["probe-products"]._jdf.queryExecution().executedPlan().toString()
    log = recordings._probe_log(spark, SMALL)
    assert log.select("collection_url", "tier", "status")._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey") == 0


def test_products_are_told_as_by_their_addresses(spark):
    """Handles of every kind, also those that mean the same address or are skipped, against a whole read of each."""
    handles = ["a", " a", "a ", "\ta\u00a0", "./a", "b/../a", "b", "B", "a?x", "a#b", "é", "%C3%A9", "cart", "admin", "Cart-x", "x-cart", "Apps", "apps/x", "utm_a", "aUTM_b", "fbclid", "a.json", "a.b", "", " ", "//o.example/x", "variant=1", "../x", "..", "view", "a_", "x y", "a\u2003b"]
    roots = ["https://x.example/collections/c", "https://X.example/collections/d", "https://admin.example/collections/e", "https://x.example:81/collections/f", "http://filter.example/g", "ftp://x.example/h"]
    log = [(r, p, "json", 200, json.dumps({"products": [{"handle": h} for h in (handles if p == 1 else [*reversed(handles), f"n{p}"])]}), None) for r in roots for p in (1, 2)]
    got = {(r["collection_url"], r["product_url"]): (r["page_no"], r["place"], r["handle"]) for r in probes.probe(spark.createDataFrame(log, "collection_url string, page_no int, tier string, status int, body string, error string")).products.collect()}
    want = {}
    rows = spark.createDataFrame([(r, p, i, h.strip()) for r, p, *_, body, _ in log for i, h in enumerate(x["handle"] for x in json.loads(body)["products"])], "root string, page int, place int, handle string")
    base = u.parts("root")
    read = rows.filter("handle <> ''").withColumn("p", u.parts(F.concat(F.lit("/products/"), "handle"), base["href"])).filter(~u.should_skip(F.col("p"), base))
    stops = {r: 2 if any(x["page"] == 1 for x in read.filter(F.col("root") == r).collect()) else 1 for r in roots}
    for r in sorted(read.collect(), key=lambda r: (r["page"], r["place"])):
        if r["page"] <= stops[r["root"]]:
            want.setdefault((r["root"], r["p"]["href"]), (r["page"], r["place"], r["handle"]))
    assert got == want and len({k[0] for k in want}) >= 2


def test_no_skipped_pattern_reaches_into_a_plain_handle():
    assert all("/" not in x[1:-1] for x in u.SKIPPED_PATTERNS)
