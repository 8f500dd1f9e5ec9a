"""Site rules: joins and groups over the whole page table.

Pages carry ``finalUrl, url, pageType, status, discoverySource, crawl_seq`` and
the nested columns that a rule reads. Keys are normalised URLs, added by ``keyed``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import robots as rb
from ..functions import text as tx
from ..functions import url as u
from ..schema import ISSUE_COLUMNS
from .lineage import numbered, portions, saved
from .registry import issue
from .rules import not_in_html, reachable_via

#: Links, and pages that are compared, that one task takes.
LINKS_A_TASK, COMPARED_A_TASK = 150_000, 20_000
MINIMUM_INBOUND = {"product": 2, "collection": 3, "article": 2}
IN_SITEMAP = ("home", "product", "collection", "page", "blog", "article", "policy")


def keyed(pages: DataFrame) -> DataFrame:
    """Add ``compare_key`` and ``graph_key`` of the final URL and ``requested_key`` of the requested one; a URL that doesn't parse keys as itself."""
    def key(url: str, mode: str) -> Column:
        return u.form(url, mode, F.col(url)).alias(f"{mode}_key")

    return pages.select("*", u.parts("finalUrl").alias("_p"), key("finalUrl", "compare"), key("finalUrl", "graph"), key("url", "graph").alias("requested_key"))


def _issues(rows: DataFrame, *kinds: tuple) -> DataFrame:
    """Each kind is (condition or None, issue struct, extra columns by name); one pass with one explode."""
    more = list(dict.fromkeys(n for k in kinds if len(k) > 2 for n in k[2]))
    made = []
    for condition, found, *extra in kinds:
        own = extra[0] if extra else {}
        full = F.struct(found.alias("i"), *[own[n].alias(n) if n in own else F.lit(None).cast("string").alias(n) for n in more])
        made.append(full if condition is None else F.when(condition, full))
    each = F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")
    return rows.select(F.col("finalUrl").alias("url"), "pageType", each).select("url", "pageType", "x.i.*", *[f"x.{n}" for n in more])


def _columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*ISSUE_COLUMNS, *more)


def duplicates(pages: DataFrame) -> DataFrame:
    """An issue for each page whose title, description or text occurs on another page; empty values don't count.

    Counted before they are joined back, so a value on a third of all pages is one row of the join's other side.
    """
    values = duplicate_values(pages)
    often = values.groupBy("code", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return duplicate_issues(values.join(often, ["code", "value"]))


#: What pages are compared by, and the severity and category of the issue.
DUPLICATES = (("duplicate_title", "medium", "metadata", "meta.title"), ("duplicate_meta_description", "medium", "metadata", "meta.description"), ("duplicate_content", "high", "content", "textHash"))


def duplicate_values(pages: DataFrame, *more: str) -> DataFrame:
    """``(finalUrl, pageType, code, value)``: what each page may share with others."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), tx.blank(F.col(v)).alias("value")) for c, _, _, v in DUPLICATES])).alias("v")
    return pages.select("finalUrl", "pageType", *more, each).select("finalUrl", "pageType", *more, "v.*").filter("value <> ''")


def duplicate_issues(rows: DataFrame) -> DataFrame:
    """Issues of rows as ``duplicate_values`` gives them, with ``n``, how many pages share the value."""
    return _columns(_issues(rows, *[(F.col("code") == c, issue(c, s, k, F.col("value"), F.col("n"))) for c, s, k, _ in DUPLICATES]))


def canonical_origin(pages: DataFrame) -> DataFrame:
    c, p = u.parts(F.col("meta.canonical"), F.col("finalUrl"), idn=True), u.parts("finalUrl")
    rows = pages.withColumn("_c", c).withColumn("_p", p).filter(tx.blank(F.col("meta.canonical")) != "")
    return _columns(_issues(rows, (~F.col("_c.valid") | (F.col("_c.origin") != F.col("_p.origin")), issue("canonical_different_origin", "medium", "technical", F.col("meta.canonical")))))


def redirects(pages: DataFrame) -> DataFrame:
    chain = F.col("redirectCount") > 1
    rows = pages.filter("redirected").withColumn("_evidence", F.concat_ws(" -> ", "url", "finalUrl"))
    made = _issues(
        rows.withColumn("finalUrl", F.col("url")),
        (chain, issue("redirect_chain", "medium", "redirects", F.col("_evidence"), F.col("redirectCount"), length=260)),
        (~chain, issue("url_redirects", "recommended", "redirects", F.col("_evidence"), F.col("redirectCount"), length=260)),
    )
    return _columns(made)


def link_rows(pages: DataFrame, key: str = "compare") -> DataFrame:
    """``(finalUrl, pageType, src, href, dst)`` of internal links; ``dst`` is the link's URL in the form that ``key`` names."""
    own = {"compare": "compare_key", "graph": "graph_key"}[key]
    # Formed before they are exploded: what is filtered on ``dst`` later would else form it again for each condition.
    formed = F.transform(F.filter("links", lambda x: x["internal"]), lambda x: F.struct(x["href"].alias("href"), u.form(x["href"], key, x["href"]).alias("dst")))
    return pages.select("finalUrl", "pageType", "status", "crawl_seq", F.col(own).alias("src"), F.inline(formed))


def links_to_redirects(pages: DataFrame) -> DataFrame:
    moved = pages.filter("redirected").groupBy(F.col("requested_key").alias("dst")).agg(F.max_by("finalUrl", "crawl_seq").alias("_to"))
    rows = link_rows(pages, "graph").join(moved, "dst").groupBy("finalUrl", "href").agg(F.min("pageType").alias("pageType"), F.min("_to").alias("_to"))
    return _columns(_issues(rows, (None, issue("internal_link_to_redirect", "recommended", "redirects", F.concat_ws(" -> ", "href", "_to"), length=260))))


def hreflang_dead(pages: DataFrame) -> DataFrame:
    rows = pages.select("finalUrl", "pageType", F.explode("meta.alternates").alias("a")).filter("a.href <> ''")
    rows = rows.withColumn("compare_key", u.form(F.col("a.href"), "compare", base=F.col("finalUrl"), idn=True))
    dead = pages.groupBy("compare_key").agg(F.max_by("status", "crawl_seq").alias("_status")).filter("_status >= 400")
    return _columns(_issues(rows.join(dead, "compare_key"), (None, issue("hreflang_dead_url", "high", "metadata", F.concat_ws(" ", "a.hreflang", "a.href"), F.col("_status"), length=240))))


def inbound(pages: DataFrame) -> DataFrame:
    """Distinct pages that link to each page, and whether a collection is among them; self links don't count."""
    known = pages.select("compare_key").distinct()
    targets = F.array_distinct(F.transform(F.filter("links", lambda x: x["internal"]), lambda x: u.form(x["href"], "compare", x["href"])))
    own = saved(pages.select(F.col("compare_key").alias("src"), (F.col("pageType") == "collection").alias("_c"), targets.alias("targets")), "inbound-links")
    # Links become distinct where their sources meet, in as many tasks as they call for, and are counted there before they go to their targets.
    n = portions(pages.sparkSession, own.agg(F.sum(F.size("targets"))).first()[0] or 0, LINKS_A_TASK)
    rows = own.repartition(n, "src").select("src", "_c", F.explode("targets").alias("dst")).filter("src <> dst")
    edges = rows.groupBy("src", "dst").agg(F.max("_c").alias("from_collection"))
    counted = edges.groupBy(F.col("dst").alias("compare_key")).agg(F.count(F.lit(1)).alias("inbound"), F.max("from_collection").alias("from_collection"))
    return counted.join(known, "compare_key", "left_semi")


def internal_links(pages: DataFrame) -> DataFrame:
    """Pages without inbound links, or with too few; a page has at most one of the first kind and none of the others with it."""
    c, n, kind = "internal_links", F.col("inbound"), F.col("pageType")
    rows = pages.filter("pageType <> 'home' and status < 400").join(inbound(pages), "compare_key", "left").fillna({"inbound": 0})
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in MINIMUM_INBOUND.items() for v in kv]), kind), F.lit(1))
    hidden = not_in_html(F.col("discoverySource"))
    none = F.lit(None).cast("string")
    made = _issues(
        rows,
        ((n == 0) & hidden, issue("no_html_inbound_link", "medium", c, F.col("discoverySource"), n, length=240), {"reachable_via": reachable_via(F.col("discoverySource"))}),
        ((n == 0) & ~hidden, issue("orphan_page", F.when(kind.isin("product", "collection"), "high").otherwise("medium"), c, metric=n), {"reachable_via": none}),
        ((n > 0) & (n < least), issue("low_internal_links", "recommended", c, metric=n), {"reachable_via": none}),
        ((n > 0) & (kind == "product") & ~F.coalesce("from_collection", F.lit(False)), issue("product_not_linked_from_collection", "medium", c, metric=n), {"reachable_via": none}),
    )
    return _columns(made, "reachable_via")


def broken_collections(pages: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """Collections that answered 404, with how many pages link to them and, sorted, the first ``most``."""
    rows = pages.filter("status = 404").filter(F.lower(F.col("_p.path")).startswith("/collections/"))
    found = rows.select("graph_key").distinct().join(edges.withColumnRenamed("dst", "graph_key"), "graph_key").groupBy("graph_key").agg(F.count(F.lit(1)).alias("n"))
    ranked = edges.withColumnRenamed("dst", "graph_key").join(rows.select("graph_key").distinct(), "graph_key", "left_semi")
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("graph_key").orderBy("src"))).filter(F.col("_r") <= most)
    listed = ranked.groupBy("graph_key").agg(F.array_sort(F.collect_list("src")).alias("sources"))
    vendors = F.lower(F.regexp_replace(F.col("_p.path"), "/$", "")) == "/collections/vendors"
    advice = F.when(vendors, "Link vendors by a collection of their own; mend the links.").otherwise("Mend, redirect or drop the links.")
    rows = rows.join(found, "graph_key", "left").join(listed, "graph_key", "left").fillna({"n": 0})
    base = issue("broken_collection_link", "high", "internal_links", F.concat(F.lit("inbound="), F.col("n").cast("string")), F.col("n"))
    made = _issues(rows, (None, base, {"inbound_sources": F.array_join(F.coalesce("sources", F.array().cast("array<string>")), "|"), "_advice": advice}))
    return _columns(made.withColumn("recommendation", F.col("_advice")), "inbound_sources")


def orphaned_collections(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Answering collections of two segments and no query that only utility pages or they themselves link to; one issue for each URL."""
    rows = pages.filter("status = 200").filter(u.is_primary_url(F.col("_p.path")) & F.col("_p.path").startswith("/collections/") & (F.col("_p.query") == "") & ~F.col("_p.path").endswith("/all"))
    useful = edges.withColumn("_s", F.regexp_replace("src", r"^[a-z]+://[^/]+", "")).filter("src <> dst").filter(~u.is_utility(F.col("_s"))).select(F.col("dst").alias("graph_key")).distinct()
    rows = rows.join(useful, "graph_key", "left_anti").groupBy("graph_key").agg(F.min_by("finalUrl", "crawl_seq").alias("finalUrl"), F.min("pageType").alias("pageType"))
    return _columns(_issues(rows, (None, issue("orphaned_collection", "critical", "internal_links"))))


def sitemap(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages against the sitemap's URLs (``url``); without any, there is nothing to compare. Pages carry ``indexability``."""
    listed = urls.select(u.form("url", "compare", F.col("url"), idn=True).alias("compare_key")).distinct()
    if listed.isEmpty():
        return pages.sparkSession.createDataFrame([], "url string, pageType string, severity string, category string, code string, message string, recommendation string, evidence string, metric bigint")
    c, state = "indexability", F.col("indexability")
    target = state["canonicalTarget"]
    # Kept as a narrow table: the state is a long expression that the optimizer would otherwise copy into every condition.
    pages = saved(pages.select("finalUrl", "pageType", "status", "compare_key", "indexability"), "sitemap-pages")
    rows = pages.join(listed.withColumn("_in", F.lit(True)), "compare_key", "left").withColumn("_target", F.when(target == "", F.col("compare_key")).otherwise(target))
    rows = rows.join(listed.select(F.col("compare_key").alias("_target"), F.lit(True).alias("_target_in")), "_target", "left")
    inside, wanted = F.coalesce("_in", F.lit(False)), state["indexable"] & F.col("pageType").isin(*IN_SITEMAP)
    made = _issues(
        rows,
        (inside & (F.col("status") >= 400), issue("sitemap_url_http_error", "critical", c, F.col("status").cast("string"), F.col("status"))),
        (inside & ~state["indexable"], issue("sitemap_url_not_indexable", "high", c, state["status"])),
        (inside & (target != "") & ~state["selfReferencing"], issue("sitemap_url_canonicalized", "high", c, target)),
        (~inside & wanted, issue("indexable_page_missing_from_sitemap", "medium", c)),
        (state["indexable"] & F.col("pageType").isin(*IN_SITEMAP) & (target != "") & ~F.coalesce("_target_in", F.lit(False)), issue("canonical_url_missing_from_sitemap", "recommended", c, target)),
    )
    return _columns(made).dropDuplicates(["url", "code", "evidence"])


def issues(pages: DataFrame, edges: DataFrame, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """All rules that need the whole page table, in one table with the columns that some of them add; ``sitemap_urls`` where a sitemap was read."""
    found = [
        duplicates(pages), cannibalization_issues(cannibalization_groups(pages)), canonical_origin(pages), redirects(pages), links_to_redirects(pages), hreflang_dead(pages),
        broken_collections(pages, edges), internal_links(pages), orphaned_collections(pages, edges),
    ]
    if sitemap_urls is not None:
        found.append(sitemap(pages, sitemap_urls))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def with_indexability(pages: DataFrame, as_of: str = "2026-01-01 00:00:00") -> DataFrame:
    return pages.withColumn("indexability", rb.summary(F.col("status"), F.col("meta.robots"), F.col("xRobotsTag"), F.col("meta.canonical"), F.col("finalUrl"), F.lit(as_of).cast("timestamp")))


# --- pages that compete for one intent -------------------------------------------------------------

TYPE_WEIGHT = {"collection": 60, "product": 50, "page": 35, "article": 30, "blog": 20, "home": 10}
#: Shortest value that counts as a signal, by signal.
EXACT = (("duplicate_content", 10), ("duplicate_title", 12), ("duplicate_meta_description", 35))
PRIORITY = (
    "content_cannibalization_duplicate_content", "content_cannibalization_serp_duplicate", "content_cannibalization_collection_product_overlap",
    "content_cannibalization_duplicate_title", "content_cannibalization_duplicate_description", "content_cannibalization_variant_serp_risk",
    "content_cannibalization_keyword_overlap", "content_cannibalization_variant_cluster",
)
GROUP_SEVERITY = {
    "content_cannibalization_variant_cluster": "info", "content_cannibalization_duplicate_content": "high", "content_cannibalization_serp_duplicate": "high",
    "content_cannibalization_keyword_overlap": "recommended",
}
MOST_INTENT = 50


def page_score(inbound_count: Column) -> Column:
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in TYPE_WEIGHT.items() for v in kv]), F.col("pageType")), F.lit(0))
    return weight + inbound_count * 3 + F.least(F.col("wordCount") / 100, F.lit(20.0)) + F.when(tx.blank(F.col("meta.description")) != "", 2).otherwise(0) + F.when(F.size("headings.h1") == 1, 2).otherwise(0)


def cannibalization_members(pages: DataFrame) -> DataFrame:
    """``(signal, value, member columns)``: indexable pages in groups of two and more by content, title, description or intent."""
    h1 = tx.blank(F.get(F.col("headings.h1"), 0))
    handle = u.handle_text(F.col("_p.path"))
    own = pages.filter("indexability.indexable").select(
        "finalUrl", "pageType", "crawl_seq", "compare_key", "wordCount", F.struct(F.col("meta.description").alias("description")).alias("meta"), F.struct(F.col("headings.h1").alias("h1")).alias("headings"), tx.intent_key(F.col("meta.title"), h1, handle).alias("intent"),
        tx.variant_attributes(F.col("meta.title"), h1, handle).alias("variant"), tx.exact_key(F.col("meta.title")).alias("title"), tx.exact_key(F.col("meta.description")).alias("description"), tx.blank(F.col("textHash")).alias("hash"),
    )
    # Pages are written before they meet the counts, so that their number tells how many tasks that takes.
    own = saved(own, "intent-pages")
    own = own.repartition(portions(pages.sparkSession, own.count(), COMPARED_A_TASK), "compare_key").join(inbound(pages), "compare_key", "left").fillna({"inbound": 0})
    own = saved(own.withColumn("score", page_score(F.col("inbound"))).drop("compare_key", "wordCount", "meta", "headings", "from_collection"), "intent-scores")
    value = {"duplicate_content": F.col("hash"), "duplicate_title": F.col("title"), "duplicate_meta_description": F.col("description")}
    kinds = [F.when(F.length(value[s]) >= n, F.struct(F.lit(s).alias("signal"), value[s].alias("value"))) for s, n in EXACT]
    kinds.append(F.when(F.col("intent") != "", F.struct(F.lit("shared_keyword_intent").alias("signal"), F.col("intent").alias("value"))))
    rows = own.select("*", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("k")).select("*", "k.signal", "k.value").drop("k")
    sizes = rows.groupBy("signal", "value").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & ((F.col("signal") != "shared_keyword_intent") | (F.col("n") <= MOST_INTENT)))
    return rows.join(sizes, ["signal", "value"])


def _grouped(pages: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """Members with the number, the sum and the xor of their group's hashes, by which groups with the same pages are told; and what is known of each group."""
    rows = saved(cannibalization_members(pages).withColumn("h", F.xxhash64("finalUrl", "crawl_seq")), "competing")
    by_value = rows.groupBy("signal", "value").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x"), F.min("finalUrl").alias("first_url"),
        F.array_sort(F.collect_set("pageType")).alias("page_types"), F.max_by(F.struct("finalUrl", "inbound"), F.struct("score", -F.col("crawl_seq"))).alias("primary"),
        F.min_by("intent", F.struct(F.col("intent") == "", "crawl_seq")).alias("intent_key"),
        F.avg(F.when(F.size("variant.attributes") > 0, 1.0).otherwise(0.0)).alias("variant_share"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("variant.signals")))).alias("variant_signals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("variant.attributes")))).alias("variant_attributes"),
    )
    by_value = saved(by_value, "competing-values")
    # A rank with a bound: every task cuts its rows to the first ones of a group before the shuffle.
    place = F.row_number().over(Window.partitionBy("signal", "value").orderBy("finalUrl", "crawl_seq"))
    first = rows.select("signal", "value", "finalUrl", "crawl_seq").withColumn("_r", place).filter(F.col("_r") <= sample + 1)
    listed = first.groupBy("signal", "value").agg(F.array_sort(F.collect_set("finalUrl")).alias("listed"))
    merged = by_value.join(listed, ["signal", "value"]).groupBy("size", "s", "x").agg(
        F.array_sort(F.collect_set("signal")).alias("signals"), *[F.min(c).alias(c) for c in ("first_url", "page_types", "primary", "intent_key", "listed", "variant_share", "variant_signals", "variant_attributes")],
        F.max(F.when(F.col("signal") == "duplicate_title", F.col("value"))).alias("shared_title"), F.max(F.when(F.col("signal") == "duplicate_meta_description", F.col("value"))).alias("shared_description"),
        F.max(F.when(F.col("signal") == "duplicate_content", F.col("value"))).alias("shared_hash"),
    )
    return rows.join(by_value.select("signal", "value", "size", "s", "x"), ["signal", "value"]), merged


def cannibalization_groups(pages: DataFrame, sample: int = 50) -> DataFrame:
    """One row for each set of competing pages, whatever signals it has; ``competing`` lists the ``sample`` smallest URLs besides the primary one."""
    return cannibalization_tables(pages, sample)[0]


def cannibalization_tables(pages: DataFrame, sample: int = 50) -> tuple[DataFrame, DataFrame]:
    """The groups, and ``(group_id, url)`` for all of their pages."""
    members, merged = _grouped(pages, sample)
    exact = F.arrays_overlap("signals", F.array(*[F.lit(s) for s, _ in EXACT]))
    has = lambda s: F.array_contains("signals", s)
    is_variant = (F.size("page_types") == 1) & (F.get("page_types", 0) == "product") & (F.col("variant_share") >= 0.55) & (F.size("variant_signals") > 0)
    classification = F.when(is_variant & exact, "variant_serp_risk").when(is_variant, "variant_cluster").otherwise("true_cannibalization")
    confidence = F.when(~is_variant, "none").when((F.col("variant_share") >= 0.85) & (F.size("variant_signals") >= 2), "high").when(F.col("variant_share") >= 0.7, "medium").otherwise("low")
    name = (
        F.when(is_variant, F.concat(F.lit("content_cannibalization_"), F.col("classification"))).when(has("duplicate_content"), "content_cannibalization_duplicate_content")
        .when(has("duplicate_title") & has("duplicate_meta_description"), "content_cannibalization_serp_duplicate")
        .when(F.array_contains("page_types", "collection") & F.array_contains("page_types", "product"), "content_cannibalization_collection_product_overlap")
        .when(has("duplicate_title"), "content_cannibalization_duplicate_title").when(has("duplicate_meta_description"), "content_cannibalization_duplicate_description")
        .otherwise("content_cannibalization_keyword_overlap")
    )
    named = merged.withColumn("classification", classification).withColumn("confidence", confidence).withColumn("code", name)
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in GROUP_SEVERITY.items() for v in kv]), F.col("code")), F.lit("medium"))
    order = F.array_position(F.array(*[F.lit(c) for c in PRIORITY]), F.col("code"))
    named = numbered(named, [order, F.desc("size"), tx.collated("intent_key"), tx.collated("first_url"), F.col("s")], "groups", "_number")
    none = F.array().cast("array<string>")
    groups = named.select(
        "s", "x",
        F.concat(F.lit("CAN-"), F.lpad(F.col("_number").cast("string"), F.greatest(F.lit(4), F.length(F.col("_number").cast("string"))), F.lit("0"))).alias("group_id"), severity.alias("severity"), "code", "classification", "confidence", "signals", "page_types", "size", "intent_key",
        F.col("primary.finalUrl").alias("primary_url"), F.col("primary.inbound").alias("primary_inbound"),
        F.slice(F.array_remove("listed", F.col("primary.finalUrl")), 1, sample).alias("competing"), F.when(is_variant, F.col("variant_signals")).otherwise(none).alias("variant_signals"),
        F.when(is_variant, F.slice("variant_attributes", 1, 40)).otherwise(none).alias("variant_attributes"), tx.blank(F.col("shared_title")).alias("shared_title"),
        tx.blank(F.col("shared_description")).alias("shared_description"), tx.blank(F.col("shared_hash")).alias("shared_hash"),
    )
    groups = saved(groups, "groups")
    membership = members.select("size", "s", "x", "finalUrl").distinct().join(groups.select("group_id", "size", "s", "x"), ["size", "s", "x"])
    return groups.drop("s", "x"), membership.select("group_id", F.col("finalUrl").alias("url"))


def cannibalization_issues(groups: DataFrame) -> DataFrame:
    evidence = F.concat_ws("; ", F.concat(F.lit("primary="), F.col("primary_url")), F.concat(F.lit("competing="), F.array_join("competing", "|")))
    rows = groups.withColumn("finalUrl", F.col("primary_url")).withColumn("pageType", F.get("page_types", 0))
    made = issue("x", F.col("severity"), "content_cannibalization", evidence, F.col("size"), length=360)
    out = rows.select(F.col("finalUrl").alias("url"), "pageType", made.alias("i"), F.col("code").alias("_code")).select("url", "pageType", "i.*", "_code").withColumn("code", F.col("_code"))
    return _columns(out.withColumn("message", F.regexp_replace("code", "_", " ")).withColumn("recommendation", F.concat(F.lit("Keep one page for the intent: "), F.regexp_replace("code", "_", " "))))
