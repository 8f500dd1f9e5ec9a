"""Pagination probes of collections from a log of what was fetched: where each probe stops and why, decided by aggregates.

A probe asks for a collection's pages in order, as JSON, or as HTML from the first
page on where that page's JSON isn't found. It stops at the first page that

- couldn't be fetched, isn't in the log or isn't JSON (``parse_or_fetch_error``),
- on page 1, answers in neither form (``both_tiers_failed``),
- answers with 404 or a server error (``failed_status``), or with nothing (``empty_response``),
- brings no product that an earlier page hasn't brought (``zero_new_products``),

or after ``max_pages`` (``max_probe_pages``). What a page is worth doesn't hang on
where the probe stops: a product is new on the least page that has it. So the stop
is the least page at which any of these holds, and no collection is read in order.

The log is ``(collection_url, page_no, tier, status, body, error)``, a row for each page and tier.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as u
from ..operators import extract
from ..operators.lineage import portions, saved
from .recorded import stops_probe

#: Products asked for with a page, and pages of a collection (fixed values).
PAGE_LIMIT, MAX_PAGES = 250, 20
#: Listed products that one task tells.
PRODUCTS_A_TASK = 500_000
FAILURES = ("both_tiers_failed", "failed_status", "empty_response", "parse_or_fetch_error")


@dataclass(frozen=True)
class Probes:
    """``collections``: a row for each probe; ``pages``: those that brought products or nothing new; ``products``: each new product, with its page and place."""

    collections: DataFrame
    pages: DataFrame
    products: DataFrame


def _json_pages(rows: DataFrame) -> DataFrame:
    """Whether a body is JSON, how many products it lists, and their handles in order; a body is read once."""
    whole = rows.withColumn("_v", F.try_parse_json("body"))
    listed = F.coalesce(F.try_variant_get("_v", "$.products", "array<variant>"), F.array().cast("array<variant>"))
    handle = lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, "$.handle", "variant")) == "STRING", F.try_variant_get(x, "$.handle", "string"))
    found = whole.select(*rows.columns, F.col("_v").isNotNull().alias("_read"), F.transform(listed, handle).alias("_handles"))
    return found.select(*rows.columns, "_read", F.size("_handles").alias("_count"), "_handles")


#: A tag whose attributes are quoted and hold no reference, of no element whose content isn't markup. Attributes are bounded, as Java repeats groups by recursion.
_NAME = r"[A-Za-z][A-Za-z0-9-]*+"
_ATTRIBUTE = rf'[ \t\r\n\f]++{_NAME}="[^"<>&]*+"'
_PLAIN_TAG = rf"</?(?!(?i:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[ \t\r\n\f/>]){_NAME}(?:{_ATTRIBUTE}){{0,20}}+[ \t\r\n\f]*+/?>"
_ANCHOR = rf'<[aA](?:(?![ \t\r\n\f]++(?i:href)=){_ATTRIBUTE}){{0,20}}+[ \t\r\n\f]++(?i:href)="([^"]*+)"'
#: A link to the page's own host in which nothing has to be folded, escaped or resolved.
_PLAIN_LINK = r"^/(?!/)[A-Za-z0-9_/-]*+(?:\?[A-Za-z0-9_=&-]*+)?+\z"
_PLAIN_HOST = r"^https?://[a-z0-9.-]++/"
_ORIGIN = r"^(https?://[a-z0-9.-]++)(?:/|\z)"


def _has_plain_tags() -> Column:
    """Whether all markup of a body is plain tags, and its collection's host is plain too: two patterns find its links then, which the parser would find."""
    return F.coalesce(~F.contains(F.regexp_replace("body", _PLAIN_TAG, ""), F.lit("<")) & F.col("collection_url").rlike(_ORIGIN), F.lit(False))


def _plain_html_pages(rows: DataFrame) -> DataFrame:
    """``_html_pages`` of bodies with plain tags."""
    origin = F.regexp_extract("collection_url", _ORIGIN, 1)
    product = lambda path: F.nullif(F.regexp_extract(path, "^[^?]*?/products/+([^/?]++)", 1), F.lit(""))
    other = lambda x: u.bound(u.parts(x, "collection_url", idn=True), lambda p: F.when(p["valid"] & (p["origin"] == origin), product(p["path"])))
    found = F.transform(F.regexp_extract_all("body", F.lit(_ANCHOR), F.lit(1)), lambda x: F.when(x.rlike(_PLAIN_LINK), product(x)).when(~(x.rlike(_PLAIN_HOST) & ~x.startswith(F.concat(origin, F.lit("/")))), other(x)))
    handles = F.array_distinct(F.filter(found, lambda h: h.isNotNull()))
    return rows.withColumn("_handles", handles).select(*rows.columns, F.lit(True).alias("_read"), F.size("_handles").alias("_count"), "_handles")


def _html_pages(rows: DataFrame) -> DataFrame:
    """``handles`` of the products on the collection's own host that a listing page links to, each once."""
    linked = extract.parse_html(rows, "body", fields=(), base="collection_url", keep_query=True)
    own = F.filter("links", lambda x: x["internal"])
    path = lambda x: F.regexp_replace(F.regexp_replace(x["href"], "^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    handles = F.array_distinct(F.filter(F.transform(own, lambda x: u.segment_after(path(x), "products")), lambda h: h.isNotNull()))
    return linked.select(*rows.columns, F.lit(True).alias("_read"), F.size(handles).alias("_count"), handles.alias("_handles"))


def _lost() -> Column:
    return F.col("error").isNotNull() & (F.col("error") != "")


def _tiers(log: DataFrame) -> DataFrame:
    """``(collection_url, _html)``: whether each probe reads HTML, as the JSON of its first page isn't found."""
    return log.groupBy("collection_url").agg(F.max(F.coalesce((F.col("page_no") == 1) & (F.col("tier") == "json") & (F.col("status") == 404) & ~_lost(), F.lit(False))).alias("_html"))


def _read(log: DataFrame, tiers: DataFrame, max_pages: int) -> DataFrame:
    """The pages of the form that each probe uses, with what stops it there by itself and the products listed."""
    inside, lost = log.filter(F.col("page_no").between(1, max_pages)), _lost()
    used = inside.join(tiers, "collection_url").filter(F.col("tier") == F.when(F.col("_html"), "html").otherwise("json"))
    blank = ~tx.blank(F.col("body")).rlike(r"(?U)\S")
    fault = (
        F.when(lost | F.col("status").isNull(), "parse_or_fetch_error").when(F.col("_html") & (F.col("page_no") == 1) & (stops_probe(F.col("status")) | blank), "both_tiers_failed")
        .when(stops_probe(F.col("status")), "failed_status").when(blank, "empty_response")
    )
    used = used.select("collection_url", "_collection", "page_no", "_html", fault.alias("_fault"), "body")
    plain = _has_plain_tags()
    found = _json_pages(used.filter("not _html")).unionByName(_plain_html_pages(used.filter(F.col("_html") & plain))).unionByName(_html_pages(used.filter(F.col("_html") & ~plain)))
    unread = F.when(~F.col("_read"), "parse_or_fetch_error")
    return found.select("collection_url", "_collection", "page_no", F.coalesce("_fault", unread).alias("_fault"), F.col("_count").cast("long").alias("_count"), "_handles")


#: Handles that addresses hold as they are, and those of them that hold nothing skipped. No skipped pattern has a slash but as its first or last character, so none reaches from before the last slash into such a handle.
_PLAIN_HANDLE = r"^[A-Za-z0-9_-]++\z"
_BEGIN, _ANY = ("|".join(re.escape(x.removeprefix("/")) for x in u.SKIPPED_PATTERNS if x.startswith("/") == first) for first in (True, False))
_OPEN_HANDLE = rf"^(?!(?i:{_BEGIN}))(?!(?i:.*?(?:{_ANY})))[A-Za-z0-9_-]++\z"


def _front(root: Column) -> Column:
    """What the addresses of plain handles begin with, or nothing, if the host isn't plain or is skipped."""
    front = F.concat(F.nullif(F.regexp_extract(root, _ORIGIN, 1), F.lit("")), F.lit("/products/"))
    return F.coalesce(F.when(~u.has_skipped_pattern(front), front), F.lit(""))


def _product(root: Column, front: Column, handle: Column) -> Column:
    """What a product is told by: its handle, where that is plain and its address is ``front`` and the handle; its whole address, where it is another; nothing, if it is skipped."""
    def known(href: Column) -> Column:
        """A whole address that a plain handle has too is told as that."""
        rest = F.substr(href, F.length(front) + 1)
        return F.when((front != "") & href.startswith(front) & rest.rlike(_PLAIN_HANDLE), rest).otherwise(href)

    read = u.bound(u.parts(root), lambda b: u.bound(u.parts(F.concat(F.lit("/products/"), handle), b["href"]), lambda p: F.when(~u.should_skip(p, b), known(p["href"]))))
    return F.when((front != "") & handle.rlike(_OPEN_HANDLE), handle).otherwise(F.coalesce(F.when(handle != "", read), F.lit("")))


def _handle(listed: Column) -> Column:
    """A handle without white space at its ends, which nearly always is none but spaces."""
    bare = F.trim(tx.blank(listed))
    return F.when(bare.rlike(r"^[!-~]*+\z"), bare).otherwise(tx.trimmed(tx.blank(listed)))


def probe(log: DataFrame, base: str | Column | None = None, max_pages: int = MAX_PAGES) -> Probes:
    """All probes of a log. ``base``: the address that products are read against and that tells what is skipped; the collection's own, if not given."""
    # Collections have numbers from here on, so that no group and no shuffle carries their addresses.
    tiers = saved(_tiers(log).withColumn("_collection", F.monotonically_increasing_id()), "probe-tiers")
    pages = saved(_read(log, tiers, max_pages), "probe-pages")
    root = F.col("collection_url") if base is None else F.lit(base) if isinstance(base, str) else base
    key = ["_collection", "page_no"]
    # Skipped products are told by an empty text: a filter on what they are told by would have it told twice.
    # What hangs on the page alone is found before its handles are exploded.
    listed = pages.filter("_fault is null").select(root.alias("_root"), _front(root).alias("_front"), *key, "_handles")
    listed = listed.repartition(portions(log.sparkSession, pages.agg(F.sum("_count")).first()[0] or 0, PRODUCTS_A_TASK), *key)
    listed = listed.select("_root", "_front", *key, F.posexplode("_handles").alias("place", "handle")).withColumn("handle", _handle(F.col("handle")))
    at = F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("place")
    first = saved(listed.groupBy("_collection", _product(F.col("_root"), F.col("_front"), F.col("handle")).alias("_product")).agg(F.min(at).alias("_at")), "probe-products").filter("_product <> ''")
    first = first.select("_collection", "_product", F.shiftright("_at", 32).cast("int").alias("page_no"), F.col("_at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))
    new = first.groupBy(*key).agg(F.count(F.lit(1)).alias("new"))
    judged = pages.drop("_handles").join(new, key, "left").withColumn("new", F.coalesce("new", F.lit(0).cast("long")))
    judged = saved(judged.select(*key, "_fault", "_count", "new"), "probe-judged")
    reason = F.coalesce("_fault", F.when(F.col("new") == 0, "zero_new_products"))
    stop = F.min(F.when(reason.isNotNull(), F.struct(F.col("page_no").alias("page"), reason.alias("reason"))))
    # No more pages than ``max_pages``, so the set of those at hand is small.
    missing = F.get(F.array_except(F.sequence(F.lit(1), F.lit(max_pages)), F.array_sort(F.collect_set("page_no"))), F.lit(0))
    ends = tiers.join(judged.groupBy("_collection").agg(stop.alias("s"), missing.alias("m"), F.lit(True).alias("_any")), "_collection", "left")
    gap = F.when(F.col("_any").isNull(), F.lit(1)).otherwise(F.col("m"))
    end = F.least(F.when(gap.isNotNull(), F.struct(gap.alias("page"), F.lit("parse_or_fetch_error").alias("reason"))), F.col("s"), F.struct(F.lit(max_pages + 1).alias("page"), F.lit("max_probe_pages").alias("reason")))
    ends = saved(ends.select("_collection", "collection_url", F.least(end["page"], F.lit(max_pages)).alias("stop_page"), end["reason"].alias("stop_reason"), F.col("_html").alias("html")), "probe-ends")
    within = judged.filter("_fault is null").join(ends, "_collection").filter("page_no <= stop_page")
    read = within.select("collection_url", F.col("page_no").alias("page"), F.col("_count").alias("products_found"), "new")
    # Where a product stands first is where its handle and its address come from.
    lists = pages.select("collection_url", *key, "_handles")
    products = first.join(ends.select("_collection", "stop_page"), "_collection").filter("page_no <= stop_page").join(lists, key).withColumn("handle", _handle(F.get("_handles", F.col("place"))))
    whole = F.when(F.col("_product").rlike(_PLAIN_HANDLE), F.concat(_front(root), "_product")).otherwise(F.col("_product"))
    products = products.select("collection_url", whole.alias("product_url"), "page_no", "place", "handle")
    total = within.groupBy("_collection").agg(F.sum("new").alias("products_found"))
    handle = u.bound(u.parts("collection_url"), lambda p: F.when(F.get(u.segments(p["path"]), F.lit(0)) == "collections", F.get(u.segments(p["path"]), F.lit(1))))
    collections = ends.join(total, "_collection", "left").select(
        "collection_url", handle.alias("handle"), F.lit(1).alias("attempted"), (F.col("stop_reason") == "zero_new_products").cast("int").alias("exhausted"), F.col("stop_reason").isin(*FAILURES).cast("int").alias("failed"),
        F.col("stop_page").alias("probe_pages_fetched"), (F.col("stop_page") + F.col("html").cast("int")).alias("requests"), F.coalesce("products_found", F.lit(0).cast("long")).alias("products_found"), "stop_reason",
    )
    return Probes(collections, read, products)


def memberships(products: DataFrame) -> DataFrame:
    """``(product_handle, collection_handle)`` from a probe's products."""
    path = F.regexp_replace("collection_url", "^[a-z]+://[^/]+", "")
    return products.select(F.col("handle").alias("product_handle"), u.segment_after(path, "collections").alias("collection_handle")).distinct()
