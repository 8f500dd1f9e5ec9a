"""Tables and their columns: one explicit schema each, nothing inferred."""

from __future__ import annotations

import re

from pyspark.sql import types as T


_SIMPLE = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def _parts(text: str) -> list[str]:
    """The parts between commas that stand in no angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]]]


def _type(text: str) -> T.DataType:
    if text.startswith("ARRAY<"):
        return T.ArrayType(_type(text[6:-1].strip()))
    return ddl(text[7:-1]) if text.startswith("STRUCT<") else _SIMPLE[text]


def ddl(text: str) -> T.StructType:
    """A schema from ``name TYPE, ...``; Python workers import this module, so no session is asked for."""
    pairs = [re.match(r"(\w+)\s*:?\s*(.*)", part, re.S).groups() for part in _parts(text)]
    return T.StructType([T.StructField(name, _type(kind.strip())) for name, kind in pairs])


RAW_PAGE = ddl(
    "crawl_seq BIGINT, url STRING, finalUrl STRING, discoverySource STRING, redirected BOOLEAN, redirectCount INT, status INT, depth INT, "
    "contentType STRING, xRobotsTag STRING, loadTimeMs BIGINT, html STRING"
)
IMAGE = "STRUCT<src: STRING, rawSrc: STRING, alt: STRING, width: STRING, height: STRING, fetchPriority: STRING, lazy: BOOLEAN>"
ANCHOR = "STRUCT<rawHref: STRING, text: STRING, rel: ARRAY<STRING>>"
LINK = "STRUCT<href: STRING, rawHref: STRING, text: STRING, rel: ARRAY<STRING>, internal: BOOLEAN>"
ALTERNATE = "STRUCT<href: STRING, hreflang: STRING, type: STRING, title: STRING>"
META = (
    "STRUCT<title: STRING, description: STRING, canonical: STRING, robots: STRING, htmlLang: STRING, charset: STRING, charsetWithinFirst1024: BOOLEAN, "
    f"viewport: STRING, alternates: ARRAY<{ALTERNATE}>, ogTitle: STRING, ogDescription: STRING, ogType: STRING, ogUrl: STRING, ogImage: STRING, "
    "ogImageWidth: STRING, ogImageHeight: STRING, ogPriceAmount: STRING, ogPriceCurrency: STRING, ogAvailability: STRING, "
    "twitterCard: STRING, twitterTitle: STRING, twitterDescription: STRING, twitterImage: STRING>"
)
HEADINGS = "STRUCT<h1: ARRAY<STRING>, h2: ARRAY<STRING>, h3: ARRAY<STRING>>"
#: What the parser hands on; everything else is derived natively.
PARSED = ddl(
    f"meta {META}, headings {HEADINGS}, text STRING, anchors ARRAY<{ANCHOR}>, rawImages ARRAY<{IMAGE}>, scripts ARRAY<STRING>, scriptCount INT, "
    "stylesheetCount INT, renderBlockingStylesheetCount INT, preloadedImageCount INT, domElementCount INT, digitalWallet BOOLEAN"
)
#: What it hands on where it knows the page's URL.
RESOLVED = ddl(f"links ARRAY<{LINK}>, images ARRAY<{IMAGE}>, scriptUrls ARRAY<STRUCT<host: STRING, path: STRING, foreign: BOOLEAN>>")
ISSUE_COLUMNS = ("url", "pageType", "severity", "category", "code", "message", "recommendation", "evidence", "metric")
ISSUE = ddl("url STRING, pageType STRING, severity STRING, category STRING, code STRING, message STRING, recommendation STRING, evidence STRING, metric BIGINT")
SEVERITIES = ("critical", "high", "medium", "low", "recommended", "info")
EDGE = ddl("src STRING, dst STRING")
IMAGE_USAGE = ddl("imageUrl STRING, rawSrc STRING, alt STRING, pageUrl STRING, pageType STRING, width STRING, height STRING, fetchPriority STRING, lazy BOOLEAN")
PROBE_LOG = ddl("collection STRING, page_no INT, product_handle STRING")
FETCH_LOG = ddl("url STRING, status INT, loadTimeMs BIGINT, redirected BOOLEAN, attempt INT, error_code STRING, error_message STRING")
SITEMAP = ddl("sitemap STRING, url STRING, seq BIGINT")
