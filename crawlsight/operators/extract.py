"""HTML to page records: one streaming parse in Arrow batches, the rest native."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import images as img
from ..functions import text as tx
from ..functions import url as u
from ..schema import PARSED, RESOLVED

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "svg", "template"}
_PRICE = ("og:price:amount", "product:price:amount")
_CURRENCY = ("og:price:currency", "product:price:currency")
_AVAILABILITY = ("og:availability", "product:availability")


#: An ampersand, and what makes it a whole reference.
_AMPERSAND = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;))?")


def _whole_references(html: str) -> str:
    """Ampersands that begin no reference with its semicolon are escaped, so that they stay as they are."""
    return _AMPERSAND.sub(lambda m: m[0] if m[2] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}", html)


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


#: Spaces in the narrow sense, which go from the ends of a plain text.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _plain_readers(only: Sequence[str]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """What cleans a text where only ASCII white space is folded, and what reads the references in ``only``, those that tags cut in two among them."""
    known = {f"&{n};": html5[f"{n};"] if n[0] != "#" else chr(int(n[1:])) for n in only}
    reference = re.compile("|".join(map(re.escape, known)))
    read = lambda text: reference.sub(lambda m: known[m[0]], text)
    return lambda text: read(re.sub(r"[\t\n\f\r ]+", " ", text).strip(_SPACES)), read


class _Page(HTMLParser):
    def __init__(self, clean: Callable[[str], str] = _clean, read: Callable[[str], str] = str) -> None:
        super().__init__(convert_charrefs=True)
        self.clean, self.read = clean, read
        self.elements: set[str] = set()
        self.count = 0
        self.text: list[str] = []
        self.silent: list[str] = []
        self.meta: dict[str, str] = {}
        self.title: list[str] | None = None
        self.in_title = False
        self.canonical = self.lang = ""
        self.charset = ""
        self.alternates: list[dict] = []
        self.headings: dict[str, list[str]] = {"h1": [], "h2": [], "h3": []}
        self.open_heading: list[tuple[str, list[str]]] = []
        self.anchors: list[dict] = []
        self.open_anchor: list[tuple[dict, list[str]]] = []
        self.images: list[dict] = []
        self.scripts: list[str] = []
        self.n = {"script": 0, "sheet": 0, "blocking": 0, "preload": 0}
        self.wallet = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: self.read(v or "") for k, v in reversed(attrs)}
        self.count += 1
        self.elements.add(tag)
        if tag in _SILENT and tag not in _VOID:
            self.silent.append(tag)
        if tag == "html" and not self.lang:
            self.lang = a.get("lang", "").strip()
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag == "meta":
            for key in (a.get("name"), a.get("property")):
                if key and "content" in a and key not in self.meta:
                    self.meta[key] = a["content"]
            if not self.charset:
                sent = re.search(r"charset=([^;\s]+)", a.get("content", ""), re.I) if a.get("http-equiv", "").lower() == "content-type" else None
                self.charset = a.get("charset", "").strip() or (sent[1] if sent else "")
            self.wallet |= a.get("name") == "shopify-digital-wallet"
        elif tag == "link":
            self._link(a)
        elif tag in self.headings:
            self.open_heading.append((tag, []))
        elif tag == "a" and "href" in a:
            anchor = {"rawHref": a["href"], "text": "", "rel": a.get("rel", "").lower().split()}
            self.anchors.append(anchor)
            self.open_anchor.append((anchor, []))
        elif tag == "img":
            self.images.append(
                {
                    "src": "", "rawSrc": a.get("src") or a.get("data-src") or a.get("data-original") or "", "alt": a.get("alt", "").strip(),
                    "width": a.get("width"), "height": a.get("height"), "fetchPriority": a.get("fetchpriority"),
                    "lazy": a.get("loading", "").lower() == "lazy" or "data-src" in a,
                }
            )
        elif tag == "script":
            self.n["script"] += 1
            if a.get("src"):
                self.scripts.append(a["src"])

    def _link(self, a: dict) -> None:
        rel = a.get("rel", "").lower().split()
        if "canonical" in rel and not self.canonical:
            self.canonical = a.get("href", "").strip()
        if "alternate" in rel:
            self.alternates.append({k: a.get(k, "").strip() for k in ("href", "hreflang", "type", "title")})
        if "stylesheet" in rel:
            self.n["sheet"] += 1
            self.n["blocking"] += a.get("media", "").strip().lower() in ("", "all", "screen")
        if a.get("rel") == "preload" and (a.get("as") == "image" or "imagesrcset" in a):
            self.n["preload"] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            while self.silent and self.silent.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False
        while tag in self.headings and self.open_heading:
            name, held = self.open_heading.pop()
            self.headings[name].append(self.clean("".join(held)))
            if name == tag:
                break
        if tag == "a" and self.open_anchor:
            anchor, held = self.open_anchor.pop()
            anchor["text"] = self.clean("".join(held))

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.text.append(data)
        if self.in_title and self.title is not None:
            self.title.append(data)
        for _, held in self.open_heading:
            held.append(data)
        for _, held in self.open_anchor:
            held.append(data)

    def first(self, *names: str) -> str:
        return next((self.meta[n] for n in names if self.meta.get(n)), "")


def _early_charset(html: str) -> bool:
    at = re.search(r"<head", html, re.I)
    head = html[at.start() :].encode()[:1024].decode("utf-8", "ignore") if at else ""
    return bool(re.search(r"<meta[^>]+charset\s*=\s*[\"']?\s*utf-?8", head, re.I))


def parse(html: str | None, cut_references: bool = True, only: Sequence[str] | None = None) -> dict:
    """The record of one document; broken markup is read as far as it goes. References without their semicolon count as browsers read them, or, without ``cut_references``, as plain text.

    With ``only``, names of references, all others are plain text too, and titles, headings and texts keep all white space that isn't ASCII.
    """
    html = html or ""
    clean, read = (_clean, str) if only is None else _plain_readers(only)
    p = _Page(clean, read)
    # All ampersands are escaped where they are read afterwards.
    p.feed(html.replace("&", "&amp;") if only is not None else html if cut_references else _whole_references(html))
    p.close()
    for tag in [t for t, _ in reversed(p.open_heading)]:
        p.handle_endtag(tag)
    while p.open_anchor:
        p.handle_endtag("a")
    implied = len({"html", "head", "body"} - p.elements)
    meta = {
        "title": clean("".join(p.title or [])), "description": _clean(p.first("description")), "canonical": p.canonical, "robots": p.first("robots").strip(),
        "htmlLang": p.lang[:40], "charset": p.charset[:40], "charsetWithinFirst1024": _early_charset(html), "viewport": _clean(p.first("viewport"))[:200],
        "alternates": p.alternates, "ogTitle": _clean(p.first("og:title")), "ogDescription": _clean(p.first("og:description")), "ogType": p.first("og:type").strip(),
        "ogUrl": p.first("og:url").strip(), "ogImage": p.first("og:image").strip(), "ogImageWidth": p.first("og:image:width").strip(),
        "ogImageHeight": p.first("og:image:height").strip(), "ogPriceAmount": _clean(p.first(*_PRICE))[:80], "ogPriceCurrency": _clean(p.first(*_CURRENCY))[:20],
        "ogAvailability": _clean(p.first(*_AVAILABILITY))[:80], "twitterCard": p.first("twitter:card").strip(), "twitterTitle": _clean(p.first("twitter:title")),
        "twitterDescription": _clean(p.first("twitter:description")), "twitterImage": p.first("twitter:image").strip(),
    }
    return {
        "meta": meta, "headings": {k: [t for t in v if t] for k, v in p.headings.items()}, "text": clean("".join(p.text)), "anchors": p.anchors,
        "rawImages": p.images, "scripts": p.scripts, "scriptCount": p.n["script"], "stylesheetCount": p.n["sheet"],
        "renderBlockingStylesheetCount": p.n["blocking"], "preloadedImageCount": p.n["preload"], "domElementCount": p.count + implied, "digitalWallet": p.wallet,
    }


def _resolved(found: dict, base: str | None, keep_query: bool) -> dict:
    """Links, images and scripts of a page with the addresses that they mean; of links alike in both forms of the address the first stays."""
    seen: dict[str, tuple] = {}

    def at(url: str) -> tuple:
        if url not in seen:
            seen[url] = u.take_apart(url, base)
        return seen[url]

    own = u.take_apart(base)[1]
    links: dict[tuple, dict] = {}
    for a in found["anchors"]:
        href, origin, _, _, path, query, valid = at(a["rawHref"])
        if valid:
            bare = path[:-1] if len(path) > 1 and path.endswith("/") else path
            shown = href.partition("#")[0] if origin == "null" else origin + bare + (query if keep_query else "")
            links.setdefault((shown, a["rawHref"]), {"href": shown, **a, "internal": None if own is None else origin == own})
    images = [{**i, "src": at(i["rawSrc"])[0] or i["rawSrc"]} for i in found["rawImages"] if i["rawSrc"]]
    scripts = [{"host": p[3], "path": p[4], "foreign": None if own is None else p[1] != own} for p in map(at, found["scripts"]) if p[6]]
    return {"links": list(links.values()), "images": images, "scriptUrls": scripts}


def parse_html(raw: DataFrame, html: str = "html", fields: Sequence[str] | None = None, base: str | None = None, keep_query: bool = False, cut_references: bool = True, only: Sequence[str] | None = None) -> DataFrame:
    """Add the columns of ``PARSED``, or those of them in ``fields``, and with ``base``, the column of the page's own URL, those of ``RESOLVED``.

    Filter on status and URL before this: nothing is pushed through it.
    """
    names = raw.columns
    added = [f for f in PARSED.fields if fields is None or f.name in fields] + (RESOLVED.fields if base else [])
    schema = T.StructType([*raw.schema.fields, *added])
    kinds = to_arrow_schema(T.StructType(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [parse(x, cut_references, only) for x in part.column(html).to_pylist()]
                if base:
                    rows = [r | _resolved(r, b, keep_query) for r, b in zip(rows, part.column(base).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], *[pa.array([r[f.name] for r in rows], f.type) for f in kinds]], names=[*names, *kinds.names]
                )

    return raw.mapInArrow(run, schema)


#: Traces of the platform and of its usual apps in the markup (fixed values).
PLATFORM = r"(?i)cdn\.shopify\.com|Shopify\.theme|Shopify\.shop|myshopify\.com|/cart/add"
APPS = (("Klaviyo", "klaviyo"), ("Yotpo", "yotpo"), ("JudgeMe", r"judge\.me|judgeme"), ("Loox", "loox"), ("Recharge", "recharge"), ("Shopify Reviews", r"productreviews\.shopifycdn"), ("Gorgias", "gorgias"))
CORE_HOSTS = ("cdn.shopify.com", "shopifycdn.net", "shopify.com", "myshopify.com")
APP_SCRIPTS = r"(?i)judge\.me|judgeme|loox|yotpo|stamped|okendo|klaviyo|gorgias|recharge|aftership|shopifycloud|app"


def platform(html: Column, path: Column, wallet: Column) -> Column:
    """struct of platform signals and the handles that the URL names."""
    shop = F.regexp_extract(html, r"Shopify\.shop\s*=\s*[\"']([^\"']+)[\"']", 1)
    money = F.regexp_extract(html, r"(?i)money_format[\"']?\s*:\s*[\"']([^\"']+)[\"']", 1)
    apps = F.filter(F.array(*[F.when(html.rlike(f"(?i){p}"), F.lit(n)) for n, p in APPS]), lambda a: a.isNotNull())
    article = F.when(F.get(u.segments(path), 0) == "blogs", F.get(u.segments(path), 2))
    return F.struct(
        html.rlike(PLATFORM).alias("isShopify"), F.when(shop != "", shop).alias("shopDomain"), F.when(wallet, "Shopify theme").alias("themeName"),
        F.when(money != "", money).alias("moneyFormat"), apps.alias("detectedApps"), u.classify(path).alias("pageType"),
        u.segment_after(path, "products").alias("productHandle"), u.segment_after(path, "collections").alias("collectionHandle"),
        u.segment_after(path, "blogs").alias("blogHandle"), article.alias("articleHandle"),
    )


def keep_html(raw: DataFrame) -> DataFrame:
    """Pages that are HTML by their type or by how they begin."""
    return raw.filter(F.contains(F.lower(tx.blank(F.col("contentType"))), F.lit("text/html")) | tx.trimmed(tx.blank(F.col("html"))).startswith("<"))


def with_redirect(raw: DataFrame) -> DataFrame:
    """Derive ``redirected`` from the URL that was asked for and the one that answered, in the form that pages are compared in."""
    asked, got = (u.form(c, "page_query", F.col(c)) for c in ("url", "finalUrl"))
    return raw.withColumn("redirected", ~asked.eqNullSafe(got)).select(*raw.columns, *([] if "redirected" in raw.columns else ["redirected"]))


def resolve(df: DataFrame, key: list[str], items: str, raw: str, base: str) -> DataFrame:
    """``items`` exploded with their place and the parts of their URL."""
    rows = df.select(*key, F.col(base).alias("_base"), F.posexplode(items).alias("pos", "item"))
    return rows.withColumn("parts", u.parts(F.col(f"item.{raw}"), "_base"))


def pages(raw: DataFrame, keep_query: bool = False, cut_references: bool = True, only: Sequence[str] | None = None) -> DataFrame:
    """The page table from raw pages. The pass that parses a page resolves its URLs too; there is no shuffle. ``only`` as for ``parse``."""
    fields = [n for n in PARSED.names if n not in ("anchors", "rawImages", "scripts")]
    parsed = parse_html(keep_html(raw), fields=fields, base="finalUrl", keep_query=keep_query, cut_references=cut_references, only=only).withColumn("_p", u.parts("finalUrl"))
    full = parsed.withColumn("shopify", platform(F.col("html"), F.col("_p.path"), F.col("digitalWallet")))
    hosts = F.array_distinct(F.transform(F.filter("scriptUrls", lambda s: s["foreign"] & ~_contains_any(s["host"], CORE_HOSTS)), lambda s: s["host"]))
    apps = F.array_distinct(F.transform(F.filter("scriptUrls", lambda s: F.concat(s["host"], s["path"]).rlike(APP_SCRIPTS) & ~F.contains(s["host"], F.lit("cdn.shopify.com"))), lambda s: s["host"]))
    primary = F.get(F.filter("images", img.is_primary), 0)
    speed = F.struct(
        F.round(F.octet_length("html") / 1024).cast("int").alias("htmlSizeKb"), "domElementCount", "scriptCount", F.size("scriptUrls").alias("externalScriptCount"),
        F.size(hosts).alias("thirdPartyScriptCount"), F.size(apps).alias("shopifyAppScriptCount"), "stylesheetCount", "renderBlockingStylesheetCount", F.size("images").alias("imageCount"),
        F.size(F.filter("images", lambda i: img.wide(i["src"]))).alias("largeImageUrlCount"), "preloadedImageCount", tx.blank(primary["fetchPriority"]).alias("primaryImageFetchPriority"),
        F.coalesce(primary["lazy"], F.lit(False)).alias("primaryImageLazy"), hosts.alias("thirdPartyScriptHosts"), apps.alias("shopifyAppScriptHosts"),
    )
    kept = [f.name for f in raw.schema.fields if f.name != "html"]
    words, digest = (tx.word_count(F.col("text")), tx.text_hash(F.col("text"))) if only is None else (F.regexp_count("text", F.lit(r"[^\t\n\f\r ]+")), F.sha1(F.lower("text")))
    return full.select(
        *kept, F.col("shopify.pageType").alias("pageType"), "meta", "headings", words.alias("wordCount"), F.substring("text", 1, 6000).alias("textSample"), digest.alias("textHash"),
        "images", "links", "shopify", speed.alias("speed"),
    )


def _contains_any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(x, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(x, F.lit(w))
    return out


def image_usages(page_table: DataFrame) -> DataFrame:
    """A row for each image of each page."""
    rows = page_table.select(F.col("finalUrl").alias("pageUrl"), "pageType", F.explode("images").alias("i"))
    return rows.select(
        F.col("i.src").alias("imageUrl"), F.col("i.rawSrc").alias("rawSrc"), tx.truncated(F.col("i.alt"), 300).alias("alt"), "pageUrl", "pageType",
        F.col("i.width").alias("width"), F.col("i.height").alias("height"), F.col("i.fetchPriority").alias("fetchPriority"), F.col("i.lazy").alias("lazy"),
    )


def compact(page_table: DataFrame, links: int = 120, images: int = 40, chars: int = 2000) -> DataFrame:
    """Capped copies of the arrays and the text, for storage."""
    return page_table.withColumns({"links": F.slice("links", 1, links), "images": F.slice("images", 1, images), "textSample": F.substring("textSample", 1, chars)})
