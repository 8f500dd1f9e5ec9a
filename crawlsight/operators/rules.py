"""The page rules. Codes, severities, categories and thresholds are the catalogue's (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images as img
from ..functions import robots as rb
from ..functions import text as tx
from ..functions import url as u
from .registry import Family, Rule, issue
from .registry import run as run_families

#: Word lists and patterns of the rules (fixed values).
COMMERCE = ("buy", "shop", "online", "men", "mens", "women", "kids", "tshirt", "tshirts", "shirt", "shirts", "pants", "track", "jogger", "joggers", "shorts", "vest", "combo", "pack", "hoodie", "jacket", "collection", "sale")
GENERIC_TITLE = (r"^home$", r"^products?$", r"^collections?$", r"^catalog$", r"^untitled$")
BOILERPLATE = ("welcome to our store", "powered by shopify", "shopify store", "best online shopping", "buy now online", "fastest delivery", "free shipping", "cash on delivery")
DETAIL = ("fabric", "cotton", "fit", "size", "combo", "pack", "price", "color", "colour", "delivery")
GENERIC_COLLECTION = ("^all$", "^all products$", "^catalog$", "^collection$", "^collections$", "^products$", "^new arrivals$")
COLLECTION_BOILERPLATE = ("welcome to our store", "best online shopping", "buy now online", "fastest delivery", "free shipping", "cash on delivery", "clearance sale")
COLLECTION_FAQ = (r"\bfaq\b", "frequently asked", "what size", "how to choose", "how do i")
REVIEW = ("judgeme", r"judge\.me", "review", "rating", "aggregateRating", "stamped", "loox", "yotpo", "okendo")
REVIEW_APPS = "(?i)judge|loox|yotpo|stamped|okendo|review"
FAQ = (r"\bfaq\b", "frequently asked", "question", "acceptedAnswer")
MATERIAL = ("fabric", "cotton", "polyester", "blend", "material", "gsm", "denim", "fleece")
SIZES = ("size", "sizing", "size chart", r"\bS\b|\bM\b|\bL\b|\bXL\b|\bXXL\b|2XL")
CARE = ("wash", "machine wash", "fabric care", "care", "do not bleach", "dry")
SOLD_OUT = r"(?i)\b(?:sold out|out of stock|notify me when (?:it'?s )?available)\b"
IN_STOCK = r"(?i)\b(?:in stock|items? left in stock|available now|hurry,\s*only\s+\d+\s+items?\s+left)\b"
OG_IN_STOCK = r"(?i)\bin\s*stock\b|available now|items? left"
TWITTER_CARDS = ("summary", "summary_large_image", "app", "player")
PLACEHOLDER = "placeholder|no[-_]?image|missing[-_]?image|default[-_]?image|blank|transparent|spacer|1x1"


@dataclass(frozen=True)
class Settings:
    """What a run can change: brands, the moment that dates are compared with, and two deviations that are off by default."""

    brands: tuple[str, ...] = ()
    as_of: str = "2026-01-01 00:00:00"
    match_real_filter_params: bool = False
    facets_on_raw_links: bool = False
    extra_stop: tuple[str, ...] = field(default=())


def _m(name: str) -> Column:
    return tx.blank(F.col(f"meta.{name}"))


def _h1() -> Column:
    return tx.blank(F.get(F.col("headings.h1"), 0))


def _join(array: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(array, 1, n), " | ")


def prepare(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add what several rules use: URL parts and indexability, once for each page."""
    p = pages.withColumn("_p", u.parts("finalUrl"))
    state = rb.summary(F.col("status"), F.col("meta.robots"), F.col("xRobotsTag"), F.col("meta.canonical"), F.col("finalUrl"), F.lit(settings.as_of).cast("timestamp"))
    return p.withColumn("indexability", state).withColumn("_canonical", u.parts(F.col("meta.canonical"), F.col("finalUrl"), idn=True))


def fetch() -> Family:
    def rule(code: str, severity: str, when: Column, advice: str) -> Rule:
        return Rule(code, severity, "technical", when, F.concat(F.lit("status="), F.col("status").cast("string")), F.col("status"), f"The page answered with {code[6:].replace('_', ' ')}.", advice)

    s = F.col("status")
    return Family(
        "fetch",
        (
            rule("fetch_blocked_403", "high", s == 403, "Let the crawler through, or leave the page out."),
            rule("fetch_rate_limited_429", "critical", s == 429, "Crawl more slowly."),
            rule("fetch_server_error", "critical", s >= 500, "Look into the server's errors."),
            rule("fetch_http_error", "critical", (s >= 400) & (s < 500) & ~s.isin(403, 429), "Mend or redirect the URL."),
        ),
        s >= 400,
    )


def basic() -> Family:
    title, description = _m("title"), _m("description")
    missing = F.col("_f.missing")
    return Family(
        "basic",
        (
            Rule("missing_title", "high", "metadata", title == ""),
            Rule("title_length", "medium", "metadata", (title != "") & ((F.length(title) < 25) | (F.length(title) > 65)), title, F.length(title)),
            Rule("missing_meta_description", "high", "metadata", description == ""),
            Rule("meta_description_length", "low", "metadata", (description != "") & ((F.length(description) < 70) | (F.length(description) > 160)), description, F.length(description)),
            Rule("missing_canonical", "medium", "technical", _m("canonical") == ""),
            Rule("missing_h1", "medium", "content", F.size("headings.h1") == 0),
            Rule("multiple_h1", "low", "content", F.size("headings.h1") > 1, _join(F.col("headings.h1")), F.size("headings.h1")),
            Rule("missing_image_alt", "low", "images", F.size(missing) > 0, _join(missing), F.size(missing)),
        ),
        facts={"missing": F.transform(F.filter("images", img.missing_alt), lambda i: i["src"])},
    )


def serp(settings: Settings = Settings()) -> Family:
    title, description, h1 = tx.without_brand(_m("title"), settings.brands), _m("description"), _h1()
    words = tx.meaningful(title)
    brand = [w.lower() for b in settings.brands for w in b.split()] or ["\u0000"]
    shop_page = F.col("pageType").isin("product", "collection")
    c = "serp_snippet"
    same = (tx.normal(title) == tx.normal(description)) & (title != "")
    return Family(
        "serp",
        (
            Rule("serp_generic_title", "high", c, tx.matches_any(title, GENERIC_TITLE), title),
            Rule("serp_brand_only_title", "medium", c, (F.size(words) > 0) & F.forall(words, lambda w: w.isin(brand)), title),
            Rule("serp_title_missing_commerce_terms", "recommended", c, shop_page & ~F.exists(words, lambda w: w.isin(*COMMERCE)), title),
            Rule("serp_title_h1_mismatch", "recommended", c, (h1 != "") & ~tx.overlaps(title, h1), F.concat_ws(" | ", title, h1)),
            Rule("serp_boilerplate_meta_description", "recommended", c, tx.matches_any(description, BOILERPLATE), description),
            Rule("serp_description_duplicates_title", "medium", c, same, description),
            Rule("serp_description_duplicates_h1", "medium", c, (h1 != "") & (tx.normal(h1) == tx.normal(description)), description),
            Rule("serp_product_description_missing_detail", "recommended", c, (F.col("pageType") == "product") & ~tx.mentions_any(description, DETAIL), description),
        ),
        evidence_length=220,
    )


def _absolute_http(x: Column) -> Column:
    return x.rlike(r"(?i)^(https?:)?//[^/\s]+")


def social() -> Family:
    c = "metadata"
    title, og, tw = _m("title"), _m("ogTitle"), _m("twitterTitle")
    target = F.when(F.col("indexability.canonicalTarget") != "", F.col("indexability.canonicalTarget")).otherwise(u.normalized(F.col("_p"), "compare", F.lit("")))
    own = u.form(F.col("meta.ogUrl"), "compare", F.lit(""), F.col("finalUrl"), idn=True)
    return Family(
        "social",
        (
            Rule("og_title_missing", "recommended", c, og == ""),
            Rule("og_title_mismatch", "recommended", c, (og != "") & (title != "") & ~tx.overlaps(og, title), F.concat_ws(" | ", og, title)),
            Rule("og_description_missing", "recommended", c, _m("ogDescription") == ""),
            Rule("og_image_missing", "recommended", c, _m("ogImage") == ""),
            Rule("og_image_invalid_url", "medium", c, (_m("ogImage") != "") & ~_absolute_http(_m("ogImage")), _m("ogImage")),
            Rule("og_url_mismatch", "medium", c, (_m("ogUrl") != "") & (own != target), F.concat_ws(" | ", own, target)),
            Rule("og_image_dimensions_missing", "recommended", c, (_m("ogImage") != "") & ((_m("ogImageWidth") == "") | (_m("ogImageHeight") == "")), _m("ogImage")),
            Rule("twitter_card_missing", "recommended", c, _m("twitterCard") == ""),
            Rule("twitter_card_invalid", "medium", c, (_m("twitterCard") != "") & ~F.lower(_m("twitterCard")).isin(*TWITTER_CARDS), _m("twitterCard")),
            Rule("twitter_image_invalid_url", "medium", c, (_m("twitterImage") != "") & ~_absolute_http(_m("twitterImage")), _m("twitterImage")),
            Rule("twitter_title_og_title_mismatch", "recommended", c, (tw != "") & (og != "") & ~tx.overlaps(tw, og), F.concat_ws(" | ", tw, og)),
        ),
        F.col("status") == 200,
        220,
    )


def canonical_reason() -> Column:
    """missing, broken_structure, invalid_url, valid or different_page."""
    p, c = F.col("_p"), F.col("_canonical")
    own, other = u.normalized(p, "tracking", F.lit("")), u.normalized(c, "tracking", F.lit(""))
    clean = u.is_collection_product(p["path"]) & (c["path"] == F.concat(F.lit("/products/"), u.segment_after(p["path"], "products"))) & (c["origin"] == p["origin"])
    return (
        F.when(tx.trimmed(_m("canonical")) == "", "missing").when(~c["valid"], "invalid_url").when(~c["scheme"].isin("http", "https") | (c["host"] == ""), "broken_structure")
        .when((own == "") | (other == ""), "invalid_url").when((own == other) | F.coalesce(clean, F.lit(False)), "valid").otherwise("different_page")
    )


def placeholder_og_image() -> Column:
    og = F.lower(_m("ogImage"))
    return (og == "") | (og.rlike(PLACEHOLDER) & ~og.rlike(r"cdn\.shopify\.com|/cdn/shop/"))


def metadata() -> Family:
    c = "metadata"
    source = rb.noindex_source(F.col("meta.robots"), F.col("xRobotsTag"), canonical_reason() == "different_page")
    viewport = _m("viewport")
    return Family(
        "metadata",
        (
            Rule("noindex_page", F.when(source == "canonical_mismatch", "medium").otherwise("critical"), "indexability", u.is_primary_url(F.col("_p.path")) & source.isNotNull(), source),
            Rule("metadata_nofollow", "low", c, rb.flag(F.col("meta.robots"), "nofollow"), _m("robots")),
            Rule("metadata_blog_missing_max_image_preview_large", "low", c, F.col("pageType").isin("blog", "article") & (F.lower(tx.blank(rb.setting(F.col("meta.robots"), "max[-_]image[-_]preview"))) != "large"), _m("robots")),
            Rule("metadata_canonical_invalid", "medium", c, canonical_reason() != "valid", F.concat_ws(" | ", canonical_reason(), _m("canonical"))),
            Rule("metadata_og_image_missing_or_placeholder", "medium", c, placeholder_og_image(), _m("ogImage")),
            Rule("metadata_price_mismatch", "high", c, tx.price_mismatch(F.col("meta.ogPriceAmount"), F.col("textSample")), _m("ogPriceAmount")),
            Rule("metadata_html_lang_missing", "low", c, _m("htmlLang") == ""),
            Rule("metadata_charset_missing_or_late", "low", c, ~F.coalesce(F.col("meta.charsetWithinFirst1024"), F.lit(False))),
            Rule("metadata_viewport_missing", "low", c, viewport == ""),
            Rule("metadata_viewport_user_scalable_no", "medium", c, viewport.rlike(r"(?i)\buser-scalable\s*=\s*no\b"), viewport),
        ),
        F.col("status") == 200,
        240,
    )


def metadata_summary() -> Column:
    """Six facts of a page's metadata in one struct; pages are prepared."""
    full = reduce(lambda a, b: a & b, [_m(n) != "" for n in ("ogTitle", "ogDescription", "ogImage", "ogPriceAmount", "ogPriceCurrency", "ogAvailability")])
    viewport = _m("viewport")
    return F.struct(
        (rb.directives(F.col("meta.robots"))["noindex"] | rb.directives(F.col("xRobotsTag"))["noindex"]).alias("hasNoIndex"), (canonical_reason() == "valid").alias("isCanonicalValid"),
        (((F.col("pageType") == "product") | F.contains(F.lower(_m("ogType")), F.lit("product"))) & full).alias("hasOpenGraphProductData"), tx.price_mismatch(F.col("meta.ogPriceAmount"), F.col("textSample")).alias("ogPriceMismatch"),
        ((tx.trimmed(viewport) == "") | viewport.rlike(r"(?i)\buser-scalable\s*=\s*no\b")).alias("hasViewportIssue"), F.size(F.filter("meta.alternates", lambda a: tx.blank(a["hreflang"]) != "")).alias("hreflangCount"),
    )


def indexability() -> Family:
    c, rules = "indexability", []
    for name, value in (("x_robots_tag", F.col("xRobotsTag")), ("meta_robots", F.col("meta.robots"))):
        d, shown = rb.directives(value), tx.blank(value)
        limit, preview, video = (tx.blank(d[k]) for k in ("max_snippet", "max_image_preview", "max_video_preview"))
        rules += [
            Rule(f"{name}_nosnippet", "recommended", c, d["nosnippet"], shown), Rule(f"{name}_noarchive", "recommended", c, d["noarchive"], shown),
            Rule(f"{name}_noimageindex", "low", c, d["noimageindex"], shown), Rule(f"{name}_max_snippet_limited", "recommended", c, (limit != "") & (limit != "-1"), shown),
            Rule(f"{name}_max_image_preview_restricted", "recommended", c, F.lower(preview).isin("none", "standard"), shown),
            Rule(f"{name}_max_video_preview_limited", "recommended", c, (video != "") & (video != "-1"), shown),
            Rule(f"{name}_unavailable_after", "high", c, d["unavailable_after"].isNotNull(), shown),
            Rule(f"{name}_noindex", "high", c, d["noindex"], shown), Rule(f"{name}_nofollow", "low", c, d["nofollow"], shown),
        ]
    text, target = tx.clean(F.col("meta.canonical")), F.col("indexability.canonicalTarget")
    rules += [
        Rule("canonicalized_url", "medium", c, (target != "") & ~F.col("indexability.selfReferencing"), target),
        Rule("invalid_canonical_url", "medium", c, (text != "") & (target == ""), text),
    ]
    return Family("indexability", tuple(rules), F.col("status") < 400)


def hreflang() -> Family:
    """A page can have several issues of one code: one for each faulty link, one for each repeated value."""
    c, own = "metadata", F.filter("meta.alternates", lambda a: (a["hreflang"] != "") | F.lower(a["type"]).isin("", "text/html"))
    http = r"(?i)^(https?:)?//[^/\s]+|^[^:]*$"
    value = r"(?i)^(x-default|[a-z]{2,3}(-[a-z0-9]{2,8})*)$"

    def each(items: Column, code: str, severity: str = "medium") -> Column:
        return F.transform(items, lambda a: issue(code, severity, c, F.concat_ws(" ", a["hreflang"], a["href"])))

    values = F.transform(F.filter(own, lambda a: a["hreflang"] != ""), lambda a: F.lower(a["hreflang"]))
    repeated = F.filter(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)) > 1)
    good = F.filter(own, lambda a: (a["href"] != "") & a["href"].rlike(http) & a["hreflang"].rlike(value))
    target = F.when(F.col("indexability.canonicalTarget") != "", F.col("indexability.canonicalTarget")).otherwise(u.normalized(F.col("_p"), "compare", F.lit("")))
    origin = F.col("_p.origin")

    def resolved(href: Column) -> Column:
        whole = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.col("_p.scheme"), F.lit(":"), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, F.lit("/"), href))
        return F.regexp_replace(F.regexp_replace(whole, r"[?#].*$", ""), r"(?<=[^/:])/$", "")

    bare = F.regexp_replace(target, r"(?<=[^/:])/$", "")
    lonely = (F.size(good) > 0) & ~F.exists(good, lambda a: resolved(a["href"]) == bare)
    return Family(
        "hreflang",
        (Rule("hreflang_self_reference_missing", "recommended", c, lonely, target),),
        many=(
            each(F.filter(own, lambda a: a["href"] == ""), "hreflang_missing_href"),
            each(F.filter(own, lambda a: (a["href"] != "") & ~a["href"].rlike(http)), "hreflang_invalid_url"),
            each(F.filter(own, lambda a: a["hreflang"] == ""), "hreflang_missing_value"),
            each(F.filter(own, lambda a: (a["hreflang"] != "") & ~a["hreflang"].rlike(value)), "hreflang_invalid_value"),
            F.transform(repeated, lambda v: issue("hreflang_duplicate_value", "medium", c, v)),
        ),
    )


def speed() -> Family:
    c = "page_speed"

    def tiers(code: str, column: str, high: int, low: int) -> Rule:
        x = F.col(f"speed.{column}")
        return Rule(code, F.when(x > high, "medium").otherwise("recommended"), c, x > low, F.concat(F.lit(f"{column}="), x.cast("string")), x)

    def over(code: str, column: str, most: int) -> Rule:
        x = F.col(f"speed.{column}")
        return Rule(code, "recommended", c, x > most, F.concat(F.lit(f"{column}="), x.cast("string")), x)

    shown = F.col("pageType").isin("home", "product", "collection")
    late, priority = F.coalesce(F.col("speed.primaryImageLazy"), F.lit(False)), F.lower(tx.blank(F.col("speed.primaryImageFetchPriority")))
    return Family(
        "speed",
        (
            tiers("html_size_large", "htmlSizeKb", 1000, 500), tiers("dom_size_large", "domElementCount", 3000, 1500), tiers("script_count_high", "scriptCount", 60, 35),
            over("stylesheet_count_high", "stylesheetCount", 15), over("render_blocking_stylesheets", "renderBlockingStylesheetCount", 10),
            tiers("third_party_script_count_high", "thirdPartyScriptCount", 12, 6), tiers("shopify_app_script_count_high", "shopifyAppScriptCount", 8, 4),
            tiers("image_count_high", "imageCount", 80, 40), over("large_image_url_width", "largeImageUrlCount", 6),
            Rule("primary_image_lazy_loaded", "medium", c, shown & late),
            Rule("preload_missing_for_primary_image", "recommended", c, shown & ~late & (priority != "high") & (F.col("speed.preloadedImageCount") == 0)),
        ),
        evidence_length=260,
    )


def _image_facts(image: Column) -> Column:
    """What the rules ask of an image, each fact once; ``normal`` and ``words`` are those of its alternative text."""
    alt, name = tx.blank(image["alt"]), img.filename(image["src"])
    base = F.struct(alt.alias("alt"), tx.normal(alt).alias("normal"), name.alias("name"))
    return u.bound(base, lambda b: F.struct(
        image["src"].alias("src"), b["alt"].alias("alt"), b["normal"].alias("normal"), img.alt_words(b["normal"]).alias("words"), (F.length(b["alt"]) > 125).alias("long"),
        tx.matches_any(tx.trimmed(b["alt"]), img.GENERIC_ALT).alias("generic"), tx.matches_any(b["name"], img.GENERIC_FILE).alias("poor_file"),
        ((tx.blank(image["width"]) == "") | (tx.blank(image["height"]) == "")).alias("unsized"), img.on_product(image).alias("own"), img.may_load_late(image).alias("may_wait"),
        img.has_priority(image).alias("first"), F.coalesce(image["lazy"], F.lit(False)).alias("lazy"),
    ))


def _page_image_facts(seen: Column, name_words: Column) -> Column:
    """What the rules ask of a page: sources of its images of each kind, repeated texts, and whether one of them stands in for variants."""
    src = lambda which: F.transform(F.filter(seen, which), lambda i: i["src"])
    alts = F.transform(F.filter(seen, lambda i: (i["alt"] != "") & (i["normal"] != "")), lambda i: i["normal"])
    repeated = u.bound(alts, lambda all_alts: F.filter(F.array_distinct(all_alts), lambda a: F.size(F.filter(all_alts, lambda x: x == a)) > 1))
    waiting = F.filter(seen, lambda i: i["may_wait"])
    late = F.filter(F.slice(F.filter(waiting, lambda i: ~i["first"]), 2, 1 << 20), lambda i: ~i["lazy"])

    def fallback(a: Column) -> Column:
        share = F.size(F.filter(name_words, lambda w: F.array_contains(img.alt_words(a), w))) / F.greatest(F.size(name_words), F.lit(1))
        return (F.size(name_words) >= 2) & (F.size(F.filter(seen, lambda i: (i["normal"] == a) & i["own"])) >= 3) & (F.size(F.array_distinct(img.alt_words(a))) >= 2) & (share >= 0.7)

    return u.bound(repeated, lambda again: F.struct(
        src(lambda i: (i["alt"] != "") & (F.size(i["words"]) < 2)).alias("short"), src(lambda i: i["long"]).alias("long"), src(lambda i: (i["alt"] != "") & i["generic"]).alias("generic"), again.alias("repeated"),
        F.exists(again, fallback).alias("fallback"), src(lambda i: (i["alt"] != "") & i["own"] & ~F.arrays_overlap(i["words"], name_words)).alias("unnamed"), (F.size(name_words) > 0).alias("named"),
        src(lambda i: i["poor_file"]).alias("files"), src(lambda i: i["unsized"]).alias("unsized"), F.size(waiting).alias("waiting"), F.transform(late, lambda i: i["src"]).alias("late"),
    ))


def images() -> Family:
    c, product = "images", F.col("pageType") == "product"
    words = tx.meaningful(F.when(_h1() != "", _h1()).otherwise(_m("title")), img.ALT_STOP)
    found = u.bound(F.struct(F.transform("images", _image_facts).alias("seen"), words.alias("words")), lambda x: _page_image_facts(x["seen"], x["words"]))

    def some(code: str, name: str, when: Column | None = None) -> Rule:
        items = F.col(f"_f.page.{name}")
        there = F.size(items) > 0
        return Rule(code, "recommended", c, there if when is None else when & there, _join(items), F.size(items))

    return Family(
        "images",
        (
            some("image_alt_too_short", "short"), some("image_alt_too_long", "long"), some("image_alt_generic", "generic"), some("image_alt_duplicate_on_page", "repeated"),
            Rule("shopify_variant_auto_alt_duplicate", "recommended", c, product & F.col("_f.page.fallback"), _join(F.col("_f.page.repeated"))),
            some("product_image_alt_missing_product_name", "unnamed", product & F.col("_f.page.named")), some("image_filename_not_descriptive", "files"), some("image_missing_dimensions", "unsized"),
            some("lazy_loading_missing", "late", F.col("_f.page.waiting") > 1),
        ),
        F.size("images") > 0,
        240,
        facts={"page": found},
    )


def _searchable() -> Column:
    joined = [F.array_join(F.col(f"headings.{h}"), " ") for h in ("h1", "h2", "h3")]
    return F.concat_ws(" ", _m("title"), _m("description"), *joined, tx.blank(F.col("textSample")), F.array_join(F.transform("links", lambda x: x["text"]), " "))


def product() -> Family:
    text, words = _searchable(), F.col("wordCount")
    in_stock = _m("ogAvailability").rlike(OG_IN_STOCK) | F.regexp_extract(text, IN_STOCK, 0).rlike(OG_IN_STOCK)
    cleaned = u.clean_product_url(F.col("_p"))
    canonical = u.normalized(F.col("_canonical"), "compare", F.lit(""))
    apps = F.exists("shopify.detectedApps", lambda a: a.rlike(REVIEW_APPS))
    many = F.size(F.filter("links", lambda x: x["internal"] & F.contains(x["href"], F.lit("/products/"))))
    return Family(
        "product",
        (
            Rule("duplicate_product_url_bad_canonical", "high", "shopify", cleaned.isNotNull() & F.coalesce((_m("canonical") == "") | (canonical != cleaned), F.lit(True)), _m("canonical")),
            Rule("thin_product_content", "medium", "content", words < 150, metric=words), Rule("product_images_missing", "medium", "images", F.size("images") == 0),
            Rule("product_description_too_short", "medium", "content", words < 250, metric=words), Rule("product_missing_material_info", "recommended", "content", ~tx.matches_any(text, MATERIAL)),
            Rule("product_missing_size_info", "recommended", "content", ~tx.matches_any(text, SIZES)), Rule("product_missing_care_info", "recommended", "content", ~tx.matches_any(text, CARE)),
            Rule("product_missing_review_signals", "recommended", "content", ~tx.matches_any(text, REVIEW) & ~F.coalesce(apps, F.lit(False))),
            Rule("product_missing_faq_content", "recommended", "content", ~tx.matches_any(text, FAQ)),
            Rule("product_sold_out_indexable", "medium", "shopify", text.rlike(SOLD_OUT) & ~in_stock & F.col("indexability.indexable"), F.regexp_extract(text, SOLD_OUT, 0)),
            Rule("product_low_image_count", "recommended", "images", F.size("images") < 3, metric=F.size("images")),
            Rule("product_variant_title_duplicate_risk", "recommended", "shopify", many > 5, metric=many),
        ),
        (F.col("pageType") == "product") & (F.col("status") == 200),
    )


def collection(settings: Settings = Settings()) -> Family:
    title = tx.without_brand(_m("title"), settings.brands)
    handles = F.filter(F.transform("links", lambda x: F.regexp_extract(x["href"], r"^[^?#]*?/products/([^/?#]+)", 1)), lambda h: h != "")
    total, different = F.size(handles), F.size(F.array_distinct(handles))
    pattern = r"(?i)[?&](?:sort_by|filter\.[^=&]*|page)=" if settings.match_real_filter_params else r"(?i)[?&](?:sort_by|filter\.|page)="
    sorted_links = F.filter("links", lambda x: x["rawHref"].rlike(pattern))
    path = F.col("_p.path")
    return Family(
        "collection",
        (
            Rule("thin_collection_content", "medium", "content", F.col("wordCount") < 100, metric=F.col("wordCount")),
            Rule("collection_title_too_generic", "recommended", "metadata", tx.matches_any(title, GENERIC_COLLECTION) | tx.matches_any(_h1(), GENERIC_COLLECTION), title),
            Rule("collection_meta_description_boilerplate", "recommended", "metadata", tx.matches_any(F.col("meta.description"), COLLECTION_BOILERPLATE), _m("description")),
            Rule("collection_missing_faq_content", "recommended", "content", ~tx.matches_any(F.col("textSample"), COLLECTION_FAQ)),
            Rule("collection_no_product_links", "high", "shopify", total == 0),
            Rule("collection_excessive_duplicate_product_links", "recommended", "shopify", (total >= 10) & (different / F.greatest(total, F.lit(1)) < 0.5), metric=total),
            Rule("collection_sort_filter_links_crawlable", "recommended", "faceted_navigation", F.size(sorted_links) > 0, _join(F.transform(sorted_links, lambda x: x["rawHref"])), F.size(sorted_links)),
            Rule("thin_collection_product_count", "medium", "shopify", path.startswith("/collections/") & (different <= 1), metric=different),
            Rule("indexable_collection_tag_url", "medium", "shopify", F.coalesce(u.is_tag_url(path), F.lit(False)) & ~F.contains(F.lower(_m("robots")), F.lit("noindex")), _m("robots")),
        ),
        F.col("pageType") == "collection",
        500,
    )


def blog() -> Family:
    elsewhere = F.exists("links", lambda x: x["internal"] & (x["href"] != F.col("finalUrl")))
    return Family(
        "blog",
        (Rule("thin_article", "medium", "content", F.col("wordCount") < 500, metric=F.col("wordCount")), Rule("article_no_internal_links", "low", "internal_links", ~F.coalesce(elsewhere, F.lit(False)))),
        F.col("pageType") == "article",
    )


def facets(settings: Settings = Settings()) -> Family:
    query = (lambda x: F.regexp_extract(x["rawHref"], r"(\?[^#]*)", 1)) if settings.facets_on_raw_links else (lambda x: F.regexp_extract(x["href"], r"(\?[^#]*)", 1))
    found = F.filter("links", lambda x: u.is_faceted(query(x)))
    return Family("facets", (Rule("crawlable_faceted_urls", "medium", "faceted_navigation", F.size(found) > 0, _join(F.transform(found, lambda x: x["href"])), F.size(found)),))


def link_quality() -> Family:
    nested = r"(?i)/(?:%20|%c2%a0|&nbsp;|(?U:\s))+https?://"

    def broken(x: Column) -> Column:
        raw, cut = tx.blank(x["rawHref"]), tx.trimmed(tx.blank(x["rawHref"]))
        low = F.lower(x["href"])
        return x["internal"] & (cut != "") & (((raw != cut) & cut.rlike("(?i)^https?://")) | low.rlike(nested) | u.decoded(low).rlike(nested))

    found = F.filter("links", broken)
    return Family("links", (Rule("malformed_internal_link", "medium", "technical", F.size(found) > 0, _join(F.transform(found, lambda x: x["rawHref"])), F.size(found)),), evidence_length=300)


def families(settings: Settings = Settings()) -> list[Family]:
    """The families that concern pages that answered."""
    return [basic(), serp(settings), social(), metadata(), indexability(), hreflang(), speed(), images(), product(), collection(settings), blog(), facets(settings), link_quality()]


def page_issues(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All page rules: only the fetch rules where the answer was an error, the others elsewhere."""
    ready = prepare(pages, settings)
    return run_families(ready.filter("status < 400"), families(settings)).unionByName(run_families(ready, [fetch()]))


def fetch_failure(status: Column, error_code: Column, message: Column) -> Column:
    """The code of a failed fetch: an answer's status first, then timeout, name resolution, TLS, anything else."""
    code, low = F.upper(tx.blank(error_code)), F.lower(tx.blank(message))
    return (
        F.when(status == 403, "fetch_blocked_403").when(status == 429, "fetch_rate_limited_429").when(status >= 500, "fetch_server_error").when(status >= 400, "fetch_http_error")
        .when(code.isin("ECONNABORTED", "ETIMEDOUT", "ESOCKETTIMEDOUT") | low.rlike("timeout|timed out"), "fetch_timeout")
        .when(code.isin("ENOTFOUND", "EAI_AGAIN", "ENETUNREACH") | low.rlike("getaddrinfo|dns|name not resolved"), "fetch_dns_error")
        .when(code.isin("CERT_HAS_EXPIRED", "DEPTH_ZERO_SELF_SIGNED_CERT", "ERR_TLS_CERT_ALTNAME_INVALID", "EPROTO", "SELF_SIGNED_CERT_IN_CHAIN", "UNABLE_TO_VERIFY_LEAF_SIGNATURE") | low.rlike("certificate|ssl|tls"), "fetch_tls_error")
        .otherwise("fetch_unknown_error")
    )


def is_fetch_failure(code: Column) -> Column:
    return code.isin("fetch_failed", "http_error") | code.startswith("fetch_")


def not_in_html(source: Column) -> Column:
    """Found by an interface, a probe or a sitemap, not by a link."""
    return F.coalesce(source.isin("api_seed", "api_probe", "pagination_probe", "sitemap_unlisted"), F.lit(False))


def reachable_via(source: Column) -> Column:
    return F.when(source.isin("api_probe", "api_seed"), "api_seed").when(source == "sitemap_unlisted", "sitemap_only").when(source == "pagination_probe", "pagination_probe")
