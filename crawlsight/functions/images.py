"""Images: which need an alternative text, which belong to a product, which load late."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

#: Decoration needs no alternative text (fixed values).
DECORATION = ("logo", "icon", "payment", "placeholder", "sprite", "/preview_images/")
GENERIC_ALT = ("^image$", "^photo$", "^picture$", "^product$", "^product image$", "^untitled$", "^logo$", "^banner$", r"^img[_\-\s]?\d*$")
GENERIC_FILE = tuple(rf"^{name}\.(?:jpe?g|png|webp|gif)$" for name in (r"image[-_\d]*", r"img[-_\d]*", r"photo[-_\d]*", r"main[-_\d]*", r"\d+"))
ALT_STOP = ("the", "and", "for", "with", "men", "mens")
#: Where missing texts are mended: pattern, place, whether in bulk (fixed values).
FIX_PLACES = (
    ("/cdn/shop/files/*", "^/cdn/shop/files/", "Shopify Admin > Content > Files", False),
    ("/cdn/shop/products/*", "^/cdn/shop/products/", "Shopify Admin > Products > Media (bulk editor)", True),
    ("/cdn/shop/t/*/assets/*", "^/cdn/shop/t/[^/]+/assets/", "Theme Editor > Assets", False),
    ("anything else", "", "Manual review required", False),
)


def path_of(src: Column) -> Column:
    """The path of an absolute URL in lower case, '' for anything else."""
    return F.lower(F.regexp_extract(blank(src), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1))


def filename(src: Column) -> Column:
    own = F.regexp_replace(F.regexp_replace(blank(src), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    name = F.coalesce(F.try_element_at(F.filter(F.split(own, "/"), lambda s: s != ""), F.lit(-1)), F.lit(""))
    return F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name)


def needs_alt(src: Column) -> Column:
    low = F.lower(blank(src))
    out = ~low.startswith("data:")
    for word in DECORATION:
        out = out & ~F.contains(low, F.lit(word))
    name = F.lower(filename(src))
    return out & ~F.contains(name, F.lit("thumbnail")) & ~name.endswith(".svg")


def alt_words(normal: Column) -> Column:
    """Words of an alternative text that say something, from its normal form."""
    return F.filter(F.split(normal, " "), lambda w: (F.length(w) > 2) & ~w.isin(*ALT_STOP))


def missing_alt(image: Column) -> Column:
    return (blank(image["alt"]) == "") & needs_alt(image["src"])


def _source(image: Column) -> Column:
    return F.lower(F.concat(blank(image["src"]), F.lit(" "), blank(image["rawSrc"])))


def on_product(image: Column) -> Column:
    return _source(image).rlike("/products/|/cdn/shop/files/|/cdn/shop/products/")


def may_load_late(image: Column) -> Column:
    s, name = _source(image), F.lower(filename(image["src"]))
    bad = s.startswith("data:") | s.rlike("logo|icon|payment|placeholder|/preview_images/|sprite") | F.contains(name, F.lit("thumbnail")) | name.endswith(".svg")
    return ~bad & s.rlike("/cdn/shop/files/|/cdn/shop/products/")


def has_priority(image: Column) -> Column:
    return F.lower(blank(image["fetchPriority"])) == "high"


def is_primary(image: Column) -> Column:
    s = _source(image)
    return ~s.rlike("logo|icon|payment|/preview_images/") & s.rlike("/cdn/shop/files/|/cdn/shop/products/")


def wide(src: Column) -> Column:
    value = F.regexp_extract(blank(src), r"[?&]width=([0-9]+(?:\.[0-9]+)?)(?:&|#|$)", 1)
    return F.coalesce(F.when(value != "", value.cast("double")) >= 1600, F.lit(False))


def fix_place(src: Column) -> Column:
    path, out = path_of(src), None
    for name, pattern, _, _ in FIX_PLACES[:-1]:
        hit = path.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(FIX_PLACES[-1][0])
