"""Text: cleaning, words, hashes, overlap, shopping intent and prices."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def collated(column: Column | str) -> Column:
    """A text as a sort key in the order that readers expect: case and accents come after letters."""
    return F.collate(F.col(column) if isinstance(column, str) else column, "UNICODE")


def blank(x: Column) -> Column:
    """Empty text for null."""
    return F.coalesce(x, F.lit(""))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean(x: Column) -> Column:
    """White space of any kind becomes single spaces."""
    return F.trim(F.regexp_replace(blank(x), r"(?U)\s+", " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(blank(x), F.lit(r"(?U)\S+"))


def text_hash(x: Column) -> Column:
    return F.sha1(F.lower(clean(x)))


def truncated(x: Column, n: int = 140) -> Column:
    c = clean(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def normal(x: Column) -> Column:
    """Letters and digits in lower case, single spaces between."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(blank(x), "&amp;", " and "), r"[^\p{L}\p{N}]+", " ")))


def meaningful(x: Column, stop: Iterable[str] = ()) -> Column:
    """Words of three letters and more, repeats kept."""
    words = F.filter(F.split(normal(x), " "), lambda w: F.length(w) > 2)
    stop = list(stop)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def overlaps(left: Column, right: Column) -> Column:
    """Half of the right words, repeats counted, are among the left ones; true where either has none."""
    a, b = meaningful(left), meaningful(right)
    return (F.size(a) == 0) | (F.size(b) == 0) | (F.size(F.filter(b, lambda w: F.array_contains(a, w))) / F.size(b) >= 0.5)


def matches_any(x: Column, patterns: Iterable[str]) -> Column:
    return blank(x).rlike("(?i)(?:" + "|".join(patterns) + ")")


def mentions_any(x: Column, words: Iterable[str]) -> Column:
    n = normal(x)
    return reduce(lambda a, b: a | b, [F.contains(n, F.lit(w)) for w in words])


def without_brand(title: Column, brands: Iterable[str] = ()) -> Column:
    """A brand at the end, behind a dash, goes."""
    out = title
    for brand in brands:
        out = F.regexp_replace(out, rf"(?i)\s+(?:-|\x{{2013}}|\x{{2014}})\s+{brand}\s*$", "")
    return trimmed(out)


#: Words of an offer that say nothing of what is offered, and colours (fixed values).
INTENT_STOP = ("a", "about", "all", "an", "and", "are", "at", "best", "buy", "clearance", "discount", "for", "from", "in", "just", "lowest", "men", "mens", "of", "off", "offer", "offers", "on", "online", "pack", "price", "prices", "rs", "sale", "shop", "shopping", "the", "to", "under", "with")
COLOURS = ("beige", "black", "blue", "brown", "dark", "gray", "green", "grey", "light", "maroon", "multi", "multicolor", "navy", "olive", "orange", "pink", "purple", "red", "white", "yellow")
VARIANT_COLOURS = (*COLOURS, "charcoal", "navyblue", "olivegreen")
SINGULAR = {
    "cargos": "cargo", "hoodies": "hoodie", "jackets": "jacket", "joggers": "jogger", "pants": "pant", "polos": "polo",
    "shirts": "shirt", "shorts": "short", "tshirts": "tshirt", "trunks": "trunk", "vests": "vest",
}
MODEL_CODE = r"^(?i:(?:d|j|s|os|st|vt|z|sh|cargo)\d{1,4}|\d{1,4}(?:d|j|s|os|st|vt|z|sh))$"


def intent_text(x: Column) -> Column:
    out = F.regexp_replace(F.lower(clean(x)), "&amp;", " and ")
    for pattern, to in ((r"\bt[\s-]?shirts?\b", " tshirt "), (r"\btee[\s-]?shirts?\b", " tshirt "), (r"\btrack[\s-]?pants?\b", " track pant "), (r"\bcargo[\s-]?pants?\b", " cargo pant ")):
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, "[^a-z0-9]+", " ")


def intent_tokens(x: Column, stop: Iterable[str] = INTENT_STOP) -> Column:
    singular = F.create_map(*[F.lit(v) for pair in SINGULAR.items() for v in pair])
    words = F.transform(F.filter(F.split(intent_text(x), " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(singular, w), w))
    drop = [*stop, *COLOURS]
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(drop) & ~w.rlike(r"\d"))


def intent_key(*sources: Column) -> Column:
    """The sorted different tokens, or '' for fewer than three."""
    tokens = F.array_sort(F.array_distinct(intent_tokens(F.concat_ws(" ", *[blank(s) for s in sources]))))
    return F.when(F.size(tokens) < 3, "").otherwise(F.array_join(tokens, " "))


def exact_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean(x)), "&amp;", "&"), r"\s+", " "))


def variant_attributes(*sources: Column) -> Column:
    """What tells one product from its sisters: struct<signals, attributes>."""
    source = intent_text(F.concat_ws(" ", *[blank(s) for s in sources]))
    tokens = F.filter(F.split(source, " "), lambda w: w != "")
    colours = F.filter(tokens, lambda w: w.isin(*VARIANT_COLOURS))
    codes = F.filter(tokens, lambda w: w.rlike(MODEL_CODE))
    packs = F.regexp_extract_all(source, F.lit(r"\b(pack\s+(?:of\s+)?\d+)\b"), F.lit(1))
    none = F.array().cast("array<string>")

    def word(pattern: str, name: str) -> tuple[Column, Column]:
        hit = source.rlike(pattern)
        return F.when(hit, F.array(F.lit(name + "_variant" if name != "variant_family" else name))).otherwise(none), F.when(hit, F.array(F.lit(name))).otherwise(none)

    combo, family, copy = word(r"\bcombo\b", "combo"), word(r"\b(?:variant|variants|colour|colours|color|colors)\b", "variant_family"), word(r"\bcopy\b", "copy")
    signals = F.concat(
        F.when(F.size(colours) > 0, F.array(F.lit("color_variant"))).otherwise(none),
        F.when(F.size(codes) > 0, F.array(F.lit("model_code_variant"))).otherwise(none),
        F.when(F.size(packs) > 0, F.array(F.lit("pack_variant"))).otherwise(none),
        combo[0], family[0], copy[0],
    )
    attributes = F.array_distinct(
        F.concat(
            F.transform(colours, lambda w: F.concat(F.lit("color:"), w)), F.transform(codes, lambda w: F.concat(F.lit("code:"), w)),
            F.transform(packs, lambda w: F.regexp_replace(w, r"\s+", "_")), combo[1], family[1], copy[1],
        )
    )
    return F.struct(signals.alias("signals"), attributes.alias("attributes"))


_NUMBER = r"([0-9]+(?:\.[0-9]{1,2})?)"


def price(x: Column) -> Column:
    """The first number of a text, commas aside, or null."""
    found = F.regexp_extract(F.regexp_replace(blank(x), ",", ""), _NUMBER, 1)
    return F.when(found != "", found.cast("double"))


def visible_prices(text: Column, most: int = 20) -> Column:
    """Different prices in rupees in the order of the two patterns, then of the text."""
    amount = r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
    found = F.concat(
        F.regexp_extract_all(blank(text), F.lit(rf"(?i)(?:\x{{20b9}}|rs\.?|inr)\s*{amount}"), F.lit(1)),
        F.regexp_extract_all(blank(text), F.lit(rf"(?i){amount}\s*(?:inr)"), F.lit(1)),
    )
    return F.slice(F.array_distinct(F.filter(F.transform(found, price), lambda p: p.isNotNull())), 1, most)


def price_mismatch(stated: Column, text: Column) -> Column:
    p, seen = price(stated), visible_prices(text)
    return F.coalesce(p.isNotNull() & (F.size(seen) > 0) & ~F.exists(seen, lambda v: F.abs(v - p) < 0.01), F.lit(False))
