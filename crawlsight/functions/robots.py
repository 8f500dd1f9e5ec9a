"""Robots directives and indexability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, clean
from .url import bound, form

#: Directives that are known by name (fixed values).
KNOWN = "all|index|noindex|follow|nofollow|none|nosnippet|noarchive|noimageindex|notranslate|indexifembedded|max[-_]snippet|max[-_]image[-_]preview|max[-_]video[-_]preview|unavailable[-_]after"
#: A user agent before a directive; a directive that takes a value is none.
_AGENT = r"(?:(?!(?:max[-_]snippet|max[-_]image[-_]preview|max[-_]video[-_]preview|unavailable[-_]after)\s*:)[^,:]+:\s*)?"


def flag(value: Column, names: str) -> Column:
    return blank(value).rlike(rf"(?i)(?:^|,)\s*{_AGENT}(?:{names})\s*(?:,|:|$)")


def setting(value: Column, name: str) -> Column:
    """The last value given for a directive, or null."""
    found = F.regexp_extract_all(blank(value), F.lit(rf"(?i)(?:^|,)\s*{_AGENT}{name}\s*:\s*([^,]*)"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def unavailable_after(value: Column) -> Column:
    """A date, commas of its own included unless an agent stands before the directive."""
    plain = F.regexp_extract(blank(value), rf"(?i)(?:^|,)\s*unavailable[-_]after\s*:\s*(.+?)\s*(?:,\s*(?:{KNOWN})\b.*)?$", 1)
    agent = F.regexp_extract(blank(value), r"(?i)(?:^|,)\s*[^,:]+:\s*unavailable[-_]after\s*:\s*([^,]*)", 1)
    return F.when(plain != "", plain).when(agent != "", F.trim(agent))


def directives(value: Column) -> Column:
    return F.struct(
        flag(value, "noindex|none").alias("noindex"), flag(value, "nofollow|none").alias("nofollow"), flag(value, "nosnippet").alias("nosnippet"),
        flag(value, "noarchive").alias("noarchive"), flag(value, "noimageindex").alias("noimageindex"), setting(value, "max[-_]snippet").alias("max_snippet"),
        setting(value, "max[-_]image[-_]preview").alias("max_image_preview"), setting(value, "max[-_]video[-_]preview").alias("max_video_preview"),
        unavailable_after(value).alias("unavailable_after"),
    )


def expired(date: Column, as_of: Column) -> Column:
    """Dates that don't parse never expire."""
    plain = F.trim(F.regexp_replace(date, r"^[A-Za-z]+,\s*", ""))
    formats = ("d MMM yyyy HH:mm:ss z", "d-MMM-yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats]) <= as_of, F.lit(False))


def summary(status: Column, robots: Column, header: Column, canonical: Column, final_url: Column, as_of: Column) -> Column:
    """struct<indexable, status, canonicalTarget, selfReferencing>; the first reason that holds."""
    meta, head = directives(robots), directives(header)
    target = F.when(clean(canonical) == "", "").otherwise(form(clean(canonical), "compare", F.lit(""), final_url))
    keys = F.struct(target.alias("target"), form(final_url, "compare", F.lit("")).alias("own"))

    def state(k: Column) -> Column:
        return (
            F.when(status >= 400, "http_error").when(head["noindex"], "noindex_x_robots_tag").when(meta["noindex"], "noindex_meta_robots")
            .when(expired(head["unavailable_after"], as_of), "unavailable_after_x_robots_tag").when(expired(meta["unavailable_after"], as_of), "unavailable_after_meta_robots")
            .when((k["target"] != "") & (k["target"] != k["own"]), "canonicalized").otherwise("indexable")
        )

    def told(k: Column) -> Column:
        return bound(state(k), lambda s: F.struct((s == "indexable").alias("indexable"), s.alias("status"), k["target"].alias("canonicalTarget"), (k["target"] == k["own"]).alias("selfReferencing")))

    return bound(keys, told)


def noindex_source(robots: Column, header: Column, canonical_differs: Column) -> Column:
    return F.when(flag(robots, "noindex|none"), "meta_robots").when(flag(header, "noindex|none"), "x_robots_tag").when(canonical_differs, "canonical_mismatch")
