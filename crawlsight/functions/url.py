"""URLs as browsers read them, in native expressions: no address reaches Python.

``take_apart`` is the same in Python, for code that stands in Python anyway (the parse of pages).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = T.StructType(
    [
        T.StructField("href", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("scheme", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("valid", T.BooleanType()),
    ]
)
#: Schemes whose addresses have a host and a path, and their usual ports (fixed values).
_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
#: Scheme, authority, path and query of an address that others can be relative to.
_BASE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Characters that stay as they are in paths and in queries, besides letters and digits.
_PATH_KEPT, _QUERY_KEPT = "/%:@!$&'()*+,;=-._~[]|^\\", "/?%:@!$&()*+,;=-._~[]|^{}`"
#: What no host may hold, but for the brackets of an IPv6 address.
_NO_HOST = r"[\x00-\x20\x7f<>^|%#/:?@\[\\\]]"
_V6 = r"^\[[0-9a-f:.]+\]$"
_INVALID = (None, None, None, None, None, None, False)

# In Python


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/".join(out) or "/"


def _joined(text: str, base: str | None) -> str | None:
    """``text`` as an absolute address, or None."""
    if re.match(_SCHEME, text):
        return text
    at = re.match(_BASE, base or "")
    if at is None:
        return None
    scheme, authority, path, query = at[1], at[2], at[3], at[4] or ""
    if scheme[:-1].lower() in _PORTS:
        head = re.match("[^?#]*", text)[0]
        text = head.replace("\\", "/") + text[len(head) :]
    if text.startswith("//"):
        return scheme + text
    root = f"{scheme}//{authority}"
    if text.startswith("/"):
        return root + text
    if text == "" or text.startswith("#"):
        return root + path + query + text
    return root + (path if text.startswith("?") else path[: path.rfind("/") + 1] or "/") + text


def take_apart(url: str | None, base: str | None = None) -> tuple:
    """(href, origin, scheme, host, path, query, valid) with the hash dropped from none but ``href``."""
    if url is None:
        return _INVALID
    text = _joined(re.sub(r"[\t\r\n]", "", re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", url)), base)
    if text is None:
        return _INVALID
    scheme, _, rest = text.partition(":")
    scheme = scheme.lower()
    head = re.match("[^?#]*", rest)[0]
    tail = rest[len(head) :].partition("#")
    query, mark = tail[0], tail[1] + tail[2] if tail[2] else ""
    query = query if len(query) > 1 else ""
    if scheme not in _PORTS:
        authority = head[2:].partition("/")[0] if head.startswith("//") else ""
        host = re.sub(":[0-9]*$", "", authority.rpartition("@")[2]).lower()
        return (text, "null", scheme, host, head[2 + len(authority) :] if head.startswith("//") else head, query, True)
    authority, _, path = head.replace("\\", "/").lstrip("/").partition("/")
    authority = authority.rpartition("@")[2]
    port = re.search(":([0-9]*)$", authority)
    host = re.sub(":[0-9]*$", "", authority).lower()
    if not host or not (re.search(_V6, host) if host.startswith("[") else not re.search(_NO_HOST, host)):
        return _INVALID
    number = int(port[1]) if port and port[1] else None
    if number is not None and (len(port[1]) > 9 or number > 65535):
        return _INVALID
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return _INVALID
    origin = f"{scheme}://{host}" + (f":{number}" if number is not None and number != _PORTS[scheme] else "")
    path = quote(_dots(f"/{path}"), safe=_PATH_KEPT)
    query = quote(query, safe=_QUERY_KEPT)
    return (origin + path + query + mark, origin, scheme, host, path, query, True)


# As expressions

#: Addresses in which nothing has to be folded, escaped or resolved, if no segment is dots. No group is repeated, as Java would repeat it by recursion.
_PLAIN = r"^https?://[a-z0-9.-]++(?:/[A-Za-z0-9._~!$&()*+,;=:@/-]*+)?+(?:\?[A-Za-z0-9._~!$&()*+,;=:@/-]++)?+\z"
_DOT_SEGMENT = r"/(?:\.|%2[eE]){1,2}(?:[/?]|\z)"

# What follows is SQL text, which is read far faster than as many calls would be made.


def _r(pattern: str) -> str:
    """A pattern as a literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(value: str, name: str, use: str) -> str:
    """``use``, in which ``name`` stands for a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _first(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {_r(pattern)}, {group})"


def _less(text: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({text}, {_r(pattern)}, {by})"


def _named(*values: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(PARTS.names, (*values, "true"), strict=True)) + ")"


def _is_plain(text: str) -> str:
    return f"({text} RLIKE {_r(_PLAIN)} AND NOT {text} RLIKE {_r(_DOT_SEGMENT)})"


def _plain_parts(text: str) -> str:
    origin, path, query = _first(text, "^(https?://[^/?]+)"), _first(text, "^https?://[^/?]+([^?]*)"), _first(text, r"(\?.*)$")
    path = f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"
    return _named(f"concat({origin}, {path}, {query})", origin, _first(text, "^(https?):"), _first(text, "^https?://([^/?]+)"), path, query)


def _resolved_dots(path: str) -> str:
    """Segments of one and two dots resolved; time grows with the square of the segments, only where there are such segments."""
    dots = lambda x: f"regexp_replace({x}, '%2[eE]', '.')"
    stack = (
        f"aggregate(split({path}, '/'), CAST(array() AS array<string>), (o, x) -> CASE WHEN {dots('x')} = '..' THEN CASE WHEN size(o) > 1 THEN slice(o, 1, size(o) - 1) ELSE o END "
        f"WHEN {dots('x')} = '.' THEN o ELSE array_append(o, x) END)"
    )
    last = f"element_at(split({path}, '/'), -1)"
    joined = _let(stack, "o", f"array_join(CASE WHEN {dots(last)} IN ('.', '..') THEN array_append(o, '') ELSE o END, '/')")
    rooted = _let(joined, "j", "CASE WHEN j = '' THEN '/' ELSE j END")
    return f"CASE WHEN {path} RLIKE {_r(_DOT_SEGMENT)} THEN {rooted} ELSE {path} END"


def _escaped(text: str, kept: str) -> str:
    """Characters that are neither letters, digits nor ``kept`` as percent escapes of their UTF-8."""
    others = _r("[^A-Za-z0-9" + re.sub(r"([\\\[\]^-])", r"\\\1", kept) + "]")
    one = f"CASE WHEN c RLIKE {others} THEN replace(url_encode(c), '+', '%20') ELSE c END"
    return f"CASE WHEN {text} RLIKE {others} THEN array_join(transform(regexp_extract_all({text}, '(?s).', 0), c -> {one}), '') ELSE {text} END"


def _ace(host: str) -> str:
    """A host with letters beyond ASCII in the form that the network uses, label by label (RFC 3492). Compatibility forms aren't folded."""
    digit = lambda d: f"substring('abcdefghijklmnopqrstuvwxyz0123456789', CAST({d} AS INT) + 1, 1)"
    weight = "greatest(1L, least(26L, k * 36 - bias))"
    number = (  # a delta in digits of variable weight
        "transform(array(x.bias), bias -> aggregate(sequence(1L, 8L), named_struct('q', delta, 'on', true, 's', ''), (y, k) -> CASE WHEN NOT y.on THEN y "
        f"WHEN y.q < {weight} THEN named_struct('q', y.q, 'on', false, 's', concat(y.s, {digit('y.q')})) "
        f"ELSE named_struct('q', (y.q - {weight}) div (36 - {weight}), 'on', true, 's', concat(y.s, {digit(f'{weight} + (y.q - {weight}) % (36 - {weight})')})) END, y -> y.s))[0]"
    )
    start = "(delta div CASE WHEN x.done = x.basic THEN 700L ELSE 2L END)"
    adapted = (
        f"aggregate(sequence(1, 6), named_struct('d', {start} + {start} div (x.done + 1), 'k', 0L), (y, i) -> CASE WHEN y.d > 455 THEN named_struct('d', y.d div 35, 'k', y.k + 36) ELSE y END, "
        "y -> y.k + y.d * 36 div (y.d + 38))"
    )
    state = lambda delta, bias, done, out: f"named_struct('n', r.m + r.last, 'delta', {delta}, 'bias', {bias}, 'done', {done}, 'basic', x.basic, 'out', {out})"
    delta = "x.delta + CASE WHEN r.first THEN (r.m - x.n) * (x.done + 1) ELSE 0L END + CASE WHEN r.c < r.m THEN 1L ELSE 0L END"
    step = _let(delta, "delta", f"CASE WHEN r.c = r.m THEN {state('r.last', adapted, 'x.done + 1', f'concat(x.out, {number})')} ELSE {state('delta + r.last', 'x.bias', 'x.done', 'x.out')} END")
    rounds = (
        "flatten(transform(array_sort(array_distinct(filter(points, c -> c > 127))), m -> transform(points, (c, i) -> "
        "named_struct('m', m, 'c', c, 'first', i = 0, 'last', CASE WHEN i = size(points) - 1 THEN 1L ELSE 0L END))))"
    )
    begin = "named_struct('n', 128L, 'delta', 0L, 'bias', 72L, 'done', CAST(length(b) AS BIGINT), 'basic', CAST(length(b) AS BIGINT), 'out', CASE WHEN b = '' THEN '' ELSE concat(b, '-') END)"
    coded = _let("transform(regexp_extract_all(l, '(?s).', 0), c -> CAST(ascii(c) AS BIGINT))", "points", _let(_less("l", r"[^\x00-\x7f]"), "b", f"aggregate({rounds}, {begin}, (x, r) -> {step}, x -> x.out)"))
    folded = f"regexp_replace(replace(replace({host}, 'ß', 'ss'), 'ς', 'σ'), '[。．｡]', '.')"
    return f"array_join(transform(split({folded}, '[.]'), l -> CASE WHEN l RLIKE {_r('[^\\x00-\\x7f]')} THEN concat('xn--', {coded}) ELSE l END), '.')"


_WEB = "(" + ", ".join(f"'{x}'" for x in _PORTS) + ")"


def _web(idn: bool) -> str:
    """The parts of ``s``, an address of one of the usual schemes."""
    head = _less("translate(s.head, chr(92), '/')", "^/+")
    authority = _less(_first("h", "^[^/]*", 0), "^.*@")
    labels = r"split(regexp_replace(shown, '[.]$', ''), '[.]')"
    mixed = f"exists(split(w.host, '[.]'), l -> startswith(l, 'xn--') AND l RLIKE {_r('[^\\x00-\\x7f]')})"
    fits = f"CASE WHEN startswith(w.host, '[') THEN w.host RLIKE {_r(_V6)} ELSE w.host <> '' AND NOT w.host RLIKE {_r(_NO_HOST)} AND NOT {mixed} END"
    short = f"length(w.port) <= 9 AND coalesce(try_cast(w.port AS INT), 0) <= 65535 AND (w.host = shown OR NOT exists({labels}, l -> l = '' OR length(l) > 63))"
    usual = "map(" + ", ".join(f"'{n}', {p}" for n, p in _PORTS.items()) + ")"
    port = f"CASE WHEN try_cast(w.port AS INT) <> {usual}[s.scheme] THEN concat(':', try_cast(w.port AS INT)) ELSE '' END"
    shown = f"CASE WHEN w.host RLIKE {_r('[^\\x00-\\x7f]')} THEN {_ace('w.host')} ELSE w.host END" if idn else "w.host"
    whole = f"named_struct('origin', concat(s.scheme, '://', shown, {port}), 'path', {_escaped(_let('w.path', 'p', _resolved_dots('p')), _PATH_KEPT)}, 'query', {_escaped('s.query', _QUERY_KEPT)})"
    use = _let(whole, "k", _named("concat(k.origin, k.path, k.query, s.mark)", "k.origin", "s.scheme", "shown", "k.path", "k.query"))
    pieces = f"named_struct('port', {_first('a', ':([0-9]*)$')}, 'host', lower({_less('a', ':[0-9]*$')}), 'path', concat('/', {_first('h', '^[^/]*/(.*)$')}))"
    return _let(head, "h", _let(authority, "a", _let(pieces, "w", _let(shown, "shown", f"CASE WHEN {fits} AND {short} THEN {use} END"))))


def _other() -> str:
    host = f"lower({_less(_less(_first('s.head', '^//([^/]*)'), '^.*@'), ':[0-9]*$')})"
    return _named("t", "'null'", "s.scheme", host, _less("s.head", "^//[^/]*"), "s.query")


def _absolute() -> str:
    """``t`` as an absolute address against ``z.b``, or null."""
    head = _first("t", "^[^?#]*", 0)
    own = f"CASE WHEN lower(regexp_extract(r.scheme, '^[^:]*', 0)) IN {_WEB} THEN concat(translate({head}, chr(92), '/'), substring(t, length({head}) + 1)) ELSE t END"
    folder = _first("r.path", "^(.*/)")
    joined = (
        "CASE WHEN startswith(o, '//') THEN concat(r.scheme, o) WHEN startswith(o, '/') THEN concat(r.scheme, '//', r.authority, o) WHEN o = '' OR startswith(o, '#') THEN concat(r.scheme, '//', r.authority, r.path, r.query, o) "
        f"WHEN startswith(o, '?') THEN concat(r.scheme, '//', r.authority, r.path, o) ELSE concat(r.scheme, '//', r.authority, CASE WHEN {folder} = '' THEN '/' ELSE {folder} END, o) END"
    )
    taken = "named_struct(" + ", ".join(f"'{n}', {_first('z.b', _BASE, i)}" for i, n in enumerate(("scheme", "authority", "path", "query"), 1)) + ")"
    against = _let(taken, "r", f"CASE WHEN r.scheme <> '' THEN {_let(own, 'o', joined)} END")
    return f"CASE WHEN t RLIKE {_r(_SCHEME)} THEN t ELSE {against} END"


def _reader(idn: bool) -> str:
    """From ``z``, a struct of an address and its base, to parts, or null."""
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
    s = f"named_struct('scheme', lower({_first('t', '^([a-zA-Z][a-zA-Z0-9+.-]*):')}), 'head', {_first('t', scheme + '([^?#]*)')}, 'query', {_first('t', r'^[^?#]*(\?[^#]+)')}, 'mark', {_first('t', '^[^#]*(#.+)$')})"
    general = _let(s, "s", f"CASE WHEN s.scheme IN {_WEB} THEN {_web(idn)} ELSE {_other()} END")
    text = _less(_less("z.u", r"^[\x00-\x20]+|[\x00-\x20]+$"), r"[\t\r\n]")
    return "z -> " + _let(_let(text, "t", _absolute()), "t", f"CASE WHEN {_is_plain('t')} THEN {_plain_parts('t')} WHEN t IS NOT NULL THEN {general} END")


_READERS = {idn: _reader(idn) for idn in (False, True)}
_NONE = "named_struct(" + ", ".join(f"'{n}', CAST(NULL AS STRING)" for n in PARTS.names[:-1]) + ", 'valid', false)"


def parts(url: Column | str, base: Column | str | None = None, idn: bool = False) -> Column:
    """The parts of a URL, of which nearly all are plain and cost a few matches; a relative one is read against ``base``.

    ``idn`` for addresses as authors write them: hosts beyond ASCII take the form
    that the network uses. Addresses that answered, and links of parsed pages, have it.
    """
    column = F.col(url) if isinstance(url, str) else url
    other = F.lit("") if base is None else F.coalesce(F.col(base) if isinstance(base, str) else base, F.lit(""))
    found = F.get(F.call_function("transform", F.array(F.struct(column.alias("u"), other.alias("b"))), F.expr(_READERS[idn])), F.lit(0))
    return F.coalesce(found, F.expr(_NONE))


def without_slash(path: Column) -> Column:
    """One trailing slash goes, but not the root's."""
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)


#: Parameters that only track visits (fixed values).
TRACKING = r"^(?i:utm_.*|fbclid|gclid|gbraid|wbraid|msclkid|ttclid|_gl)(=|$)"


def normalized(p: Column, mode: str, invalid: Column | None = None) -> Column:
    """A URL in one of the forms that analyses key on; ``invalid`` (null, if not given) for URLs that don't parse.

    page and compare: without query and hash; graph and page_query: with the
    query; sitemap: without hash only; tracking: http(s), tracking parameters
    dropped and the rest sorted.
    """
    bare = F.concat(p["origin"], without_slash(p["path"]))
    if mode in ("page", "compare"):
        out = bare
    elif mode in ("graph", "page_query"):
        out = F.concat(bare, p["query"])
    elif mode == "sitemap":
        out = F.concat(p["origin"], p["path"], p["query"])
    elif mode == "tracking":
        kept = F.array_sort(F.filter(F.split(F.substring(p["query"], 2, 1 << 20), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
        out = F.when(p["scheme"].isin("http", "https"), F.concat(bare, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))
    else:
        raise ValueError(f"no such mode: {mode}")
    if mode != "tracking":
        out = F.when(p["origin"] == "null", F.regexp_replace(p["href"], "#.*$", "")).otherwise(out)
    return F.when(p["valid"], out).otherwise(invalid if invalid is not None else F.lit(None).cast("string"))


_PATH_END = r"^https?://[a-z0-9.-]++/[A-Za-z0-9._~!$&()*+,;=:@/-]*+(?<!/)"
_ANY_QUERY = r"(?:\?[A-Za-z0-9._~!$&()*+,;=:@/-]++)?+\z"
#: Plain addresses that a mode leaves as they are.
_SETTLED = {"page": _PATH_END + r"\z", "compare": _PATH_END + r"\z", "graph": _PATH_END + _ANY_QUERY, "page_query": _PATH_END + _ANY_QUERY}


def form(url: Column | str, mode: str, invalid: Column | None = None, base: Column | str | None = None, idn: bool = False) -> Column:
    """``normalized`` straight from a URL. Nearly all addresses of a crawl are in their form already, which two matches tell."""
    column = F.col(url) if isinstance(url, str) else url
    found = bound(parts(column, base, idn), lambda p: normalized(p, mode, invalid))
    if mode not in _SETTLED:
        return found
    return F.when(column.rlike(_SETTLED[mode]) & ~column.rlike(_DOT_SEGMENT), column).otherwise(found)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def segment_after(path: Column, name: str) -> Column:
    """The segment behind the first one of that name, or null."""
    s = segments(path)
    at = F.array_position(s, F.lit(name))
    return F.when(at > 0, F.get(s, at.cast("int")))


def classify(path: Column) -> Column:
    """The page type that a path tells; the first that fits."""
    n = F.size(segments(path))
    return (
        F.when((path == "/") | (path == ""), "home")
        .when(path.startswith("/products/"), "product")
        .when(is_collection_product(path), "product")
        .when(path.startswith("/collections/"), "collection")
        .when(path.startswith("/blogs/") & (n >= 3), "article")
        .when(path.startswith("/blogs/"), "blog")
        .when(path.startswith("/pages/"), "page")
        .when(path.startswith("/policies/"), "policy")
        .when(path.startswith("/cart"), "cart")
        .when(path.startswith("/search"), "search")
        .when(path.startswith("/account"), "account")
        .otherwise("unknown")
    )


def node_type(path: Column) -> Column:
    """The type of a node of the link graph: a product under a collection counts as the collection."""
    return (
        F.when(path == "/", "home").when(path.startswith("/products/"), "product").when(path.startswith("/collections/"), "collection")
        .when(path.startswith("/blogs/"), "blog").when(path.startswith("/pages/"), "page").otherwise("other")
    )


def is_collection_product(path: Column) -> Column:
    return path.rlike(r"^/collections/[^/]+/products/[^/]+")


def clean_product_url(p: Column) -> Column:
    """Where a product below a collection lives on its own, or null."""
    return F.when(is_collection_product(p["path"]), F.concat(p["origin"], F.lit("/products/"), segment_after(p["path"], "products")))


def is_tag_url(path: Column) -> Column:
    s = segments(path)
    return (F.size(s) >= 3) & (F.get(s, 0) == "collections") & (F.get(s, 2) != "products")


def is_collection_url(path: Column) -> Column:
    s = segments(path)
    return (F.get(s, 0) == "collections") & (F.size(s) >= 2) & ~is_collection_product(path)


def is_primary_url(path: Column) -> Column:
    s = segments(path)
    return (F.size(s) == 2) & F.get(s, 0).isin("products", "collections")


def is_utility(path: Column) -> Column:
    return F.lower(path).rlike("^/(account|cart|search|checkout|password)(/|$)")


#: What starts the parameters of sorted and filtered views (fixed values).
FACETS = ("filter.", "sort_by", "view", "variant", "price", "availability", "vendor", "type", "color", "size")


def is_faceted(query: Column) -> Column:
    low = F.lower(query)
    out = F.contains(low, F.lit(FACETS[0]))
    for f in FACETS[1:]:
        out = out | F.contains(low, F.lit(f))
    return out


def strip_facets(p: Column) -> Column:
    start = "^(?i:" + "|".join(f.replace(".", r"\.") for f in FACETS) + ")"
    kept = F.filter(F.split(F.substring(p["query"], 2, 1 << 20), "&"), lambda x: (x != "") & ~x.rlike(start))
    return F.concat(p["origin"], p["path"], F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


#: What a crawl leaves out (fixed values).
SKIPPED_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".zip", ".xml", ".json")
SKIPPED_PATTERNS = (
    "/admin", "/account", "/cart", "/checkout", "/orders", "/apps/", "/challenge", "/search", "/password", "/tools/",
    "customer_posted=true", "variant=", "view=", "sort_by=", "filter.", "utm_", "fbclid", "gclid",
)


def has_skipped_pattern(url: Column) -> Column:
    return F.lower(url).rlike("|".join(re.escape(x) for x in SKIPPED_PATTERNS))


def should_skip(p: Column, base: Column, same_origin: bool = True) -> Column:
    """Whether a crawl leaves an address out."""
    return bound(F.struct(p.alias("p"), base.alias("base")), lambda x: _should_skip(x["p"], x["base"], same_origin))


def _should_skip(p: Column, base: Column, same_origin: bool) -> Column:
    low = F.lower(p["href"])
    out = ~p["valid"] | ~p["scheme"].isin("http", "https")
    if same_origin:
        out = out | (p["origin"] != base["origin"])
    for e in SKIPPED_EXTENSIONS:
        out = out | F.lower(p["path"]).endswith(e)
    for x in SKIPPED_PATTERNS:
        out = out | F.contains(low, F.lit(x))
    return F.coalesce(out, F.lit(True))


def is_asset(path: Column) -> Column:
    return path.rlike("(?i:" + "|".join(e.replace(".", r"\.") for e in SKIPPED_EXTENSIONS) + r")\z")


def decoded(text: Column) -> Column:
    """Percent escapes undone; a plus stays, and text with a bad escape stays whole."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def last_segment(path: Column) -> Column:
    return decoded(F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit("")))


def handle_text(path: Column) -> Column:
    return F.regexp_replace(last_segment(path), "[-_]+", " ")
