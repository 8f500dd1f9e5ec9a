"""Secret scans: three base patterns, and novelty under dictionary-primed zstandard.

A candidate is a maximal run of token characters that mixes letters and digits
and reaches into the window around a sensitive word. Its marginal cost is the
compressed size of the surroundings with it, less that without it, under a
compressor primed with a dictionary: configuration words, and the identifier
parts that stand most often around sensitive words, counted over all texts.
Pieces of ``PIECE`` characters or more that the surroundings share with it are
taken out of them first, so a copy nearby doesn't make a secret cheap. Ordinary
identifiers cost little; a string that costs the model's threshold of bytes a
character or more at one place is reported as ``novel`` at each place in the text
where it is a candidate. The threshold is fitted for each dictionary on planted
random keys against identifiers composed of words, a part of them unknown to it.
Base spans always stay and carry their cost too.

Defined cases: a null or empty text has no spans; spans are counted in code
points; of one kind, spans are leftmost and don't overlap; ties in the order of
spans go by kind (assign, access, hex, novel); a candidate that overlaps a base
span isn't reported again; texts are searched whole, in time that grows with
their length; repeated rows get equal spans; without any sensitive word in the
corpus the dictionary is the fixed part alone; an empty table gives an empty
result; other columns stay.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, read_table, runs_of, slices, utf8_view

KINDS = ("assign", "access", "hex", "novel")
#: Characters before and after a sensitive word into which candidates reach, and those that a candidate is compressed with.
NEAR, AFTER, AROUND = 24, 120, 160
#: Identifier parts of the corpus in the dictionary, and the least number of letters of one.
CORPUS_WORDS, WORD_LETTERS = 2048, 4
#: Planted strings of each kind on which a threshold is fitted.
PLANTED = 300
#: The least length of a candidate, so of what may be a copy of a secret.
PIECE = 16


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_WORDS = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "credential", "private_key", "access_key", "bearer", "authorization")
_SENSITIVE = re.compile("|".join(map(_either_case, _WORDS)))
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LONG_PIECE = re.compile(r"[A-Za-z0-9+_-]{16,}")
_PART = re.compile(r"[A-Z]?[a-z]{%d,24}|[A-Z]{%d,24}" % (WORD_LETTERS - 1, WORD_LETTERS))
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True

#: What code and settings around a secret usually look like.
_DICTIONARY = " ".join(
    (
        "const let var def class return import from export function public private static final string int bool null none true false",
        "password passwd passphrase secret token api_key apikey access_key access_key_id secret_access_key private_key client_id client_secret",
        "authorization bearer credential credentials username user_name login session cookie header headers request response config settings",
        "environment env value default key name host port database connection url http https localhost example test sample placeholder changeme",
        "your_api_key_here your_secret_token xxxxxxxxxxxxxxxx 0123456789abcdef 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "get_access_token set_password reset_password_token csrf_token refresh_token id_token auth_token user_token secret_key_base",
    )
).encode()


@dataclass(frozen=True)
class Model:
    """A dictionary and the bytes a character from which a candidate is novel."""

    dictionary: bytes
    threshold: float


class Novelty:
    """Marginal compressed bytes; one compressor for each task."""

    def __init__(self, dictionary: bytes = _DICTIONARY, level: int = 6):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self._squeeze = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_dict_id=False).compress

    def cost(self, text: str, start: int, end: int) -> int:
        own, first = text[start:end], max(0, start - AROUND)
        # A copy that the edge of the surroundings cuts is seen whole, or as much of it as tells it.
        before = _without(text[max(0, first - PIECE + 1) : start], own)[min(first, PIECE - 1) :]
        after = _without(text[end : end + AROUND + PIECE - 1], own)[:AROUND]
        cost = self._added(before.replace(_GONE, ""), own, after.replace(_GONE, ""))
        if _GONE in before or _GONE in after:  # where copies were, what is left may match as a whole without the string only; between copies it doesn't
            cost = min(cost, self._added(before.rpartition(_GONE)[2], own, after.partition(_GONE)[0]))
        return cost

    def rate(self, text: str, start: int, end: int) -> tuple[int, float]:
        """The cost of a candidate, and the most bytes a character that it or a piece of it between ``=`` or ``/`` costs: a name before a key doesn't hide it."""
        cost = self.cost(text, start, end)
        best = cost / (end - start)
        for m in _LONG_PIECE.finditer(text, start, end):
            if m.end() - m.start() < end - start:
                best = max(best, self.cost(text, *m.span()) / (m.end() - m.start()))
        return cost, best

    def _added(self, before: str, own: str, after: str) -> int:
        return len(self._squeeze((before + own + after).encode())) - len(self._squeeze((before + after).encode()))


#: Stands for a character that is taken out; it isn't in any text, as UTF-8 has no surrogates.
_GONE = "\ud800"


def _without(text: str, own: str) -> str:
    """``text`` with ``_GONE`` for each character of a piece that ``own`` has too."""
    shared = [i for i in range(len(text) - PIECE + 1) if text[i : i + PIECE] in own]
    if not shared:
        return text
    out = list(text)
    for i in shared:
        out[i : i + PIECE] = _GONE * PIECE
    return "".join(out)


def hex_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans and documents of the maximal runs of 16 lower-case hexadecimal digits or more."""
    member = _HEX[raw]
    starts, ends, doc = runs_of(member, offsets)
    keep = ends - starts >= 16
    return starts[keep], ends[keep], doc[keep]


def _near(text: str) -> tuple[list[int], list[int]]:
    """Where sensitive words begin and end."""
    found = [m.span() for m in _SENSITIVE.finditer(text)]
    return [a for a, _ in found], [b for _, b in found]


def candidates(text: str) -> list[tuple[int, int]]:
    """Maximal runs that mix letters and digits and reach into the window of a sensitive word; one pass."""
    begins, ends = _near(text)
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        i = bisect_right(ends, a - AFTER)  # the first word whose window isn't over before the run
        if i < len(ends) and begins[i] - NEAR < b and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.append((a, b))
    return out


def scan(text: str, hexes: list[tuple[int, int]], lowered: str, novelty: Novelty, threshold: float) -> list[tuple[str, int, int, int]]:
    """All spans of a text as (kind, start, end, cost) in order; ``hexes`` in code points."""
    base: list[tuple[str, int, int]] = []
    sensitive = any(w in lowered for w in _WORDS)
    if sensitive:
        base += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [("hex", a, b) for a, b in hexes]
    found = [(k, a, b, novelty.cost(text, a, b)) for k, a, b in base]
    if sensitive:
        taken = _merged([(a, b) for _, a, b in base])
        starts = [a for a, _ in taken]
        measured = []
        for a, b in candidates(text):
            i = bisect_right(starts, b - 1) - 1  # the last base span that begins before the run ends
            if i < 0 or taken[i][1] <= a:
                measured.append((a, b, *novelty.rate(text, a, b)))
        novel = {text[a:b] for a, b, _, rate in measured if rate >= threshold}
        found += [("novel", a, b, cost) for a, b, cost, _ in measured if text[a:b] in novel]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def primed(words: list[str]) -> bytes:
    """The dictionary: the corpus' words, the most frequent ones last, where zstandard reaches them most cheaply, behind the fixed part."""
    both = dict.fromkeys(x for w in words for x in (w, w.lower(), w.capitalize()))
    return _DICTIONARY + b" " + " ".join(reversed(both)).encode()


def planted(words: list[str], n: int, seed: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Random keys and identifiers, each in a line with a sensitive word: ``(line, start, end)``."""
    rng = np.random.default_rng(seed)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    known = [w for w in words if w.isalpha()] or ["value"]
    lines = ["the bearer {} was used", "credential {} is set", "use the api-key {} for this host", "authorization {}", "set passphrase ({}) in the settings", "private_key <{}>"]

    def unknown() -> str:
        return "".join(rng.choice(list("bcdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 4))))

    def key() -> str:
        while True:
            own = "".join(rng.choice(list(alphabets[int(rng.integers(0, len(alphabets)))]), int(rng.integers(PIECE, 49))))
            if any(c.isdigit() for c in own) and any(c.isalpha() for c in own):
                return own

    def name() -> str:
        while True:
            parts = [str(rng.choice(known)).lower() if rng.random() < 0.8 else unknown() for _ in range(int(rng.integers(3, 7)))]
            style = int(rng.integers(0, 4))
            own = parts[0] + "".join(p.capitalize() for p in parts[1:]) if style == 0 else ("_", "-", "/")[style - 1].join(parts)
            own += ("", "_")[style == 1] + str(int(rng.integers(0, 100)))
            if len(own) >= PIECE:
                return own

    def lined(own: str) -> tuple[str, int, int]:
        before, after = str(rng.choice(lines)).split("{}")
        around = [" ".join(rng.choice(known, int(rng.integers(0, 15)))) for _ in range(2)]
        start = len(around[0]) + 1 + len(before)
        return f"{around[0]} {before}{own}{after} {around[1]}", start, start + len(own)

    return [lined(key()) for _ in range(n)], [lined(name()) for _ in range(n)]


def calibrated(words: list[str], seed: int = 11) -> Model:
    """The threshold with the fewest mistakes on planted strings, in the middle of the gap."""
    fixed = sorted({w for w in re.findall("[a-z]+", _DICTIONARY.decode()) if len(w) >= WORD_LETTERS})
    dictionary = primed(words)
    novelty = Novelty(dictionary)
    keys, names = planted(words or fixed, PLANTED, seed)
    rate = np.array([novelty.rate(t, a, b)[1] for t, a, b in [*keys, *names]])
    secret = np.arange(len(rate)) < len(keys)
    order = np.argsort(rate, kind="stable")
    rate, secret = rate[order], secret[order]
    missed = np.concatenate([[0], np.cumsum(secret)]) + np.concatenate([np.cumsum(~secret[::-1])[::-1], [0]])  # by the number of strings under the cut
    at = np.flatnonzero(missed == missed.min())
    at = int(at[len(at) // 2])
    return Model(dictionary, float((rate[max(0, at - 1)] + rate[min(at, len(rate) - 1)]) / 2))


def _words_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifier parts around sensitive words, counted."""
    count: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
        count.clear()
        return rows

    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            lowered = (text or "").lower()
            if not any(w in lowered for w in _WORDS):
                continue
            done = 0
            for a, b in zip(*_near(text), strict=True):
                a = max(a - AROUND, done)
                done = max(done, min(len(text), b + AROUND))
                count.update(_PART.findall(text, a, done))
        if len(count) > 50_000:
            yield flush()
    yield flush()


def fit(df: DataFrame, text: str = "text") -> Model:
    """The dictionary of a corpus and its threshold; only ``CORPUS_WORDS`` words reach the driver."""
    found = in_batches(df).select(F.col(f"`{text}`").alias("text")).mapInArrow(_words_worker, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(CORPUS_WORDS)
    return calibrated([r["word"] for r in top.collect()])


@functools.cache
def default_model() -> Model:
    return calibrated([])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.int64())])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "end", "cost")]]))


def _worker(columns: list[str], text: str, out: str, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(model.dictionary)
        for batch in slices(batches, text):
            raw, offsets = utf8_view(batch.column(text))
            hexes: dict[int, list[tuple[int, int]]] = {}
            for a, b, k in zip(*(x.tolist() for x in hex_runs(raw, offsets)), strict=True):
                hexes.setdefault(k, []).append((a, b))
            data, spans = raw.tobytes(), []
            for k in range(batch.num_rows):
                s = data[offsets[k] : offsets[k + 1]]
                whole = s.decode("utf-8")
                own, at, points = [], int(offsets[k]), 0
                for a, b in hexes.get(k, []):
                    points += len(data[at:a].decode("utf-8"))
                    own.append((points, points + b - a))
                    points, at = points + b - a, b
                lowered = whole.lower()
                found = scan(whole, own, lowered, novelty, model.threshold) if own or "AKIA" in whole or any(w in lowered for w in _WORDS) else []
                spans.append([dict(zip(("kind", "start", "end", "cost"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(spans, pa.list_(_SPAN))], names=[*columns, out])

    return run


def find(df: DataFrame, text: str = "text", out: str = "spans", model: Model | None = None) -> DataFrame:
    """Add the spans of secrets in ``text``: array<struct<kind, start, end, cost>>, by the model of ``fit`` or else the fixed dictionary. No shuffle."""
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, SPANS)])
    return in_batches(df).select(*[F.col(f"`{n}`") for n in names]).mapInArrow(_worker(names, text, out, model or default_model()), schema)


def redact(df: DataFrame, text: str = "text", mask: str = "[REDACTED]", model: Model | None = None) -> DataFrame:
    """Replace every span in ``text``; spans that overlap become one. Texts without spans stay as they are."""
    schema = df.schema
    names = schema.names
    model = model or default_model()

    def cover(whole: str, spans: list) -> str:
        out, at = [], 0
        for start, end in sorted((s["start"], s["end"]) for s in spans):
            if start >= at:
                out += [whole[at:start], mask]
            at = max(at, end)
        return "".join([*out, whole[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _worker(names, text, "__spans__", model)(batches):  # in one pass: a second operator would take a second Python worker for each task
            texts = batch.column(text).to_pylist()
            spans = batch.columns[-1].to_pylist()
            new = [cover(t, s) if s and t is not None else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.columns[i].type) if n == text else batch.columns[i] for i, n in enumerate(names)], names=names)

    return in_batches(df).select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = find(rows, out="found", model=fit(rows)).drop("text")

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    of = {k: number(k) for k in KINDS}
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return docs.select(
        "doc_id", *[of[k].alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), of["novel"].alias("n_novel"),
    )
