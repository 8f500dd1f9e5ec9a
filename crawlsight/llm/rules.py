"""Quality rules: text statistics, and a decision list learned from labels.

The statistics of every text come from one pass over its bytes. A list of rules
is learned from labelled rows by sequential covering: a rule grows by the
threshold condition that gains most information about the bad rows, is pruned
on rows it hasn't grown on, and what it covers is taken away before the next
one grows. Thresholds are the midpoints between all neighbouring distinct values
of the rows that a condition is chosen on. The rules become one ordered Spark
conditional expression.

Defined cases: a null text counts as an empty one, with no words, so it fails
the base rule; equal lines and word windows are found by 64-bit hashes; a
document labelled more than once counts by its mean label; without labels of
both kinds the list is empty and only the base rule decides; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, doc_key, in_batches, mix, read_table, runs_of, slices, _SPACE, span_hashes, utf8_view, words_of

WINDOW = 8
#: The rows of labels that a list is learned from, at most, taken by digest of their id.
TRAIN_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct")


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*members]] = True
    return table


_SYMBOL, _UPPER, _DIGIT = _table(b"#*$%&|<>"), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(b"0123456789")
_PUNCT = _table(b"!?,.;:\"'()[]{}~^=+-_/\\@")
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(WINDOW)]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of a run of texts."""
    n = len(offsets) - 1
    starts, ends, doc = words_of(raw, offsets)
    solid = ~_SPACE[raw]
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": _sums(solid & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[raw], offsets),
        "n_upper": _sums(_UPPER[raw], offsets),
        "n_digits": _sums(_DIGIT[raw], offsets),
        "n_punct": _sums(_PUNCT[raw], offsets),
    }
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(0x51ED))
    words = span_hashes(raw, starts, ends)
    own = np.unique(mix(words ^ salt[doc]), return_index=True)[1] if len(words) else np.zeros(0, np.int64)
    out["n_distinct"] = np.bincount(doc[own], minlength=n)

    first, last, of = runs_of(raw != 0x0A, offsets)
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    written = filled[last] > filled[first]
    first, last, of = first[written], last[written], of[written]
    out["n_lines"] = np.bincount(of, minlength=n)
    lines = mix(span_hashes(raw, first, last) ^ salt[of]) if len(first) else np.zeros(0, np.uint64)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[np.unique(lines, return_index=True)[1]], minlength=n)

    out["n_repeat_words"] = np.zeros(n, np.int64)
    m = len(words) - WINDOW + 1
    if m > 0:
        rolled = np.zeros(m, np.uint64)
        for i in range(WINDOW):
            rolled += words[i : i + m] * _STEP[i]
        inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        keys = mix(rolled[inside] ^ salt[doc[inside]])
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = inside[times[back] > 1]
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def _worker(columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = statistics(*utf8_view(batch.column(text)))
            arrays = [*[batch.column(c) for c in columns], *[pa.array(found[c].astype(np.int64)) for c in COUNTS]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *COUNTS])

    return run


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts of ``text`` beside the columns to keep (all, unless named). No shuffle."""
    kept = [f for f in df.schema.fields if f.name not in COUNTS and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS]])
    needed = [*names, *([] if text in names else [text])]
    return in_batches(df).select(*[F.col(f"`{n}`") for n in needed]).mapInArrow(_worker(names, text), schema)


def features() -> dict[str, Column]:
    def ratio(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "upper": ratio("n_upper", "word_chars"),
        "digits": ratio("n_digits", "word_chars"),
        "punct": ratio("n_punct", "n_words"),
        "distinct": ratio("n_distinct", "n_words"),
        "line_words": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= self.threshold if self.above else x < self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.above else x < self.threshold


def _covers(rule: tuple[Condition, ...], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Midpoints that part ``low`` from ``high`` under ``<`` and ``>=``, neighbouring floats too."""
    middle = low + (high - low) / 2
    return np.where(middle > low, middle, high)


def learn(table: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3, precision: float = 0.8) -> list[tuple[Condition, ...]]:
    """An ordered list of conjunctions that mark bad rows."""
    bad = bad.astype(bool)
    n = len(bad)
    grow = np.arange(n) % 3 != 2
    left = np.ones(n, bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules and (bad & left & grow).any():
        rule: tuple[Condition, ...] = ()
        inside = left & grow
        while len(rule) < max_conditions:
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if n0 == 0 or p0 == 0:
                break
            best, gain = None, 1e-9
            for f in table:
                order = np.argsort(table[f][inside], kind="stable")
                x, y = table[f][inside][order], bad[inside][order]
                under = np.flatnonzero(x[1:] > x[:-1]) + 1
                thresholds = _between(x[under - 1], x[under])
                hits = np.concatenate([[0], np.cumsum(y)])[under]
                for above in (True, False):
                    p, t = (p0 - hits, len(x) - under) if above else (hits, under)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        g = np.where(p > 0, p * (np.log2(p / np.maximum(t, 1)) - np.log2(p0 / (p0 + n0))), -1)
                    i = int(np.argmax(g)) if len(g) else -1
                    if i >= 0 and g[i] > gain:
                        best, gain = Condition(f, above, float(thresholds[i])), g[i]
            if best is None:
                break
            rule += (best,)
            inside = inside & best.holds(table)
        test = left & ~grow

        def worth(r: tuple[Condition, ...]) -> float:
            c = _covers(r, table, n) & test
            p = (c & bad).sum()
            return (p + 1) / (c.sum() + 2) if r else 0.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(rule, table, n) & left
        p, t = (covered & bad).sum(), covered.sum()
        if not rule or t < 5 or p / t < precision or worth(rule) < precision - 0.15:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """True for rows that no rule marks: the list as one conditional expression."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def fit(measured: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[tuple[Condition, ...]]:
    """Learn from at most ``train_rows`` labelled ids (the first by digest) that have a row in ``measured``; of ids with several rows, ``2 * train_rows`` rows at most."""
    ids = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    sample = ids.orderBy(F.md5(doc_key(F.col("doc_id"))), "doc_id").limit(train_rows)
    names = list(features())
    rows = measured.join(F.broadcast(sample), "doc_id").select(F.md5(doc_key(F.col("doc_id"))).alias("_d"), "bad", *[c.alias(f) for f, c in features().items()])
    got = rows.orderBy("_d", *names).limit(2 * train_rows).toPandas()
    return learn({f: got[f].to_numpy() for f in names}, got["bad"].to_numpy())


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = cut_lineage(measure(docs, keep=["doc_id"]), "rules-counts")
    rules = fit(measured, read_table(spark, sf_dir, "labels"))
    failed = base_failed()
    return measured.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
