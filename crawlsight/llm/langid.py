"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed
byte n-grams (log odds of the languages with the bit against those without)
gives a margin. Loss-weighted decoding sums, over the bits, the logistic loss of
the margin against a codeword's bit, weighted by how reliable the bit's
classifier is on a calibration sample; the codeword of least loss names the
language, and a small lead over the next one marks the document as ambiguous.

Training and calibration take at most about ``TRAIN_ROWS`` labelled rows by digest
of their id; about ``TUNE_ROWS`` of them are kept back for the calibration. Only
sums by language and n-gram bucket and the margins of the calibration rows reach
the driver.

A prediction is rejected if it is ambiguous and its score is so low that, by
rank among the scores of the calibration rows, less than a share of ``REJECT`` of
texts like those would score as low (a conformal test: with fewer than
1 / ``REJECT`` calibration rows nothing can be that rare, and nothing is rejected).

Defined cases: a null text or one without a letter is ``und`` with score 0; with
no labelled row every text is; with one language, texts with letters get it;
very long texts are read whole, in one piece; ties in loss go to the language
first in order; rows repeated are predicted alike and count once in training,
and a labelled id on most of the rows doesn't swell the sample; an empty table
gives an empty result; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, doc_key, in_batches, read_table, slices, utf8_view

TRAIN_ROWS, TUNE_ROWS = 20_000, 2_000
ORDERS, BITS = (1, 3, 4), 15
BUCKETS = 1 << BITS
#: A lead in probability under which a prediction is ambiguous.
LEAD = 0.2
#: The share of texts like the labelled ones that may be rejected.
REJECT = 1 / 1000
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def fold(raw: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1), everything else in ASCII as a space."""
    out = _FOLD[raw]
    upper = np.zeros(len(raw), bool)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[upper] += 0x20
    return out


def ngrams(folded: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, buckets of the n-grams and where each document's begin; none crosses a document or is centred on a space."""
    wide = folded.astype(np.uint32)
    for n in ORDERS:
        m = len(folded) - n + 1
        if m <= 0:
            yield np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + wide[i : i + m]
        keep = folded[(n > 1) : m + (n > 1)] != 0x20
        for i in range(1, n):
            keep[offsets[1:-1][(offsets[1:-1] >= i) & (offsets[1:-1] - i < m)] - i] = False
        total = np.zeros(m + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))[keep], total[np.minimum(offsets, m)]


def has_letter(raw: np.ndarray, offsets: np.ndarray, folded: np.ndarray) -> np.ndarray:
    ascii_letter = (folded != 0x20) & (raw < 0x80)
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(ascii_letter, out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8"))
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of k languages: all splits up to seven languages, else 63 balanced ones far from each other."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        splits = np.arange(1, 1 << (k - 1))
        return np.where((splits[None, :] >> np.arange(k)[:, None]) & 1, 1, -1).astype(np.int8)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(64):
        code = np.stack([rng.permutation(np.where(np.arange(k) % 2, 1, -1)) for _ in range(63)], 1)
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + 64 * np.eye(k, dtype=int)
        if apart.min() > far:
            best, far = code, apart.min()
    return best.astype(np.int8)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    bit_weights: np.ndarray
    slope: float
    floor: float | None = None  # the score under which ambiguous predictions are rejected

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Summed log odds by bit over the root of the number of n-grams."""
        n = len(offsets) - 1
        out, count = np.zeros((n, self.code.shape[1])), np.zeros(n)
        for buckets, starts in ngrams(fold(raw), offsets):
            own = np.diff(starts)
            full = np.flatnonzero(own)
            if len(full):
                out[full] += np.add.reduceat(self.weights[buckets], starts[:-1][full], axis=0)
                count += own
        return out / np.sqrt(np.maximum(count, 1))[:, None]

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * margins, -30, 30)
        against, in_favour = np.logaddexp(0, z), np.logaddexp(0, -z)
        plus = self.code.T > 0
        loss = (in_favour * self.bit_weights) @ plus + (against * self.bit_weights) @ ~plus
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def _counts_worker(languages: list[str]):
    at = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            raw, offsets = utf8_view(batch.column("text"))
            of = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            for buckets, starts in ngrams(fold(raw), offsets):
                keys = np.repeat(of * BUCKETS, np.diff(starts)) + buckets
                total += np.bincount(keys, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["key", "n"])

    return run


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, tune_rows: int = TUNE_ROWS) -> Model | None:
    """Learn from ``text`` and ``lang`` of rows whose lang isn't null."""
    labelled = docs.filter("lang is not null and text is not null")
    total = labelled.count()
    if total == 0:
        return None
    chosen = cut_lineage(_sample(labelled.select(doc_key(F.col("doc_id")).alias("_key"), "text", "lang"), train_rows, total), "lang-sample")
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    back = F.pmod(F.xxhash64(F.concat("_key", F.lit("#tune"))), F.lit(1_000_000)) < round(1_000_000 * tune_rows / train_rows)
    summed = chosen.filter(~back).select("text", "lang").mapInArrow(_counts_worker(languages), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[summed.column("key").to_numpy()] = summed.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    shares = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    if len(languages) > 1:
        for b in range(code.shape[1]):
            weights[:, b] = np.log(shares[code[:, b] > 0].mean(0)) - np.log(shares[code[:, b] < 0].mean(0))
    seen = counts.sum(0) > 0
    weights[~seen] = 0
    model = Model(tuple(languages), code, weights.astype(np.float32), np.ones(code.shape[1]), 1.0)

    tune = chosen.filter(back).select("text", "lang").mapInArrow(_margins_worker(model), "lang string, m array<double>").toArrow()
    if tune.num_rows == 0 or len(languages) == 1:
        return model
    y = np.array([languages.index(x) for x in tune.column("lang").to_pylist()])
    m = np.array(tune.column("m").to_pylist())
    wrong = (np.sign(m) != code[y]).mean(0)
    bit_weights = np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.05)
    best = None
    for slope in (0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6):
        trial = Model(model.languages, code, model.weights, bit_weights / bit_weights.sum() * 4, slope)
        nll = -np.log(trial.probabilities(m)[np.arange(len(y)), y] + 1e-9).mean()
        if best is None or nll < best[0]:
            best = (nll, trial)
    scores = np.sort(best[1].probabilities(m).max(1))
    place = math.ceil(REJECT * (len(scores) + 1)) - 1
    return replace(best[1], floor=float(scores[place - 1])) if place >= 1 else best[1]


def _sample(rows: DataFrame, most: int, total: int) -> DataFrame:
    """About ``most`` of the ``total`` rows by digest of their key, equal rows once; where one key has more, by digest of the whole row."""
    def share(digest: Column, n: int) -> Column:
        return F.pmod(digest, F.lit(1_000_000)) < max(1, round(1_000_000 * min(1.0, most / max(1, n))))

    found = rows.filter(share(F.xxhash64("_key"), total)).distinct()
    n = found.count()
    if 0 < n <= 2 * most:
        return found
    whole = F.xxhash64("_key", "lang", "text")
    if n:
        return found.filter(share(whole, n))
    return rows.orderBy(F.xxhash64("_key"), "_key", whole).limit(most)


def _margins_worker(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            m = model.margins(*utf8_view(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(m))], names=["lang", "m"])

    return run


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score``, ``ambiguous`` and ``rejected`` (for ``und``, too). No shuffle."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("rejected", T.BooleanType())]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        floor = -1.0 if own is None or own.floor is None else own.floor
        for batch in slices(batches, text, 1 << 20):
            raw, offsets = utf8_view(batch.column(text))
            known = has_letter(raw, offsets, fold(raw)) & (own is not None)
            name, score, ambiguous = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if known.any():
                p = own.probabilities(own.margins(raw, offsets))
                first = p.argmax(1)
                lead = p[np.arange(len(p)), first] - (np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else 0)
                name[known] = np.array(own.languages, object)[first[known]]
                score[known] = p.max(1)[known]
                ambiguous[known] = lead[known] < LEAD
            arrays = [*[batch.column(n) for n in names], pa.array(name, pa.string()), pa.array(score), pa.array(ambiguous), pa.array(~known | (ambiguous & (score < floor)))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *[a.name for a in added]])

    return in_batches(df).select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*kept, *added]))


def lettered(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose ``text`` has a letter. No shuffle."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            raw, offsets = utf8_view(batch.column(text))
            yield batch.filter(pa.array(has_letter(raw, offsets, fold(raw))))

    return in_batches(df).select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, df.schema)


def held_out(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(doc_key(F.col("doc_id"))), F.lit(modulus)) == remainder


def op1_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(4, 2)))
    return predict(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model).drop("text")
