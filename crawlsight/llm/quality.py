"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every token bucket has a sparse random index vector. Its word vector is that
plus the index vectors of the tokens near it in a bounded sample of training
texts (random indexing). A document is pooled as the mean over its tokens, the
mean over its different tokens and a few sizes; a two-layer network, written in
numpy, scores that, and a temperature fitted on rows kept back from training
calibrates the probability.

Tokens are runs of letters, of digits and of other characters, so markup stands
apart from the words that it is glued to; rare tokens share buckets by hash.

At most ``TRAIN_ROWS`` labelled ids are used (of ids with several rows, twice as
many rows at most), and ``VECTOR_ROWS`` of them for word vectors, taken by digest.

Defined cases: null and empty texts pool to zeros and get the score of that; a
document labelled more than once counts by its mean label; without labels of
both kinds every score is the mean label, or 0.5 with none; rows repeated score
alike; texts are read whole; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, doc_key, in_batches, read_table, runs_of, slices, _SPACE, span_hashes, utf8_view
from .langid import held_out

TRAIN_ROWS, VECTOR_ROWS = 20_000, 4_000
BUCKETS, WIDTH, NEAR = 1 << 14, 48, 2
HIDDEN = 24
SIZES = 4
#: Tasks that sum word vectors; each hands one matrix of fixed size to the driver.
SUM_TASKS = 8

_CLASS = np.full(256, 3, np.uint8)
_CLASS[_SPACE] = 0
_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 2


def index_vectors(seed: int = 11) -> np.ndarray:
    """Four entries of +1 or -1 in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    at = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :4]
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), (BUCKETS, 4)), 1)
    return out


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every token, in order."""
    kind = _CLASS[raw]
    found = [runs_of(kind == k, offsets) for k in (1, 2, 3)]
    starts, ends, doc = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(starts, kind="stable")
    starts, ends, doc = starts[order], ends[order], doc[order]
    return (span_hashes(raw, starts, ends) >> np.uint64(50)).astype(np.int64), doc


def contexts(bucket: np.ndarray, doc: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each bucket, the summed index vectors of the tokens near its tokens."""
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    near = np.zeros((len(bucket), WIDTH), np.float32)
    for step in range(1, NEAR + 1):
        if len(bucket) > step:
            same = (doc[step:] == doc[:-step])[:, None]
            near[:-step] += index[bucket[step:]] * same
            near[step:] += index[bucket[:-step]] * same
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] = np.add.reduceat(near[order], first, axis=0)
    return out


def word_vectors(summed: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unit context vectors; a bucket that was never seen keeps its index vector."""
    size = np.linalg.norm(summed, axis=1, keepdims=True)
    return np.where(size > 0, summed / np.maximum(size, 1e-9), index / 2).astype(np.float32)


def pool(raw: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    bucket, doc = tokens(raw, offsets)
    out = np.zeros((n, 2 * WIDTH + SIZES), np.float32)
    if len(bucket) == 0:
        return out

    def mean(b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.bincount(d, minlength=n)
        full = np.flatnonzero(count)
        starts = np.searchsorted(d, full)
        pooled = np.zeros((n, WIDTH), np.float32)
        pooled[full] = np.add.reduceat(vectors[b], starts, axis=0) / count[full, None]
        return pooled, count

    out[:, :WIDTH], count = mean(bucket, doc)
    different = np.unique(doc * BUCKETS + bucket)
    out[:, WIDTH : 2 * WIDTH], kinds = mean(different % BUCKETS, different // BUCKETS)
    size = np.diff(offsets)
    out[:, 2 * WIDTH] = np.log1p(count) / 8
    out[:, 2 * WIDTH + 1] = kinds / np.maximum(count, 1)
    out[:, 2 * WIDTH + 2] = size / np.maximum(count, 1) / 10
    out[:, 2 * WIDTH + 3] = count > 0
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 300, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Network:
    """Adam on mini-batches; every fifth row is kept back for the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(x) < 10 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    back = np.arange(len(x)) % 5 == 4
    tx, ty = x[~back], y[~back]
    mean, scale = tx.mean(0), tx.std(0) + 1e-3
    z = (tx - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    size = min(512, len(z))
    for _ in range(max(1, min(epochs, 60_000 // max(1, len(z) // size)))):
        order = rng.permutation(len(z))
        for at in range(0, len(z) - size + 1, size):
            rows = order[at : at + size]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            e = (p - ty[rows]) / size
            back_h = np.outer(e, params[2]) * (1 - h**2)
            grads = [z[rows].T @ back_h + decay * params[0], back_h.sum(0), h.T @ e + decay * params[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    logits, by = net.logits(x[back]), y[back]
    grid = np.geomspace(0.3, 10, 40)
    nll = [np.mean(np.logaddexp(0, logits / t) - by * logits / t) for t in grid]
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), float(grid[int(np.argmin(nll))]))


def _sum_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total = index_vectors(), np.zeros((BUCKETS, WIDTH), np.float32)
    for batch in slices(batches, "text", 1 << 20):
        total += contexts(*tokens(*utf8_view(batch.column("text"))), index)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, vector_rows: int = VECTOR_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors and network from labelled documents; ``docs`` has ``doc_id`` and ``text``."""
    spark = docs.sparkSession
    digest = F.md5(doc_key(F.col("doc_id")))
    ids = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = ids.withColumn("_d", digest).orderBy("_d", "doc_id").limit(train_rows)
    rows = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "quality-sample")  # at most train_rows ids are broadcast
    few = rows.orderBy("_d", "doc_id").select("doc_id").limit(vector_rows).agg(F.count("*").alias("n"), F.max(F.struct(F.md5(doc_key(F.col("doc_id"))).alias("d"), "doc_id"))["d"].alias("d")).first()
    index = index_vectors()
    summed = np.zeros((BUCKETS, WIDTH), np.float32)
    if few["n"]:
        parts = rows.filter(F.col("_d") <= few["d"]).select("text").repartition(SUM_TASKS).mapInArrow(_sum_worker, "sums binary").collect()
        for r in parts:
            summed += np.frombuffer(bytes(r["sums"]), np.float32).reshape(BUCKETS, WIDTH)
    vectors = word_vectors(summed, index)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x = pool(*utf8_view(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("y"), pa.array(list(x))], names=["d", "y", "x"])

    got = rows.select("_d", "y", "text").mapInArrow(features, "d string, y int, x array<float>").orderBy("d", "y", "x").limit(2 * train_rows).toArrow()
    width = 2 * WIDTH + SIZES
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if got.num_rows else np.zeros((0, width))
    return vectors, train(x, got.column("y").to_numpy() if got.num_rows else np.zeros(0))


def score(df: DataFrame, model: tuple[np.ndarray, Network], text: str = "text") -> DataFrame:
    """Add ``score``. No shuffle."""
    kept = [f for f in df.schema.fields if f.name != "score"]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in slices(batches, text, 1 << 20):
            p = net.probability(pool(*utf8_view(batch.column(text)), vectors))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(p)], names=[*names, "score"])

    return in_batches(df).select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def op10_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").filter(~held_out(3, 1)))
    scored = score(docs.withColumn("held_out", held_out(3, 1)), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
