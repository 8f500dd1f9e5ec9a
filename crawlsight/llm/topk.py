"""Exact top-k search by inner product: a three-phase uniform threshold.

Vectors are cut into ``SLICES`` runs of components, those in which the queries
have the most energy first; a slice's part of the inner product is a local
score, and the score is the sum of the parts.

1. Every task computes the first slice's local scores only, lists the ``LIST``
   best of every ``ROWS`` rows by them, resolves those in full and hands on its k
   best sums; the k-th best of all tasks is a cutoff that the true k-th score
   reaches or exceeds.
2. The cutoff is broadcast. A row's score is at most its parts so far and, for
   the slices that are open, the product of the norms (Cauchy-Schwarz); slice by
   slice, the entries whose bound reaches the cutoff, or the task's own k-th best
   where that is higher, are collected and the others get no further slice.
3. What is left has all its slices and so its exact score; each task keeps its k
   best by score and then smaller id, and the best of those are the answer.

Queries go in blocks of about ``BLOCK`` so that what is broadcast has a bound;
each block is set against all rows, and its answers are written before the next
one's turn, so plans don't grow with the number of blocks.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; vectors of another length than a query's are
no candidates for it; ties go to the smaller id; rows equal in id and vector,
and candidates equal in id and score, count once; a row with the query's own id
is no candidate; with fewer than k candidates all are given; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table, shared_dir

K, SLICES, BLOCK, ROWS = 5, 8, 4096, 1024
#: Rows of ``ROWS`` that the first phase resolves for each query.
LIST = 8
#: A share of entries under which a slice is computed for the entries alone, not for whole rows.
SPARSE = 0.1
#: Stands for "no score"; its negative is a number too.
_NONE = -(1 << 62)


def integers(df: DataFrame, id_name: str, vector: str, scale: int = 256) -> DataFrame:
    """``(vec_id, v array<int>, dim)``: floor(scale * x) of every usable vector, equal rows once."""
    usable = F.col(id_name).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.filter(usable).select(F.col(id_name).cast("long").alias("vec_id"), v.alias("v")).distinct().withColumn("dim", F.size("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


class Queries:
    """A block of queries, cut into slices."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        energy = (vectors.astype(np.float64) ** 2).sum(0)
        self.order = np.argsort(-energy, kind="stable")
        self.vectors = np.ascontiguousarray(vectors[:, self.order])
        self.bounds = np.linspace(0, vectors.shape[1], SLICES + 1).astype(int)
        self.rest = self._rests(self.vectors)

    def _rests(self, rows: np.ndarray) -> list[np.ndarray]:
        """Norms of what is open after each slice."""
        squares = rows.astype(np.float64) ** 2
        return [np.sqrt(squares[:, b:].sum(1)) for b in self.bounds[1:]]

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries in the order of the slices, as floats where all sums stay exact."""
        rows = rows[:, self.order]
        top = float(np.abs(rows).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, rows.shape[1])
        kind = np.float64 if top < 2**53 else np.int64
        return rows.astype(kind), self.vectors.astype(kind)

    def part(self, rows: np.ndarray, own: np.ndarray, s: int, first: int | None = None) -> np.ndarray:
        """Parts of all entries by slice ``s``, or by the slices from ``first`` to it."""
        a, b = self.bounds[s if first is None else first], self.bounds[s + 1]
        return rows[:, a:b] @ own[:, a:b].T

    def pairs(self, rows: np.ndarray, own: np.ndarray, s: int, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Parts of single entries."""
        a, b = self.bounds[s], self.bounds[s + 1]
        step, out = max(1, (1 << 21) // max(1, b - a)), np.empty(len(r), rows.dtype)
        for at in range(0, len(r), step):
            k = slice(at, at + step)
            out[k] = np.einsum("ij,ij->i", rows[r[k], a:b], own[q[k], a:b])
        return out


class Best:
    """The k best entries of each query by score and then smaller id; entries equal in both count once."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.full(n, _NONE)
        self.q, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(q) == 0:
            return
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score.astype(np.int64)]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        q, score, ids = q[new], score[new], ids[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.kth[self.q[last]] = self.score[last]


def heads(queries: Queries, ids: np.ndarray, rows: np.ndarray, best: Best, length: int = LIST) -> None:
    """Phase 1: the rows that head the first slice's list, resolved in full."""
    rows, own = queries.rows(rows)
    first = queries.part(rows, own, 0)
    n = min(length, len(ids))
    r = np.argpartition(first.T, len(ids) - n, axis=1)[:, -n:].ravel()
    q = np.repeat(np.arange(len(queries.ids)), n)
    keep = ids[r] != queries.ids[q]
    r, q = r[keep], q[keep]
    total = first[r, q].astype(np.int64)
    for s in range(1, SLICES):
        total += queries.pairs(rows, own, s, r, q).astype(np.int64)
    best.add(q, total, ids[r])


def resolve(queries: Queries, ids: np.ndarray, rows: np.ndarray, cutoff: np.ndarray, best: Best) -> int:
    """Phases 2 and 3: entries that can reach the cutoff, slice by slice; how many got all their slices."""
    limit = np.maximum(cutoff, best.kth)
    low = limit - (np.abs(limit) * 1e-12 + 1)  # bounds are floats
    open_rows = queries._rests(rows[:, queries.order])
    rows, own = queries.rows(rows)
    # While the norms of the open slices alone reach the cutoff, a bound tells next to nothing; those slices go together.
    told = [s for s in range(SLICES) if np.median(open_rows[s]) * np.median(queries.rest[s]) < np.median(limit)]
    begin = min([*told, SLICES - 1])
    total = queries.part(rows, own, begin, 0)

    def reach(part: np.ndarray, s: int, r=slice(None), q=None) -> np.ndarray:
        if q is None:
            bound = open_rows[s][:, None] * queries.rest[s][None, :]
            return part + bound * (1 + 1e-9) >= low[None, :]
        return part + open_rows[s][r] * queries.rest[s][q] * (1 + 1e-9) >= low[q]

    alive = reach(total, begin) & (ids[:, None] != queries.ids[None, :])
    r = q = score = None
    resolved = alive.size if begin == SLICES - 1 else 0
    for s in range(begin + 1, SLICES):
        if r is None and np.count_nonzero(alive) > SPARSE * alive.size:
            resolved = alive.size
            total += queries.part(rows, own, s)
            alive &= reach(total, s)
            continue
        if r is None:
            r, q = np.nonzero(alive)
            score = total[r, q]
        resolved = len(r)
        score = score + queries.pairs(rows, own, s, r, q)
        keep = reach(score, s, r, q)
        r, q, score = r[keep], q[keep], score[keep]
    if r is None:
        r, q = np.nonzero(alive & (total >= limit[None, :]))
        score = total[r, q]
    keep = score >= limit[q]
    best.add(q[keep], score[keep], ids[r[keep]])
    return resolved


def _rows(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim)


def _task(shared, dim: int, k: int, cutoff=None):
    """A task's k best: of its heads, or with a cutoff of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = Best(len(queries.ids), k)
        for ids, rows in _rows(batches, dim):
            if cutoff is None:
                heads(queries, ids, rows, best)
            else:
                resolve(queries, ids, rows, cutoff.value, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.q.astype(np.int32)), pa.array(queries.ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["q", "query_id", "vec_id", "score"])

    return run


_ENTRIES = "q int, query_id long, vec_id long, score long"


def search(candidates: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for frames as ``integers`` gives them."""
    spark = candidates.sparkSession
    schema = "query_id long, vec_id long, score long"
    folder, written = f"{shared_dir(spark).rstrip('/')}/topk-{uuid.uuid4().hex}", []
    for size in queries.groupBy("dim").count().collect():
        dim, blocks = size["dim"], -(-size["count"] // block)
        rows = candidates.filter(F.col("dim") == dim).select("vec_id", "v")
        for b in range(blocks):
            mine = queries.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "v").toArrow()
            if mine.num_rows == 0:
                continue
            ids = mine.column("vec_id").to_numpy()
            vectors = _matrix(mine.column("v").combine_chunks(), dim) if dim else np.zeros((len(ids), 0), np.int64)
            shared = spark.sparkContext.broadcast(Queries(ids, vectors))
            lists = rows.mapInArrow(_task(shared, dim, k), _ENTRIES).select("q", "vec_id", "score").distinct()
            place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
            cutoff = np.full(len(ids), _NONE)
            for r in lists.withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k).collect():  # a number for each query of the block
                cutoff[r["q"]] = r["score"]
            floor = spark.sparkContext.broadcast(cutoff)
            written.append(f"{folder}/{dim}-{b}")
            rows.mapInArrow(_task(shared, dim, k, floor), _ENTRIES).select("query_id", "vec_id", "score").write.parquet(written[-1])
            floor.unpersist()
            shared.unpersist()
    out = spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(integers(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "topk-vectors")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))


OP4_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(len(q.v)), lambda i: q.v[i + 1] * c.v[i + 1])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
