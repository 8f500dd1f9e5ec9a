"""Centroid clustering in integers by exponion search.

Every vector carries its centroid, an upper bound of the distance to it and a lower
bound of the distance to any other. Centroids move, the bounds follow by how far;
where the upper bound stays under the lower one, or under half the way from the
centroid to its nearest neighbour, nothing is computed. Else only the centroids
inside a ball around the vector's own are scanned: a centroid as near to the vector
as its own is at most twice that distance from it, so the ball's radius is twice
the distance and the way to the nearest neighbour, which leaves the second nearest
in it too. Each centroid has its others in a list by distance, so a ball is the
head of a list; heads are rounded up to powers of two, by which rows are scanned
together. The radius is inclusive, so ties are seen, and the smaller number wins.

A round is a pass that writes the vectors with their bounds as a table, and a sum by
centroid over it. Centroids, ``k`` times the dimension, are all that reaches the driver.

Vectors become floor(scale * component). Products and sums are exact: in doubles
where they stay below 2^53, in 64-bit integers below 2^62, and beyond in Python's
integers; distances themselves are 64-bit. Bounds are doubles with a margin, and
what a bound can't rule out is computed exactly.

Defined cases: vectors that are null, of another length or with components that are
null or not finite take no part; rows without an id take part but are no first
centroids; repeated rows all count; with fewer than ``k`` vectors each is a
centroid; equal centroids leave the larger numbers empty, and empty ones stay where
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, drop_table, read_table

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Rows that are compared at a time.
ROWS = 4096
#: A share by which a bound has to clear another.
MARGIN = 1e-9


def integers(df: DataFrame, id_name: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v array<long>)`` of the vectors that take part."""
    usable = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(vector).isNotNull() & usable).select(F.col(id_name).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors of the ``k`` smallest digests of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in vectors.filter("vec_id is not null").orderBy(digest, "vec_id", "v").select("v").limit(k).collect()]  # k rows


def _exact(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all others, as 64-bit integers."""
    top = float(max(np.abs(rows.astype(np.float64)).max(initial=0), np.abs(others.astype(np.float64)).max(initial=0)))
    size = 4 * top * top * max(1, rows.shape[1])
    kind = np.float64 if size < 2**53 else np.int64 if size < 2**62 else object
    a, b = rows.astype(kind), others.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def _apart(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the row beside it."""
    top = float(max(np.abs(rows.astype(np.float64)).max(initial=0), np.abs(others.astype(np.float64)).max(initial=0)))
    kind = np.int64 if 4 * top * top * max(1, rows.shape[1]) < 2**62 else object
    d = rows.astype(kind) - others.astype(kind)
    return (d * d).sum(1).astype(np.int64)


class Centroids:
    """Centroids, the ways between them, and each one's others by distance."""

    def __init__(self, vectors: list[list[int]], before: Centroids | None = None):
        self.v = np.array(vectors, np.int64)
        k = len(vectors)
        ways = np.sqrt(_exact(self.v, self.v).astype(np.float64))
        order = np.argsort(ways, axis=1, kind="stable")
        own = np.arange(k)
        self.others = order[order != own[:, None]].reshape(k, k - 1)
        self.ways = np.take_along_axis(ways, self.others, 1)
        self.near = self.ways[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(_apart(self.v, before.v).astype(np.float64))
        self.scanned = 0

    def assign(self, rows: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring centroid and bounds of each row up to these centroids, in place."""
        k = len(self.v)
        most = np.sort(self.moved)[::-1]
        others = np.where(self.moved[own] == most[0], most[1] if k > 1 else 0.0, most[0])
        upper += self.moved[own] * (1 + MARGIN)
        lower -= others * (1 + MARGIN)
        floor = np.maximum(lower, self.near[own] / 2)
        at = np.flatnonzero(~(upper * (1 + MARGIN) < floor * (1 - MARGIN)))
        upper[at] = np.sqrt(_apart(rows[at], self.v[own[at]]).astype(np.float64))
        self.scanned += len(at)
        at = at[~(upper[at] * (1 + MARGIN) < floor[at] * (1 - MARGIN))]
        if k == 1:
            lower[at] = np.inf
            return
        radius = (2 * upper[at] + self.near[own[at]]) * (1 + MARGIN)
        for a in np.unique(own[at]):
            mine = at[own[at] == a]
            head = np.searchsorted(self.ways[a], radius[own[at] == a], side="right")
            head = np.minimum(1 << np.ceil(np.log2(np.maximum(head, 1))).astype(np.int64), k - 1)
            for n in np.unique(head):
                some = mine[head == n]
                inside = np.sort(np.append(self.others[a][:n], a))  # in order of number: the first of equals wins
                distance = _exact(rows[some], self.v[inside])
                self.scanned += distance.size
                best = np.argmin(distance, axis=1)
                own[some] = inside[best]
                two = np.partition(distance, 1, axis=1)[:, :2].astype(np.float64)
                upper[some], lower[some] = np.sqrt(two[:, 0]), np.sqrt(two[:, 1])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


_STATE = "v array<long>, cluster int, upper double, lower double"


def _pass(shared, last: bool):
    """One assignment; the last one hands on distances in place of vectors and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            for part, rows in _blocks(batch):
                if "cluster" in part.schema.names:
                    own, upper, lower = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                else:
                    own, upper, lower = np.zeros(len(rows), np.int32), np.full(len(rows), np.inf), np.zeros(len(rows))
                centroids.assign(rows, own, upper, lower)
                out = {"vec_id": part.column("vec_id")}
                out |= {"cluster": pa.array(own), "distance": pa.array(_apart(rows, centroids.v[own]))} if last else {"v": part.column("v"), "cluster": pa.array(own), "upper": pa.array(upper), "lower": pa.array(lower)}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _sums(k: int, dim: int):
    """A task's count and sum of each centroid's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), object)
        for batch in batches:
            for part, rows in _blocks(batch):
                own = part.column("cluster").to_numpy(zero_copy_only=False)
                kind = np.int64 if float(np.abs(rows.astype(np.float64)).max(initial=0)) * len(rows) < 2**62 else object
                for a in np.unique(own):
                    mine = rows[own == a]
                    total[a] += np.append(len(mine), mine.astype(kind).sum(0)).astype(object)
        for a in np.flatnonzero(total[:, 0]):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.full(dim + 1, a, np.int32)), "place": pa.array(np.arange(dim + 1, dtype=np.int32)), "total": pa.array(total[a].tolist(), pa.int64())})

    return run


def cluster(vectors: DataFrame, first: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` as a table after ``rounds`` rounds from the first centroids, and the last centroids."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    k, dim = len(first), len(first[0])
    now, state = Centroids(first), vectors
    for r in range(rounds + 1):
        last = r == rounds
        shared = spark.sparkContext.broadcast(now)
        made = state.mapInArrow(_pass(shared, last), f"vec_id {kind}, " + ("cluster int, distance long" if last else _STATE))
        made = cut_lineage(made, f"centroids-{r}")
        shared.unpersist()
        if r:
            drop_table(state)
        state = made
        if last:
            return state, now.v.tolist()
        sums = state.select("cluster", "v").mapInArrow(_sums(k, dim), "cluster int, place int, total long")
        found = {(x["cluster"], x["place"]): x["total"] for x in sums.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()}  # k * (dim + 1) numbers
        moved = [[found[a, j + 1] // found[a, 0] for j in range(dim)] if found.get((a, 0)) else old for a, old in enumerate(now.v.tolist())]
        now = Centroids(moved, now)
    raise ValueError("rounds may not be negative")


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(read_table(spark, sf_dir, "embeddings"))
    first = first_centroids(vectors)
    facts = "_c int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        empty = spark.createDataFrame([], "vec_id long, cluster int, distance long")
        return empty.join(spark.createDataFrame([], facts), F.col("cluster") == F.col("_c")).drop("_c")
    found, centroids = cluster(vectors, first)
    by_cluster = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k numbers
    rows = [(a, by_cluster.get(a, 0), sum(by_cluster.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for a, c in enumerate(centroids)]
    return found.join(F.broadcast(spark.createDataFrame(rows, facts)), F.col("cluster") == F.col("_c")).drop("_c")  # k rows


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """The same in DuckDB: every round compares every vector with every centroid."""
    steps = [f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM vectors WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), vec_id, v LIMIT {k}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT n, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT n, cluster, CAST(list_sum(list_transform(range({dim}), lambda i: (v[i + 1] - c[i + 1]) * (v[i + 1] - c[i + 1]))) AS BIGINT) AS d FROM vectors, c{r}) GROUP BY n
)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY place) AS c FROM (
    SELECT cluster, place, CAST((s - (((s % n) + n) % n)) // n AS BIGINT) AS m
    FROM (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS place FROM a{r} JOIN vectors USING (n)) GROUP BY cluster, place)
  ) GROUP BY cluster
), c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))""")
    return ", ".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN vectors USING (n) JOIN c{rounds} USING (cluster)
"""


OP12_SQL = _sql()
