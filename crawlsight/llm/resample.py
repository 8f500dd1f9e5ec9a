"""Target-distribution importance resampling with n-grams counted by DuckDB in each partition.

1. A task hands its texts to DuckDB, which takes them apart into words, pairs them by
   a window, hashes every run with a registered CRC-32 and counts by bucket. The
   counts of each document, and those of the whole task, are spilled to Parquet.
2. Spark sums the tasks' counts; the target's texts go the same way. A bucket's gain is
   the logarithm of its share in the target over its share in the corpus, smoothed.
3. A document's weight is the mean gain of its runs, from its spilled counts; its score
   adds Gumbel noise from a digest of its id, so the highest scores are a draw
   without replacement in proportion to the weights.
4. Counts by score, of which there are no more than the gains and the noise allow, tell the
   score that surely suffices; only documents from it on are put in order, by ranges.

Texts are handed over in segments of about ``SEGMENT`` bytes that end at a word's end; a
segment that continues a text begins with the last word of the one before, which is then
paired but not counted again.

Defined cases: a null or empty text has no runs and weight 0; texts may be of any length;
rows without an id are hashed as ``null`` and come last among ties; repeated rows have the same score and
take ranks side by side; where the corpus or the target is empty, shares are the smoothing's;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import numbered
from .common import cut_lineage, doc_key, in_batches, read_table, runs_of, slices, utf8_view

BUCKETS, RUNS, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Bytes of text that DuckDB gets in one row and, about, at a time.
SEGMENT = 1 << 19
#: Memory that DuckDB may take in a task; it never spills to the executor's own folder.
MEMORY = "256MB"

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crc(features: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Unsigned CRC-32 of the UTF-8 bytes of each text."""
    raw, ends = utf8_view(features)
    data, at = raw.tobytes(), ends.tolist()
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.uint32())


@functools.cache
def _duckdb():
    """One connection for each Python worker."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc", crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def _count_sql(runs: int, buckets: int) -> str:
    """Counts by text and bucket of all runs of 1 to ``runs`` words, and of the words (bucket -1)."""
    leads = "".join(f", lead(word, {n}) OVER w AS w{n}" for n in range(1, runs))
    later = "".join(f" UNION ALL SELECT doc, concat_ws(' ', word, {', '.join(f'w{i}' for i in range(1, n))}) FROM paired WHERE w{n - 1} IS NOT NULL AND pos + {n - 1} > carried" for n in range(2, runs + 1))
    return f"""
WITH found AS (SELECT doc, carried, regexp_extract_all(text, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS list FROM segments),
words AS (SELECT doc, carried, unnest(list) AS word, unnest(range(1, len(list) + 1)) AS pos FROM found),
paired AS (SELECT doc, carried, word, pos{leads} FROM words WINDOW w AS (PARTITION BY doc ORDER BY pos)),
features AS (SELECT doc, word AS feature FROM paired WHERE pos > carried{later})
SELECT doc, CAST(crc(feature) % {buckets} AS INTEGER) AS bucket, count(*) AS n FROM features GROUP BY ALL
UNION ALL SELECT doc, -1, count(*) FROM words WHERE pos > carried GROUP BY doc ORDER BY doc, bucket"""


def segments(raw: np.ndarray, offsets: np.ndarray, runs: int = RUNS, most: int = SEGMENT) -> Iterator[tuple[int, int, int, int]]:
    """``(text, start, end, carried)``: where texts are cut, and how many words at the start of a segment were counted before."""
    for k in range(len(offsets) - 1):
        start, end = int(offsets[k]), int(offsets[k + 1])
        if end - start <= most:
            yield k, start, end, 0
            continue
        first, last, _ = runs_of(_WORD[raw[start:end]], np.array([0, end - start]))
        i = j = 0
        while j < len(first):
            carried = j - i
            j = max(int(np.searchsorted(last, first[i] + most, side="right")), j + 1)
            yield k, start + int(first[i]), start + int(last[j - 1]), carried
            i = max(0, j - runs + 1)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw)


def count_batch(texts: pa.Array, runs: int = RUNS, buckets: int = BUCKETS, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(words, row, bucket, n)``: words by text, and the counts of each text's runs, in order of row and bucket."""
    raw, offsets = utf8_view(texts)
    low, words, held = lowered(raw), np.zeros(len(offsets) - 1, np.int64), []
    row, text, carried, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        if not row:
            return
        con = _duckdb()
        con.register("segments", pa.table({"doc": pa.array(range(len(row)), pa.int32()), "text": pa.array(text, pa.string()), "carried": pa.array(carried, pa.int32())}))
        found = con.sql(_count_sql(runs, buckets)).to_arrow_table()
        con.unregister("segments")
        r, b, n = (found.column(c).to_numpy() for c in ("doc", "bucket", "n"))
        r = np.array(row)[r]
        np.add.at(words, r[b < 0], n[b < 0])
        held.append((r[b >= 0], b[b >= 0], n[b >= 0]))
        for x in (row, text, carried):
            x.clear()
        size = 0

    for k, a, b, c in segments(low, offsets, runs, segment):
        if size and size + b - a > segment:
            flush()
        row.append(k)
        text.append(low[a:b].tobytes().decode())
        carried.append(c)
        size += b - a
    flush()
    if not held:
        return words, *(np.zeros(0, np.int64) for _ in range(3))
    r, b, n = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
    key = r * buckets + b
    if len(key) and (np.diff(key) <= 0).any():  # a text in several segments
        key, place = np.unique(key, return_inverse=True)
        n = np.bincount(place, n).astype(np.int64)
    return words, key // buckets, key % buckets, n


def spill(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, buckets, counts, total)`` as a table: a row for each document, and one, marked ``total``, for each task."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_words", "long").add("buckets", T.ArrayType(T.IntegerType(), False)).add("counts", T.ArrayType(T.LongType(), False)).add("total", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(buckets, np.int64), None

        def out(ids: pa.Array, words: np.ndarray, ends: np.ndarray, b: np.ndarray, n: np.ndarray, whole: bool) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for x in (pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64)))]
            return pa.RecordBatch.from_arrays([ids, pa.array(words), *lists, pa.array(np.full(len(words), whole))], names=schema.names)

        for batch in slices(batches, "text", SEGMENT):
            ids, kind = batch.column("doc_id"), batch.column("doc_id").type
            words, row, b, n = count_batch(batch.column("text"), runs, buckets)
            total += np.bincount(b, n, buckets).astype(np.int64)
            yield out(ids, words, np.searchsorted(row, np.arange(batch.num_rows + 1)), b, n, False)
        if kind is not None:
            b = np.flatnonzero(total)
            yield out(pa.nulls(1, kind), np.zeros(1, np.int64), np.array([0, len(b)]), b, total[b], True)

    rows = in_batches(docs).select("doc_id", F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
    return cut_lineage(rows, "resample-counts")


def merged(spilled: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts of all tasks, by bucket."""
    out = np.zeros(buckets, np.int64)
    rows = spilled.filter("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    for r in rows.collect():  # as many as there are buckets
        out[r["buckets"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    S, T_ = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + len(corpus)) / ((s + 1.0) * (T_ + len(target))))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(spilled: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of each document."""
    shared = spilled.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    schema = T.StructType([spilled.schema["doc_id"]]).add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column("buckets"), batch.column("counts")
            n = counts.flatten().to_numpy(zero_copy_only=False)
            value = np.concatenate([[0], np.cumsum(n * shared.value[lists.flatten().to_numpy(zero_copy_only=False)])])
            number = np.concatenate([[0], np.cumsum(n)])
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            features = number[ends[1:]] - number[ends[:-1]]
            weight = (value[ends[1:]] - value[ends[:-1]]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(features), pa.array(weight)], names=schema.names)

    return spilled.filter("not total").select("doc_id", "n_words", "buckets", "counts").mapInArrow(run, schema)


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``score``: the weight and, in thousandths, a Gumbel number from a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_key(F.col("doc_id"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` to a written table with scores: 1, 2, 3 ... for those drawn, by score and then smaller id."""
    able = F.col("n_words") >= least_words
    by_score = rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()  # scores are whole thousandths in a fixed span
    wanted, upto, least = sum(r["n"] for r in by_score) * percent // 100, 0, None
    for r in by_score:
        if upto >= wanted:
            break
        upto, least = upto + r["n"], r["score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select("*", no_rank)
    near = able & (F.col("score") >= least)
    apart = rows.filter(near).withColumn("_tie", F.monotonically_increasing_id())  # repeated rows differ by it, so ranges can part them
    placed = numbered(apart, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_tie")], "resample-order", "_rank")
    drawn = placed.select(*rows.columns, F.when(F.col("_rank") <= wanted, F.col("_rank")).alias("rank"))
    return drawn.unionByName(rows.filter(~near).select("*", no_rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of each row of ``docs``; ``target``: a frame with ``text``."""
    spilled = spill(docs)
    wanted = spill(target.select(F.lit(0).cast("long").alias("doc_id"), "text"))
    rows = cut_lineage(scored(weights(spilled, gains(merged(spilled), merged(wanted)))), "resample-scores")
    return draw(rows, percent, least_words)


def op13_duckdb_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The same in DuckDB alone. CRC-32 goes by the four-bit steps of its polynomial, lower half of each byte first.
OP13_SQL = f"""
WITH nibbles AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(16) r(i))
), texts AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, true AS corpus, text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark
), found AS MATERIALIZED (
  SELECT n, doc_id, corpus, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), features AS MATERIALIZED (
  SELECT n, corpus, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM found
), hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h)), lambda i: CAST(instr('0123456789ABCDEF', h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 AS BIGINT))),
      lambda x, y: xor(x >> 4, t[CAST(xor(x, y) & 15 AS INTEGER) + 1])), 4294967295) % {BUCKETS} AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)), nibbles
), counted AS MATERIALIZED (
  SELECT n, corpus, b, count(*) AS c FROM features JOIN hashed USING (f) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(c) FILTER (corpus), 0) AS s, coalesce(sum(c) FILTER (NOT corpus), 0) AS t FROM counted
), buckets AS MATERIALIZED (
  SELECT b, coalesce(sum(c) FILTER (corpus), 0) AS s, coalesce(sum(c) FILTER (NOT corpus), 0) AS t FROM counted GROUP BY b
), gain AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln((CAST(k.t AS DOUBLE) + 1) * (CAST(a.s AS DOUBLE) + {BUCKETS}) / ((CAST(k.s AS DOUBLE) + 1) * (CAST(a.t AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS g FROM buckets k, totals a
), weighed AS (
  SELECT n, sum(c) AS k, floor(CAST(sum(c * g) AS DOUBLE) / CAST(sum(c) AS DOUBLE)) AS weight FROM counted JOIN gain USING (b) WHERE corpus GROUP BY n
), scored AS (
  SELECT n, doc_id, len(w) AS words, CAST(coalesce(k, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM found LEFT JOIN weighed USING (n) WHERE corpus
), placed AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, {PERCENT} * count(*) OVER () // 100 AS m FROM scored WHERE words >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= m THEN rank END AS rank FROM scored LEFT JOIN placed USING (n)
"""
