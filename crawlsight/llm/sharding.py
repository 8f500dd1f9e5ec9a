"""Sharding by rendezvous hashing (native: DataFrame functions only).

Every record key draws one pseudo-random number for each shard; the shard with
the smallest ``-ln(u) / weight`` takes the record. A record's numbers don't
depend on the other shards, so one more shard takes rows only into itself, and
about its share of them.

Defined cases: a null id draws as the text ``null``; a null text has size 1 and
the checksum of no bytes, 0; rows with one id and one text are alike and get
slots that follow each other; an empty table gives an empty result; other
columns are left alone by ``assign``, which replaces columns of the two names that
it is told to write, and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, read_table
from .numbering import running_total

SHARDS = 16


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard decide: 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 1.0) / (2.0**52 + 1.0)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that takes ``key``; ties go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    bids = [F.struct((-F.log(draw(key, j)) / float(w)).alias("bid"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    return bids[0]["shard"] if len(bids) == 1 else F.array_min(F.array(*bids))["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """Add ``shard`` and, for a longer list of weights, ``grown_shard``. No shuffle."""
    of = doc_key(F.col(f"`{key}`"))
    added = {shard: rendezvous(of, weights)} | ({} if grown is None else {grown_shard: rendezvous(of, grown)})
    return df.withColumns(added)


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    # Equal rows are counted before any sort, so a key with a third of the rows is one row here.
    alike = docs.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    placed = assign(alike, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1)).withColumn("_digest", F.md5(doc_key(F.col("doc_id"))))
    numbered = running_total(placed, ["shard"], "_digest", ["doc_id", "text_crc32", "size"], "_n", "_upto")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("_upto") - F.col("_n"), F.col("_upto") - 1)).alias("slot"), "grown_shard",
    )


_BIDS = ", ".join(f"('0x' || substr(md5(k || '#{j}'), 1, 13))::BIGINT" for j in range(SHARDS))
OP9_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), sized AS (
  SELECT doc_id, k, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, t FROM docs
), drawn AS (
  SELECT doc_id, size, t, k, [{_BIDS}] AS u, ('0x' || substr(md5(k || '#{SHARDS}'), 1, 13))::BIGINT AS v FROM sized
), crc_table AS (
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps
), hexed AS (
  SELECT DISTINCT t, hex(encode(t)) AS h FROM docs
), checked AS (
  SELECT t, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2),
           lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda a, b: xor(steps[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS crc
  FROM hexed, crc_table
), placed AS (
  SELECT doc_id, size, t, k, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS shard,
         CASE WHEN v > list_max(u) THEN {SHARDS} ELSE CAST(list_position(u, list_max(u)) - 1 AS INTEGER) END AS grown_shard
  FROM drawn
)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, crc, size) - 1 AS slot, grown_shard
FROM placed JOIN checked USING (t)
"""
