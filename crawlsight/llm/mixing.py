"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a digest of their id and queue behind
one another; a document's virtual finish time is its source's words up to and
with it, divided by the source's target. A second pass over the source follows
the first, so no document is taken more than twice. All queue entries are put
in order of finish time, cut into ranges, and truncated where the running total
reaches the budget, the sum of all targets.

Defined cases: a null text has no words and takes nothing; a null source is a
source of its own, last in order; documents equal in id, source, size and checksum are
interchangeable; an empty table gives an empty mix; other columns are ignored
by ``plan`` and kept by ``apply``. Reruns agree, as nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut_lineage, doc_key, read_table
from .numbering import running_total

WEIGHTS = (3, 1, 2)
#: Ranges of one unit of virtual time; those from ``LAST`` units on are one.
RANGES, LAST = 65536, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``(source, source_size)`` with ``target``: ``share`` of all words by weight, no more than ``repeats`` times a source.

    Where a source stops at its limit, the rest is shared by weight among the
    others. In order of limit over weight the limited sources come first, so
    one running sum over the table of sources settles it.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.withColumn("_w", pick).withColumn("_cap", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    stepped = (
        limited.withColumn("_budget", F.sum("source_size").over(total) * float(share))
        .withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_used")) / F.col("_left"))
        .withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_settled", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(total))
    )
    open_end = F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level") >= F.col("_settled")
    target = F.when(F.col("_settled").isNotNull() & open_end, F.col("_settled")["_level"] * F.col("_w")).otherwise(F.col("_cap"))
    return stepped.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """How often each document is taken: ``(doc_id, source, size, crc, source_size, target, times)``, a row for each row of ``docs``."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    sized = cut_lineage(sized, "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    sources = cut_lineage(sources, "mix-sources").withColumnRenamed("source", "_source")

    alike = sized.groupBy("doc_id", "source", "size", "crc").agg(F.count(F.lit(1)).alias("_n"))
    alike = alike.withColumn("_words", F.col("size") * F.col("_n")).withColumn("_digest", F.md5(doc_key(F.col("doc_id"))))
    queued = running_total(alike, ["source"], "_digest", ["doc_id", "size", "crc"], "_words", "_upto")
    queue = (
        queued.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
        .withColumn("_upto", F.col("_upto") - F.col("_words") + F.col("size") * F.col("_copy"))
        .join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source", "_n", "_words")
    )
    queue = cut_lineage(queue, "mix-queue")

    def finish(k: int) -> Column:
        return (F.col("source_size") * k + F.col("_upto")) / F.col("target")

    def place(k: int) -> Column:
        """The order of the queue: finish time, then what tells entries apart."""
        return F.struct(finish(k).alias("finish"), F.coalesce(F.col("source"), F.lit("")).alias("s"), F.col("source").isNull().alias("z"), F.lit(k).alias("pass"), "_digest", F.col("doc_id").alias("id"), F.col("size").alias("words"), "crc", F.col("_copy").alias("copy"))

    entries = queue.filter("size > 0 and target > 0").select(
        F.explode(F.array(*[place(k) for k in range(repeats)])).alias("at")
    )
    entries = entries.withColumn("range", F.least(F.floor(F.col("at.finish") * RANGES), F.lit(RANGES * LAST)).cast("int"))
    budget = sources.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    ranges = entries.groupBy("range").agg(F.sum("at.words").alias("words"))
    upto = ranges.withColumn("upto", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    slack = budget + 1e-6  # a budget is a sum of rounded quotients
    full = upto.filter(F.col("upto") <= slack).agg(F.max("range").alias("range"), F.max("upto").alias("upto")).first()
    last, held = (full["range"] if full["range"] is not None else -1), full["upto"] or 0
    split = upto.filter(F.col("range") > last).agg(F.min("range").alias("range")).first()["range"]
    cut = None
    if split is not None:  # only the range in which the budget ends is sorted by row
        w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        inside = entries.filter(F.col("range") == split).withColumn("upto", F.sum("at.words").over(w) + held)
        cut = inside.filter(F.col("upto") <= slack).agg(F.max("at").alias("at")).first()["at"]

    def taken(k: int) -> Column:
        range_of = F.least(F.floor(finish(k) * RANGES), F.lit(RANGES * LAST)).cast("int")
        whole = range_of <= last
        if cut is None:
            return whole
        edge = F.struct(*[F.lit(v).cast(entries.schema["at"].dataType[i].dataType).alias(entries.schema["at"].dataType[i].name) for i, v in enumerate(cut)])
        return whole | ((range_of == split) & (place(k) <= edge))

    live = (F.col("size") > 0) & (F.col("target") > 0)
    times = sum((F.when(live & taken(k), 1).otherwise(0) for k in range(repeats)), F.lit(0))
    return queue.select("doc_id", "source", "size", "crc", "source_size", "target", times.cast("int").alias("times"))


def apply(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``plan`` takes it, with the same columns."""
    chosen = plan(docs, weights, share, repeats)
    levels = [f"_t{k}" for k in range(1, repeats + 1)]  # how many of the rows of a key are taken k times or more
    keys = ("doc_id", "source", "size", "crc")
    counts = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("times") >= k).alias(n) for k, n in enumerate(levels, 1)])
    counts = counts.filter("_t1 > 0").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_n", *levels)
    # Whole rows travel as one struct, so their columns may have any names.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col("doc_id").alias("_r0"), F.col("source").alias("_r1"), word_count(F.col("text")).alias("_r2"), F.crc32(F.coalesce("text", F.lit(""))).alias("_r3"))
    same = F.col("_r0").eqNullSafe(F.col("_k0")) & F.col("_r1").eqNullSafe(F.col("_k1")) & (F.col("_r2") == F.col("_k2")) & (F.col("_r3") == F.col("_k3"))
    out = rows.join(counts.filter("_n = 1"), same).select("row", sum((F.col(n) for n in levels), F.lit(0)).alias("copies"))
    if not counts.filter("_n > 1").isEmpty():
        # Rows alike are counted before the shuffle, and each different one takes its part of the key's copies.
        keyed = [f"_k{i}" for i in range(len(keys))]
        met = rows.join(counts.filter("_n > 1"), same).groupBy("row", *keyed, *levels).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keyed).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
        share_of = [F.greatest(F.lit(0), F.least(F.col(n), F.col("_u")) - (F.col("_u") - F.col("_c"))) for n in levels]
        out = out.unionByName(met.withColumn("_u", upto).select("row", sum(share_of, F.lit(0)).alias("copies")))
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = plan(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP6_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT), 0) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM totals
), limited AS (
  SELECT *, CAST([3.0, 1.0, 2.0][((rnk - 1) % 3) + 1] AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM ranked
), stepped AS (
  SELECT *, cap / w AS ratio, CAST(sum(source_size) OVER () * 1.5 AS DOUBLE) AS budget,
         coalesce(sum(cap) OVER o, 0.0) AS used, sum(w) OVER () - coalesce(sum(w) OVER o, 0.0) AS rest
  FROM limited WINDOW o AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT *, (budget - used) / rest AS lvl, ((budget - used) / rest) * w <= cap AS free FROM stepped
), first_free AS (
  SELECT ratio AS r0, rnk AS k0, lvl AS l0 FROM settled WHERE free ORDER BY ratio, rnk LIMIT 1
), targeted AS (
  SELECT source, source_size, CASE WHEN l0 IS NOT NULL AND (ratio > r0 OR (ratio = r0 AND rnk >= k0)) THEN l0 * w ELSE cap END AS target
  FROM settled LEFT JOIN first_free ON true
), queued AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')) AS h,
         row_number() OVER () AS n,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN targeted t ON d.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT n, h, doc_id, source, size, p, (source_size * p + upto) / target AS finish
  FROM queued, (VALUES (0), (1)) AS v(p) WHERE size > 0 AND target > 0
), run AS (
  SELECT n, size, sum(size) OVER (ORDER BY finish, coalesce(source, ''), source IS NULL, p, h, doc_id, size
                                  ROWS UNBOUNDED PRECEDING) AS total FROM entries
), times AS (
  SELECT n, count(*) AS c FROM run WHERE total <= (SELECT sum(target) FROM targeted) + 1e-6 GROUP BY n
)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(c, 0) AS BIGINT) AS taken FROM queued LEFT JOIN times USING (n)
"""
