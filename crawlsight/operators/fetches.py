"""Fetch histories: which attempts belong together, what each fetch came to and how long it waited.

A log holds attempts in order. An attempt that failed for a while (a retryable status,
or an error) is followed by another of the same fetch, up to ``retries`` more; any
other ends its fetch. So an attempt's number is its distance from the last end before it,
modulo the attempts that a fetch may have. That distance is a running maximum over the whole log
in order of address and time: it is taken block by block of the global order, and
only one row for each block is carried on, so an address with most of all attempts
is no task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import numbered, saved
from .reports import backoff_ms

#: Retries of a fetch, the pause before one, and statuses that call for one (fixed values).
RETRIES, DELAY_MS = 2, 3000
RETRYABLE = (429, 503)
BLOCK = 100_000


def retryable(status: Column) -> Column:
    """Whether another attempt follows; without a status there was an error."""
    return status.isNull() | status.isin(*RETRYABLE)


def attempts(log: DataFrame, retries: int = RETRIES, delay_ms: int = DELAY_MS, block: int = BLOCK) -> DataFrame:
    """``(url, seq, status, retry_after)`` with ``fetch`` (alike within a fetch, ascending), ``attempt`` from 0, ``again`` and ``wait_ms`` before the next one. A null status is an error; ties in ``seq`` go by status."""
    rows = log.select("url", "seq", F.col("status").cast("int").alias("status"), F.col("retry_after").cast("double").alias("retry_after"))
    placed = numbered(rows, [F.col("url"), F.col("seq"), F.col("status").asc_nulls_first(), F.col("retry_after")], "attempts", "n").withColumn("_block", F.floor(F.col("n") / block))
    placed = saved(placed, "attempts-placed")
    failed = retryable(F.col("status"))
    tails = placed.groupBy((F.col("_block") + 1).alias("_block")).agg(F.max_by(F.struct("url", failed.alias("failed")), "n").alias("_tail"))
    inside = Window.partitionBy("_block").orderBy("n")
    before = F.coalesce(F.lag(F.struct("url", failed.alias("failed"))).over(inside), F.col("_tail"))
    same = F.coalesce(before["url"].eqNullSafe(F.col("url")) & before["failed"], F.lit(False))
    begun = placed.join(tails, "_block", "left").withColumn("_begin", F.when(~same, F.col("n"))).drop("_tail")
    begun = saved(begun, "attempts-begun")
    # The last begin of all blocks before: one row for each block.
    carried = begun.groupBy("_block").agg(F.max("_begin").alias("_m")).select("_block", F.max("_m").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    start = F.coalesce(F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_carried"))
    known = begun.join(carried, "_block").withColumn("attempt", F.pmod(F.col("n") - start, F.lit(retries + 1)).cast("int"))
    again = failed & (F.col("attempt") < retries)
    wait = F.when(~again, 0).when(F.col("status").isNull(), delay_ms).otherwise(backoff_ms(F.col("retry_after"), F.col("attempt"), delay_ms)).cast("long")
    return known.select("url", "seq", "status", "retry_after", (F.col("n") - F.col("attempt")).alias("fetch"), "attempt", again.alias("again"), wait.alias("wait_ms"))


def fetches(tried: DataFrame) -> DataFrame:
    """A row for each fetch: attempts, retries by cause, the time waited, and what it came to; a fetch that the log breaks off is ``unfinished``."""
    last = F.max_by(F.struct("status", "again"), "attempt")
    grouped = tried.groupBy("url", "fetch").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("again") & F.col("status").isNotNull()).alias("status_retries"), F.count_if(F.col("again") & F.col("status").isNull()).alias("error_retries"),
        F.sum("wait_ms").alias("waited_ms"), last.alias("_last"),
    )
    status = F.col("_last.status")
    outcome = F.when(F.col("_last.again"), "unfinished").when(status.isNull(), "error").when(retryable(status), "given_up").when(status >= 400, "failed").otherwise("answered")
    return grouped.select("url", "fetch", "attempts", "status_retries", "error_retries", "waited_ms", status.alias("status"), outcome.alias("outcome"))


def histories(done: DataFrame) -> DataFrame:
    """A row for each address: its fetches, those that needed more than one attempt, the time waited and what the last one came to."""
    return done.groupBy("url").agg(
        F.count(F.lit(1)).alias("fetches"), F.sum("attempts").alias("attempts"), F.count_if(F.col("attempts") > 1).alias("retried"), F.sum("waited_ms").alias("waited_ms"), F.max("waited_ms").alias("longest_wait_ms"),
        F.count_if(F.col("outcome") == "answered").alias("answered"), F.count_if((F.col("outcome") == "answered") & (F.col("attempts") > 1)).alias("recovered"), F.max_by("outcome", "fetch").alias("last_outcome"), F.max_by("status", "fetch").alias("last_status"),
    )
