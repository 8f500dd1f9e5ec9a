"""Running totals over hot groups without a task that holds a whole group.

Rows carry a digest in hexadecimal. Its first digits name a bucket, so each
group falls into at most ``16 ** DIGITS`` buckets; totals by bucket are few and
bounded, and only the rows of one bucket of one group are sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def running_total(df: DataFrame, group: list[str], digest: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows up to and with this one, in the order of digest, then ``order``.

    Rows equal in all of ``order`` and the digest must not occur twice; combine
    them first. Null groups are groups.
    """
    rows = df.withColumn("_bucket", F.substring(F.col(digest), 1, DIGITS))
    keys = [*group, "_bucket"]
    totals = rows.groupBy(*keys).agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy(*keys).orderBy(digest, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_within", F.sum(amount).over(within))
    match = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    return (
        numbered.join(starts, condition, "inner")
        .withColumn(out, F.col("_start") + F.col("_within"))
        .drop("_start", "_within", "_bucket", *[f"_s{i}" for i in range(len(keys))])
    )
