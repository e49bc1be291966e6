"""Running totals over a total order without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

#: Least number of buckets, and keys that a bucket holds at most (about).
BUCKETS, BUCKET_ROWS = 16, 1 << 18


def running_totals(df: DataFrame, key: str, values: list[str], within: list[str] | None = None) -> DataFrame:
    """``df`` (one row for each ``key``, or for each ``within`` and ``key``) with ``<v>_upto`` for each
    value: its sum over keys up to and including this one, separately for each ``within``.

    ``df`` is read several times, so it should be a written table. Keys are cut at approximate quantiles into as many buckets as their number
    asks for, totalled within each bucket by a window that only sees its own bucket, and shifted by the
    totals of the buckets before: a row for each bucket (and each ``within``).
    """
    by = within or []
    buckets = max(BUCKETS, math.ceil(df.count() / BUCKET_ROWS))
    cuts = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], max(1000, 16 * buckets)).alias("_cuts"))
    # One row: the cross join only hands the cut points to each task.
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(key)))).drop("_cuts")
    inside = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_bucket").agg(*(F.sum(v).alias(v) for v in values))
    shifts = totals.select(*by, "_bucket", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values))
    local = dealt.select("*", *(F.sum(v).over(inside).alias(f"{v}_upto") for v in values))
    joined = local.join(shifts, [*by, "_bucket"])
    return joined.select(*df.columns, *((F.col(f"{v}_upto") + F.col(f"_{v}")).alias(f"{v}_upto") for v in values))
