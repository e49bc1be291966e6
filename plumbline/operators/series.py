"""Run registries: identity, variance over replicates, movement, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def identity_hash(fields: list[str]) -> Column:
    """Twelve hex digits of the fields' JSON, keys sorted."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(fields))), 256), 1, 12)


def identity_diff(was: DataFrame, now: DataFrame) -> DataFrame:
    """(field, was, now): fields, over the union of both, whose values differ (null-safe)."""
    j = was.select("field", F.col("value").alias("was")).join(now.select("field", F.col("value").alias("now")), "field", "full_outer")
    return j.filter(~F.col("was").eqNullSafe(F.col("now")))


def pinned_mismatches(was: DataFrame, now: DataFrame) -> DataFrame:
    """(field, was, now): pinned fields (stored, not null) that have another value now."""
    j = was.select("field", F.col("value").alias("was")).join(now.select("field", F.col("value").alias("now")), "field")
    return j.filter("was IS NOT NULL AND (now IS NULL OR was <> now)")


def variance_bound(runs: DataFrame) -> DataFrame:
    """(vintage, n_replicates, mean, bound, refusal): two population standard deviations over the
    replicate runs of (vintage, run, accuracy, replicate); refused below two."""
    g = runs.groupBy("vintage").agg(F.count_if("replicate").alias("n_replicates"), F.avg(F.when(F.col("replicate"), F.col("accuracy"))).alias("m"), F.stddev_pop(F.when(F.col("replicate"), F.col("accuracy"))).alias("s"))
    ok = F.col("n_replicates") >= 2
    return g.select("vintage", "n_replicates", F.when(ok, F.col("m")).alias("mean"), F.when(ok, 2 * F.col("s")).alias("bound"), F.when(~ok, F.concat(F.lit("needs 2 replicates, has "), F.col("n_replicates").cast("string"))).alias("refusal"))


def movement(runs: DataFrame) -> DataFrame:
    """(vintage, run, delta, bound, verdict) of the other runs against the replicate mean."""
    b = variance_bound(runs).select("vintage", "mean", "bound")
    j = runs.filter("NOT replicate").join(b, "vintage").withColumn("delta", F.col("accuracy") - F.col("mean"))
    verdict = F.when(F.col("bound").isNull(), "no bound").when(F.abs("delta") > F.col("bound"), "moved").otherwise("within")
    return j.select("vintage", "run", "delta", "bound", verdict.alias("verdict"))


def sequences(runs: DataFrame) -> DataFrame:
    """(series, t, value, is_reference) for the monitors: replicates are the reference, other runs
    follow in recorded order; runs without the quantity are skipped."""
    from pyspark.sql import Window

    order = Window.partitionBy("vintage", "replicate").orderBy("run")
    return runs.filter("accuracy IS NOT NULL").select(F.col("vintage").alias("series"), (F.row_number().over(order) - 1).alias("t"), F.col("accuracy").alias("value"), F.col("replicate").alias("is_reference"))


def list_series(runs: DataFrame) -> DataFrame:
    """(series_id, n_runs, n_replicates, vintages)."""
    return runs.groupBy("series_id").agg(F.count_distinct("run").alias("n_runs"), F.count_distinct(F.when(F.col("replicate"), F.col("run"))).alias("n_replicates"), F.array_sort(F.collect_set("vintage")).alias("vintages"))
