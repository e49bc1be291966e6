"""Error rates by subgroup, disparities, base rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GROUP_FLOOR = 20
PREVALENCES = (0.01, 0.10, 0.50)
VOLUME = 75_000


def long_axes(rows: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Each row once for each axis: (axis, value, other columns); a null value is "unknown"."""
    pairs = F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")) for a, c in axes.items()))
    return rows.withColumn("_p", F.explode(pairs)).select("_p.axis", "_p.value", *rows.columns)


def shared_keys(rows: DataFrame, meta: str = "meta") -> DataFrame:
    """(axis): keys of a map column that every row has."""
    n = rows.agg(F.count("*").alias("n"))
    keys = rows.select(F.explode(F.array_distinct(F.map_keys(meta))).alias("axis")).groupBy("axis").agg(F.count("*").alias("c"))
    return keys.crossJoin(F.broadcast(n)).filter("c = n").select("axis")


def subgroup_rates(rows: DataFrame, axes: dict[str, Column], threshold: DataFrame, floor: int = GROUP_FLOOR) -> DataFrame:
    """(axis, value, n_neg, n_pos, fpr, tpr, rate_withheld) of (score, y) rows at a fixed threshold.

    ``threshold`` is one row (threshold). Each rate is withheld (null) below ``floor`` of its class.
    One aggregation over all axes; never their cross product."""
    flagged = F.col("score") >= F.col("threshold")
    neg, pos = F.col("y") == 0, F.col("y") == 1
    g = long_axes(rows.crossJoin(F.broadcast(threshold)), axes).groupBy("axis", "value").agg(
        F.count_if(neg).alias("n_neg"), F.count_if(pos).alias("n_pos"), F.count_if(neg & flagged).alias("fp"), F.count_if(pos & flagged).alias("tp")
    )
    rate = lambda k, n: F.when(F.col(n) >= floor, F.try_divide(F.col(k).cast("double"), F.col(n).cast("double")))
    return g.select("axis", "value", "n_neg", "n_pos", rate("fp", "n_neg").alias("fpr"), rate("tp", "n_pos").alias("tpr"), ((F.col("n_neg") < floor) | (F.col("n_pos") < floor)).alias("rate_withheld"))


def max_disparity(rates: DataFrame) -> DataFrame:
    """(axis, gap, worst_group, worst_fpr, best_group, best_fpr, ratio): spread of reported
    false-positive rates; ties go to the value that sorts first; null below two groups."""
    seen = rates.filter("fpr is not null").groupBy("axis").agg(
        F.min(F.struct((-F.col("fpr")).alias("k"), "value")).alias("worst"), F.min(F.struct(F.col("fpr").alias("k"), "value")).alias("best"), F.count("*").alias("n")
    )
    every = rates.select("axis").distinct().join(seen, "axis", "left")
    two, w, b = F.col("n") >= 2, -F.col("worst.k"), F.col("best.k")
    return every.select(
        "axis", F.when(two, w - b).alias("gap"), F.when(two, F.col("worst.value")).alias("worst_group"), F.when(two, w).alias("worst_fpr"),
        F.when(two, F.col("best.value")).alias("best_group"), F.when(two, b).alias("best_fpr"), F.when(two & (b > 0), w / b).alias("ratio"),
    )


def ppv(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    """Share of flagged that are positive; NaN where nothing is flagged."""
    hit, miss = tpr * prevalence, fpr * (1 - prevalence)
    return F.when(hit + miss > 0, F.try_divide(hit, hit + miss)).otherwise(F.lit(float("nan")))


def base_rate_table(thresholds: DataFrame, prevalences=PREVALENCES, volume: int = VOLUME) -> DataFrame:
    """(target_fpr, prevalence, wrongly_flagged, ppv): consequences of a target rate, from the
    target false-positive rate and the achieved true-positive rate."""
    p = F.explode(F.array(*(F.lit(float(x)) for x in prevalences))).alias("prevalence")
    t = thresholds.select("target_fpr", "achieved_tpr", p)
    value = ppv(F.col("achieved_tpr"), F.col("target_fpr"), F.col("prevalence"))
    return t.select("target_fpr", "prevalence", (F.col("target_fpr") * volume).alias("wrongly_flagged"), F.when(F.col("achieved_tpr").isNotNull(), value).alias("ppv"))
