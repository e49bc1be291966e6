"""Monitors over interval series: (series, t, value, is_reference).

Running means, sums and minima are windows partitioned by series, so a series' intervals are the
only thing that meets in a task. None resets after an alarm: alarms persist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.bounds import least_sample

PH_DELTA, PH_LAMBDA = 0.005, 0.05
CUSUM_K, CUSUM_H = 0.01, 0.05
ALPHA = 0.2


def oriented(series: DataFrame, direction: str = "down") -> DataFrame:
    """Values signed so that a rise is the change looked for."""
    if direction not in ("up", "down"):
        raise ValueError("direction is up or down")
    return series.withColumn("x", F.when(F.lit(direction == "down"), -F.col("value")).otherwise(F.col("value")))


def _upto():
    return Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _centre(series: DataFrame) -> DataFrame:
    return series.filter("is_reference").groupBy("series").agg(F.avg("x").alias("centre"), F.count("*").alias("n_reference"))


def page_hinkley(series: DataFrame, direction: str = "down", delta: float = PH_DELTA, lam: float = PH_LAMBDA) -> DataFrame:
    """(series, t, statistic, alarm) over the observed intervals: the running sum of deviations from
    the running mean, less ``delta`` each, above its lowest point so far (at most zero)."""
    x = oriented(series, direction).filter("NOT is_reference")
    x = x.withColumn("dev", F.col("x") - F.avg("x").over(_upto()) - F.lit(delta))
    x = x.withColumn("m", F.sum("dev").over(_upto()))
    x = x.withColumn("statistic", F.col("m") - F.least(F.lit(0.0), F.min("m").over(_upto())))
    return x.select("series", "t", "statistic", (F.col("statistic") > lam).alias("alarm"))


def cusum(series: DataFrame, direction: str = "down", k: float = CUSUM_K, h: float = CUSUM_H) -> DataFrame:
    """(series, t, statistic, alarm): S = max(0, S + x - centre - k), as the running sum above its
    lowest point so far (Lindley), which needs no recursion. The centre is the reference's mean."""
    x = oriented(series, direction)
    o = x.filter("NOT is_reference").join(_centre(x), "series")
    o = o.withColumn("c", F.sum(F.col("x") - F.col("centre") - F.lit(k)).over(_upto()))
    o = o.withColumn("statistic", F.col("c") - F.least(F.lit(0.0), F.min("c").over(_upto())))
    return o.select("series", "t", "statistic", (F.col("statistic") > h).alias("alarm"))


def conformal_alarm(series: DataFrame, direction: str = "down", alpha: float = ALPHA) -> DataFrame:
    """(series, t, statistic, alarm, bound, n_reference, refusal): the observed value, oriented,
    strictly above the reference's order statistic; refused below the sample it needs."""
    need = least_sample(alpha)
    x = oriented(series, direction)
    rank = F.row_number().over(Window.partitionBy("series").orderBy("x"))
    r = x.filter("is_reference").withColumn("r", rank).withColumn("n", F.count("*").over(Window.partitionBy("series")))
    k = F.least(F.ceil((F.col("n") + 1).cast("double") * F.lit(1 - alpha)), F.col("n"))
    b = r.groupBy("series").agg(F.max(F.when(F.col("r") == k, F.col("x"))).alias("bound"), F.max("n").alias("n_reference"))
    o = x.filter("NOT is_reference").join(b, "series", "left")
    n = F.coalesce("n_reference", F.lit(0))
    ok = n >= need
    shown = F.when(F.lit(direction == "down"), -F.col("bound")).otherwise(F.col("bound"))
    return o.select(
        "series", "t", F.col("x").alias("statistic"), F.when(ok, F.col("x") > F.col("bound")).alias("alarm"), F.when(ok, shown).alias("bound"), n.alias("n_reference"),
        F.when(~ok, F.concat(F.lit(f"needs {need} reference intervals, has "), n.cast("string"))).alias("refusal"),
    )


def panel(series: DataFrame, direction: str = "down", alpha: float = ALPHA) -> DataFrame:
    """(monitor, series, t, statistic, alarm, refusal) of all three monitors."""
    none = F.lit(None).cast("string").alias("refusal")
    pick = lambda df, name, why: df.select(F.lit(name).alias("monitor"), "series", "t", "statistic", "alarm", why)
    out = pick(conformal_alarm(series, direction, alpha), "conformal", F.col("refusal"))
    return out.unionByName(pick(page_hinkley(series, direction), "page_hinkley", none)).unionByName(pick(cusum(series, direction), "cusum", none))


def scorecard(alarms: DataFrame, onset: int) -> DataFrame:
    """(monitor, series, false_alarms, latency): alarms before a known onset, and how long after it
    the first one came (null: never)."""
    hit = F.col("alarm") & (F.col("t") >= onset)
    return alarms.groupBy("monitor", "series").agg(
        F.count_if(F.col("alarm") & (F.col("t") < onset)).alias("false_alarms"), (F.min(F.when(hit, F.col("t"))) - onset).alias("latency")
    )


def interval_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(key, window, n, total) of raw events: intervals that feed the monitors. On a stream, events
    over ``late`` behind the newest are dropped."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")
