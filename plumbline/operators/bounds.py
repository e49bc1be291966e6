"""Finite-sample conformal bounds from order statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.prefix import running_totals
from plumbline.plans.shared import materialize

ALPHAS = (0.05, 0.01, 0.005)


def check_alpha(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    return float(alpha)


def least_sample(alpha: float) -> int:
    """Reference rows that a one-sided bound at ``alpha`` needs."""
    return math.ceil(1 / check_alpha(alpha) - 1e-9) - 1


def least_sample_two_sided(alpha: float) -> int:
    return math.ceil(2 / check_alpha(alpha) - 1e-9) - 1


def next_up(x: float) -> float:
    """The next larger double, as a displayed threshold has it."""
    return math.nextafter(x, math.inf)


def _rank(n, alpha: float):
    """Rank of the order statistic, from an exact product of doubles."""
    return F.least(F.ceil((n + 1).cast("double") * F.lit(1 - alpha)), n)


def conformal_table(scores: DataFrame, alphas=ALPHAS) -> DataFrame:
    """One-sided bounds on the negatives of (score, y).

    (alpha, n_calibration, order_statistic, bound, conditional_fpr_mean, conditional_fpr_sd, tpr,
    refusal): flagged is a score strictly above ``bound``, the order statistic's value."""
    for a in alphas:
        check_alpha(a)
    flat = scores.groupBy("score").agg(F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos"))
    flat = materialize(flat, "bounds")
    up = running_totals(flat, "score", ["neg", "pos"])
    n = flat.agg(F.coalesce(F.sum("neg"), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"))
    met = up.crossJoin(F.broadcast(n))
    found = met.groupBy("n", "n_pos").agg(
        *(F.min_by(F.struct("score", "pos_upto"), F.when(F.col("neg_upto") >= _rank(F.col("n"), a), F.col("score"))).alias(f"s{k}") for k, a in enumerate(alphas))
    )
    rows = [F.struct(F.lit(float(a)).alias("alpha"), F.lit(least_sample(a)).alias("least"), _rank(F.col("n"), a).alias("k"), F.col(f"s{k}").alias("s")) for k, a in enumerate(alphas)]
    r = found.select(F.col("n").alias("n_calibration"), "n_pos", F.explode(F.array(*rows)).alias("r"))
    ok = F.col("n_calibration") >= F.col("r.least")
    a, b, m = F.col("n_calibration") + 1 - F.col("r.k"), F.col("r.k"), (F.col("n_calibration") + 1).cast("double")
    return r.select(
        F.col("r.alpha").alias("alpha"), "n_calibration",
        F.when(ok, F.col("r.k")).alias("order_statistic"), F.when(ok, F.col("r.s.score")).alias("bound"),
        F.when(ok, a / m).alias("conditional_fpr_mean"), F.when(ok, F.sqrt(a * b / (m * m * (m + 1)))).alias("conditional_fpr_sd"),
        F.when(ok, F.try_divide((F.col("n_pos") - F.col("r.s.pos_upto")).cast("double"), F.col("n_pos").cast("double"))).alias("tpr"),
        F.when(~ok, F.concat(F.lit("needs "), F.col("r.least").cast("string"), F.lit(" reference rows, has "), F.col("n_calibration").cast("string"))).alias("refusal"),
    )


def conformal_band(reference: DataFrame, alphas=ALPHAS) -> DataFrame:
    """Two-sided bands on (score): (alpha, n_reference, k, lo, hi, refusal). Outside is a score
    strictly below ``lo`` or strictly above ``hi``."""
    flat = reference.groupBy("score").agg(F.count("*").alias("n1"))
    flat = materialize(flat, "band")
    up = running_totals(flat, "score", ["n1"])
    met = up.crossJoin(F.broadcast(flat.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n"))))
    low = lambda a: F.when(F.col("n1_upto") >= F.col("n") + 1 - _rank(F.col("n"), a / 2), F.col("score"))
    high = lambda a: F.when(F.col("n1_upto") >= _rank(F.col("n"), a / 2), F.col("score"))
    found = met.groupBy("n").agg(*(F.struct(F.min(low(a)).alias("lo"), F.min(high(a)).alias("hi")).alias(f"s{k}") for k, a in enumerate(alphas)))
    rows = [F.struct(F.lit(float(a)).alias("alpha"), F.lit(least_sample_two_sided(a)).alias("least"), _rank(F.col("n"), a / 2).alias("k"), F.col(f"s{k}").alias("s")) for k, a in enumerate(alphas)]
    r = found.select(F.col("n").alias("n_reference"), F.explode(F.array(*rows)).alias("r"))
    ok = F.col("n_reference") >= F.col("r.least")
    return r.select(
        F.col("r.alpha").alias("alpha"), "n_reference", F.when(ok, F.col("r.k")).alias("k"), F.when(ok, F.col("r.s.lo")).alias("lo"), F.when(ok, F.col("r.s.hi")).alias("hi"),
        F.when(~ok, F.concat(F.lit("needs "), F.col("r.least").cast("string"), F.lit(" reference rows, has "), F.col("n_reference").cast("string"))).alias("refusal"),
    )
