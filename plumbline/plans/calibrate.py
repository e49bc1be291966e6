"""The calibration of one scored table, all sections from one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.text import length_bucket
from plumbline.operators import bounds, curves, resample, strata


def meta_axes(scores: DataFrame) -> dict[str, Column]:
    """Subgroup axes of a score table: its length bucket and the keys that every row's ``meta`` has."""
    found = {"length": length_bucket("n_words")} if "n_words" in scores.columns else {}
    if "meta" in scores.columns:
        keys = sorted(r.axis for r in strata.shared_keys(scores.filter("meta IS NOT NULL")).collect()) if not scores.filter("meta IS NULL").limit(1).count() else []
        found |= {k: F.col("meta")[k] for k in keys}
    return found


def calibration_tables(scores: DataFrame, axes: dict[str, Column] | None = None, targets=curves.TARGETS, alphas=bounds.ALPHAS, key: str | None = None, n_boot: int = 50) -> dict[str, DataFrame]:
    """Every section of a calibration of (score, y): auroc, equal_error_rate, roc, thresholds,
    conformal, base_rate; subgroups and disparity with ``axes`` (at the largest target's threshold);
    auroc_ci and flag_ci, weighted by a hash of ``key``, with one."""
    thresholds = curves.threshold_at_fpr(scores, targets)
    tables = {
        "auroc": curves.auroc(scores), "equal_error_rate": curves.equal_error_rate(scores), "roc": curves.roc_curve(scores),
        "thresholds": thresholds, "conformal": bounds.conformal_table(scores, alphas), "base_rate": strata.base_rate_table(thresholds),
    }
    at = thresholds.filter(F.col("target_fpr") == max(targets)).select("threshold")
    if axes:
        tables["subgroups"] = strata.subgroup_rates(scores, axes, at)
        tables["disparity"] = strata.max_disparity(tables["subgroups"])
    if key:
        tables["auroc_ci"] = resample.poisson_auroc_ci(scores, key, n_boot)
        positive = scores.filter("y = 1").crossJoin(F.broadcast(thresholds.select("target_fpr", "threshold")))
        tables["flag_ci"] = resample.poisson_rate_ci(positive.select(key, "target_fpr", (F.col("score") >= F.col("threshold")).alias("flag")), "flag", key, n_boot, by=["target_fpr"])
    return tables


def admission_tables(reference: DataFrame, candidate: DataFrame, axes: dict[str, Column] | None = None, key: str | None = None, n_boot: int = 50) -> dict[str, DataFrame]:
    """Every section of a candidate held against a reference: novelty, ks, quantile_shift; strata
    with ``axes``; ks_ci and quantile_shift_ci with ``key``."""
    from plumbline.operators import shift

    tables = {"novelty": shift.novelty_table(reference, candidate), "ks": shift.ks_distance(reference, candidate), "quantile_shift": shift.quantile_shift(reference, candidate)}
    if axes:
        tables["strata"] = shift.strata_novelty(reference, candidate, axes)
    if key:
        tables["ks_ci"] = resample.poisson_ks_ci(reference, candidate, key, n_boot)
        tables["quantile_shift_ci"] = resample.poisson_shift_ci(reference, candidate, key, shift.QUANTILES, n_boot)
    return tables
