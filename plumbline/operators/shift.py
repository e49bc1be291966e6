"""A candidate population held against a reference: bands, distance, quantiles, placements.

Both populations are counted at each distinct score and totalled once; rank look-ups are then
equi-joins on the score, never range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.bounds import ALPHAS, conformal_band
from plumbline.operators.strata import GROUP_FLOOR, long_axes
from plumbline.plans.prefix import running_totals
from plumbline.plans.shared import materialize

QUANTILES = (0.1, 0.5, 0.9)
CANDIDATE_FLOOR = 20


MODES = ("all", "human", "ai")


def reference_rows(scores: DataFrame, mode: str = "all") -> DataFrame:
    """The reference that candidates are held against: all labelled rows or those of one class."""
    if mode not in MODES:
        raise ValueError(f"a reference is one of {', '.join(MODES)}, not {mode}")
    return scores if mode == "all" else scores.filter(F.col("label") == mode)


def two_sample(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(score, ref, cand, ref_upto, cand_upto, n_ref, n_cand) at each score of either."""
    both = reference.select("score", F.lit(1).alias("r")).unionByName(candidate.select("score", F.lit(0).alias("r")))
    flat = materialize(both.groupBy("score").agg(F.count_if(F.col("r") == 1).alias("ref"), F.count_if(F.col("r") == 0).alias("cand")), "two-sample")
    totals = flat.agg(F.sum("ref").alias("n_ref"), F.sum("cand").alias("n_cand"))
    return running_totals(flat, "score", ["ref", "cand"]).crossJoin(F.broadcast(totals))


def novelty_table(reference: DataFrame, candidate: DataFrame, alphas=ALPHAS) -> DataFrame:
    """(alpha, n_reference, n_candidate, lo, hi, n_outside, outside_rate, expected, refusal)."""
    band = conformal_band(reference, alphas)
    outside = (F.col("c.score") > F.col("hi")) | (F.col("c.score") < F.col("lo"))
    met = candidate.select("score").alias("c").crossJoin(F.broadcast(band))
    counts = met.groupBy("alpha").agg(F.count("*").alias("n_candidate"), F.count_if(outside).alias("out"))
    j = band.join(counts, "alpha", "left")
    ok, n = F.col("refusal").isNull(), F.coalesce("n_candidate", F.lit(0))
    why = F.when(n < CANDIDATE_FLOOR, F.concat(F.lit(f"needs {CANDIDATE_FLOOR} candidate rows, has "), n.cast("string")))
    ok = ok & why.isNull()
    return j.select(
        "alpha", "n_reference", n.alias("n_candidate"), "lo", "hi", F.when(ok, F.col("out")).alias("n_outside"),
        F.when(ok, F.try_divide(F.col("out").cast("double"), n.cast("double"))).alias("outside_rate"), F.col("alpha").alias("expected"), F.coalesce("refusal", why).alias("refusal"),
    )


def ks_distance(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(n_reference, n_candidate, ks): largest gap of the two distribution functions."""
    gap = F.abs(F.try_divide(F.col("ref_upto").cast("double"), F.col("n_ref").cast("double")) - F.try_divide(F.col("cand_upto").cast("double"), F.col("n_cand").cast("double")))
    return two_sample(reference, candidate).agg(F.max("n_ref").alias("n_reference"), F.max("n_cand").alias("n_candidate"), F.max(gap).alias("ks"))


def quantile_shift(reference: DataFrame, candidate: DataFrame, qs=QUANTILES) -> DataFrame:
    """(q, reference_q, candidate_q, delta), linear between order statistics: each is the smallest score
    with enough rows up to it, so no task holds a population."""
    up = two_sample(reference, candidate)
    s = up.agg(*(x for q in qs for side in ("ref", "cand") for x in order_pair(side, q)))
    rows = [F.struct(F.lit(float(q)).alias("q"), *(between(side, q).alias(side) for side in ("ref", "cand"))) for q in qs]
    z = s.select(F.explode(F.array(*rows)).alias("z"))
    return z.select(F.col("z.q").alias("q"), F.col("z.ref").alias("reference_q"), F.col("z.cand").alias("candidate_q"), (F.col("z.cand") - F.col("z.ref")).alias("delta"))


def order_pair(side: str, q: float):
    """Aggregates over running totals: how far between two neighbouring order statistics the quantile
    lies, and both of them. ``side`` has its total in n_<side> and its running total in <side>_upto."""
    at = (F.col(f"n_{side}") - 1).cast("double") * F.lit(float(q))
    pick = lambda k: F.min(F.when((F.col(side) > 0) & (F.col(f"{side}_upto") > k), F.col("score")))
    name = f"_{side}_{q!r}".replace(".", "_")
    return [F.max(at - F.floor(at)).alias(f"{name}_part"), pick(F.floor(at)).alias(f"{name}_low"), pick(F.ceil(at)).alias(f"{name}_high")]


def between(side: str, q: float) -> Column:
    name = f"_{side}_{q!r}".replace(".", "_")
    part, low, high = (F.col(f"{name}_{x}") for x in ("part", "low", "high"))
    # As the weighted mean of both, which is what the percentile of a sorted column is.
    return F.when(part == 0, low).otherwise((1 - part) * low + part * high)


def placements(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """``candidate`` rows with percentile_ref (share of the reference at or below; NaN without a
    reference) and conformal_p, two-sided."""
    at = two_sample(reference, candidate).filter("cand > 0")
    n, upto = F.col("n_ref").cast("double"), F.col("ref_upto")
    over = F.col("n_ref") - upto + F.col("ref")
    percentile = F.when(F.col("n_ref") > 0, F.try_divide(upto.cast("double"), n)).otherwise(F.lit(float("nan")))
    p = F.least(F.lit(1.0), 2 * F.least((1 + over) / (n + 1), (1 + upto) / (n + 1)))
    return candidate.join(at.select("score", percentile.alias("percentile_ref"), p.alias("conformal_p")), "score")


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., m): the median of each group, from running totals of its distinct values, so that no
    group meets in one task."""
    flat = materialize(rows.groupBy(*by, F.col(value).alias("score")).agg(F.count("*").alias("one")), "medians")
    totals = flat.groupBy(*by).agg(F.sum("one").alias("n_one"))
    up = running_totals(flat, "score", ["one"], within=by).join(totals, by)
    return up.groupBy(*by).agg(*order_pair("one", 0.5)).select(*by, between("one", 0.5).alias("m"))


def strata_novelty(reference: DataFrame, candidate: DataFrame, axes: dict[str, Column], alphas=ALPHAS, floor: int = GROUP_FLOOR) -> DataFrame:
    """(axis, value, n, n_baseline, outside_rate, median_percentile, rate_withheld) at the first
    alpha that the reference supports."""
    band = conformal_band(reference, alphas).filter("refusal is null").agg(F.min_by(F.struct("lo", "hi"), F.array_position(F.array(*(F.lit(float(a)) for a in alphas)), F.col("alpha"))).alias("b"))
    placed = placements(reference, candidate).crossJoin(F.broadcast(band))
    out = (F.col("score") > F.col("b.hi")) | (F.col("score") < F.col("b.lo"))
    long = long_axes(placed, axes)
    g = long.groupBy("axis", "value").agg(F.count("*").alias("n"), F.count_if(out).alias("k"), F.count("b").alias("banded")).join(medians(long, ["axis", "value"], "percentile_ref"), ["axis", "value"])
    base = long_axes(reference, axes).groupBy("axis", "value").agg(F.count("*").alias("n_baseline"))
    enough = F.col("n") >= floor
    return g.join(base, ["axis", "value"], "left").select(
        "axis", "value", "n", F.coalesce("n_baseline", F.lit(0)).alias("n_baseline"),
        F.when(enough & (F.col("banded") > 0), F.try_divide(F.col("k").cast("double"), F.col("n").cast("double"))).alias("outside_rate"), F.when(enough, F.col("m")).alias("median_percentile"), (~enough).alias("rate_withheld"),
    )
