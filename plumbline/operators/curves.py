"""ROC statistics of a scored table: (score double, y int: 1 positive, 0 negative).

Rows are collapsed to distinct scores first, so everything after the first aggregation is as large
as the number of distinct scores; ties share their midrank by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.prefix import running_totals
from plumbline.plans.shared import materialize

#: Rows of each class below which no ROC statistic is given.
CLASS_FLOOR = 50
TARGETS = (0.01, 0.05)


def collapse(scores: DataFrame) -> DataFrame:
    """(score, neg, pos): counts of both classes at each distinct score, written once."""
    return materialize(scores.groupBy("score").agg(F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos")), "counts")


def class_refusal(neg, pos, floor: int = CLASS_FLOOR):
    """Why there is no statistic, or null."""
    few = (F.coalesce(neg, F.lit(0)) < floor) | (F.coalesce(pos, F.lit(0)) < floor)
    return F.when(few, F.concat(F.lit(f"needs {floor} rows of each class, has "), F.coalesce(neg, F.lit(0)).cast("string"), F.lit(" and "), F.coalesce(pos, F.lit(0)).cast("string")))


def class_counts(scores: DataFrame) -> DataFrame:
    """(n_neg, n_pos, refusal)."""
    n = scores.agg(F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y") == 1).alias("n_pos"))
    return n.withColumn("refusal", class_refusal(F.col("n_neg"), F.col("n_pos")))


def curve(scores: DataFrame) -> DataFrame:
    """(threshold, fp, tp, n_neg, n_pos, fpr, tpr): flagged is a score at or above the threshold."""
    flat = collapse(scores)
    totals = flat.agg(F.sum("neg").alias("n_neg"), F.sum("pos").alias("n_pos"))
    up = running_totals(flat, "score", ["neg", "pos"]).crossJoin(F.broadcast(totals))
    up = up.select(
        F.col("score").alias("threshold"), "neg", "pos", "n_neg", "n_pos",
        (F.col("n_neg") - F.col("neg_upto") + F.col("neg")).alias("fp"), (F.col("n_pos") - F.col("pos_upto") + F.col("pos")).alias("tp"),
    )
    rate = lambda k, n: F.try_divide(F.col(k).cast("double"), F.col(n).cast("double"))
    return up.select("*", rate("fp", "n_neg").alias("fpr"), rate("tp", "n_pos").alias("tpr"))


def roc_curve(scores: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr); no rows below the class floor."""
    c = curve(scores)
    return c.filter(class_refusal(F.col("n_neg"), F.col("n_pos")).isNull()).select("threshold", "fpr", "tpr")


def midranks(scores: DataFrame) -> DataFrame:
    """``scores`` with ``midrank``: 1-based rank, ties sharing the mean of theirs."""
    flat = materialize(scores.groupBy("score").agg(F.count("*").alias("n")), "ranks")
    ranked = running_totals(flat, "score", ["n"])
    ranked = ranked.select("score", (F.col("n_upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("midrank"))
    return scores.join(ranked, "score")


def auroc(scores: DataFrame) -> DataFrame:
    """(n_neg, n_pos, auroc, refusal): pairs in which the positive scores higher, ties counting half."""
    up = running_totals(collapse(scores), "score", ["neg"])
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / F.lit(2.0))
    s = up.agg(F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.sum(won).alias("u"))
    why = class_refusal(F.col("n_neg"), F.col("n_pos"))
    area = F.try_divide(F.col("u"), F.col("n_neg").cast("double") * F.col("n_pos").cast("double"))
    return s.select("n_neg", "n_pos", F.when(why.isNull(), area).alias("auroc"), why.alias("refusal"))


def equal_error_rate(scores: DataFrame) -> DataFrame:
    """(eer, threshold, refusal). Going down the thresholds, false positives only grow and misses
    only shrink, so the first crossing and the point before it are two extreme rows, no window."""
    c = curve(scores).select("threshold", "fpr", (1 - F.col("tpr")).alias("fnr"), "n_neg", "n_pos").withColumn("d", F.col("fpr") - F.col("fnr"))
    point, t = F.struct("threshold", "fpr", "fnr", "d"), F.col("threshold")
    s = c.agg(
        F.max_by(point, F.when(F.col("d") >= 0, t)).alias("at"), F.min_by(point, F.when(F.col("d") < 0, t)).alias("up"),
        F.max("n_neg").alias("n_neg"), F.max("n_pos").alias("n_pos"),
        F.count_if(F.col("d") >= 0).alias("some"), F.count_if(F.col("d") < 0).alias("under"),
    )
    why = class_refusal(F.col("n_neg"), F.col("n_pos"))
    plain = (F.col("under") == 0) | (F.col("at.d") == 0)
    weight = F.try_divide(F.col("up.d"), F.col("up.d") - F.col("at.d"))
    between = lambda k: F.col(f"up.{k}") + weight * (F.col(f"at.{k}") - F.col(f"up.{k}"))
    eer = F.when(plain, (F.col("at.fpr") + F.col("at.fnr")) / 2).otherwise(between("fpr"))
    return s.select(F.when(why.isNull(), eer).alias("eer"), F.when(why.isNull(), F.when(plain, F.col("at.threshold")).otherwise(between("threshold"))).alias("threshold"), why.alias("refusal"))


def threshold_at_fpr(scores: DataFrame, targets=TARGETS) -> DataFrame:
    """(target_fpr, threshold, achieved_fpr, achieved_tpr, refusal): the smallest observed score, of
    either class, whose false-positive rate is within the target; past the largest if none is."""
    c = curve(scores)
    tables = c.agg(
        F.max("threshold").alias("top"), F.max("n_neg").alias("n_neg"), F.max("n_pos").alias("n_pos"),
        *(F.min_by(F.struct("threshold", "fpr", "tpr"), F.when(F.col("fpr") <= F.lit(t), F.col("threshold"))).alias(f"s{k}") for k, t in enumerate(targets)),
        *(F.count_if(F.col("fpr") <= F.lit(t)).alias(f"m{k}") for k, t in enumerate(targets)),
    )
    rows = [F.struct(F.lit(float(t)).alias("target_fpr"), F.col(f"s{k}").alias("s"), F.col(f"m{k}").alias("met")) for k, t in enumerate(targets)]
    why = class_refusal(F.col("n_neg"), F.col("n_pos"))
    r = tables.select("top", why.alias("refusal"), F.explode(F.array(*rows)).alias("r"))
    ok, met = F.col("refusal").isNull(), F.col("r.met") > 0
    return r.select(
        F.col("r.target_fpr").alias("target_fpr"),
        F.when(ok, F.when(met, F.col("r.s.threshold")).otherwise(F.col("top") + F.lit(1e-9))).alias("threshold"),
        F.when(ok, F.when(met, F.col("r.s.fpr")).otherwise(0.0)).alias("achieved_fpr"),
        F.when(ok, F.when(met, F.col("r.s.tpr")).otherwise(0.0)).alias("achieved_tpr"),
        "refusal",
    )
