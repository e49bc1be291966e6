"""Bootstrap intervals in three tiers.

T1 draws with numpy's generator over one bounded group, bit for bit reproducible in row order; T2
draws a proportion's resamples from its counts alone; T3 gives every row a Poisson(1) weight from
a hash of (row, replicate, seed), which needs no row order, no shuffle of rows and works at any
size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.plans.prefix import running_totals
from plumbline.plans.shared import materialize

N_BOOT, SEED, LEVEL = 1000, 17, 0.95
#: Rows a T1 group may have: its index matrix is N_BOOT times as many numbers.
EXACT_ROWS = 50_000
#: Distribution function of Poisson(1) at 0..9; beyond that the weight counts as 10.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]


def _ends(level: float) -> list[float]:
    return [(1 - level) / 2, 1 - (1 - level) / 2]


def proportion_ci(rows: DataFrame, flag: str, by: list[str], n_boot: int = N_BOOT, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(by..., n, rate, lo, hi), T2: a resample's sum is binomial, so counts are all it takes."""
    counts = rows.groupBy(*by).agg(F.count(flag).alias("n"), F.sum(F.col(flag).cast("long")).alias("k"))

    def draw(parts):
        for pdf in parts:
            lo, hi = [], []
            for n, k in zip(pdf["n"], pdf["k"]):
                x = np.random.default_rng(seed).binomial(int(n), k / n if n else 0.0, n_boot) / max(int(n), 1)
                a, b = np.quantile(x, _ends(level)) if n else (np.nan, np.nan)
                lo.append(a)
                hi.append(b)
            yield pdf.assign(rate=pdf["k"] / pdf["n"], lo=lo, hi=hi).drop(columns="k")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name != "k")
    return counts.mapInPandas(draw, f"{schema}, rate double, lo double, hi double")


def exact_ci(rows: DataFrame, statistic, order: str, level: float = LEVEL, n_boot: int = N_BOOT, seed: int = SEED, most: int = EXACT_ROWS) -> DataFrame:
    """(value, lo, hi, n_boot_used, refusal), T1: ``statistic(neg, pos)`` under resampling within
    each class of (score, y) in the order of ``order``. Refused over ``most`` rows: for those,
    :func:`weighted_ci` takes any statistic of weighted counts. Replicates are drawn and weighed a few
    at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            return pd.DataFrame({"value": [np.nan], "lo": [np.nan], "hi": [np.nan], "n_boot_used": [0], "refusal": [f"over {most} rows; use weighted_ci"]})
        pdf = pdf.sort_values(order, kind="stable")
        neg, pos = (pdf.loc[pdf["y"] == k, "score"].to_numpy(float) for k in (0, 1))
        # All draws of one class come before those of the other: a second generator, put past the first
        # class's draws, lets both be drawn in step.
        first, second = np.random.default_rng(seed), np.random.default_rng(seed)
        step = max(1, _AT_ONCE // max(1, len(neg) + len(pos)))
        cuts = [min(step, n_boot - k) for k in range(0, n_boot, step)]
        for n in cuts:
            second.integers(0, max(1, len(neg)), (n, len(neg)))
        many = _areas(neg, pos) if statistic is area else None
        found = []
        for n in cuts:
            a, b = first.integers(0, max(1, len(neg)), (n, len(neg))), second.integers(0, max(1, len(pos)), (n, len(pos)))
            found += many(a, b) if many else [s for s in (statistic(neg[x], pos[y]) for x, y in zip(a, b)) if s is not None]
        lo, hi = np.quantile(np.array(found, float), _ends(level))
        return pd.DataFrame({"value": [statistic(neg, pos)], "lo": [lo], "hi": [hi], "n_boot_used": [len(found)], "refusal": [None]})

    # Bounded: at most ``most`` + 1 rows reach the one task.
    bounded = rows.select("score", "y", order).limit(most + 1)
    return bounded.groupBy(F.lit(1).alias("all")).applyInPandas(run, "value double, lo double, hi double, n_boot_used int, refusal string")


#: Numbers drawn at once.
_AT_ONCE = 1 << 20


def area(neg: np.ndarray, pos: np.ndarray) -> float:
    """AUROC by sorting: ties count half."""
    order = np.sort(neg)
    below, upto = np.searchsorted(order, pos, "left"), np.searchsorted(order, pos, "right")
    return float((below + upto).sum() / 2 / (len(neg) * len(pos)))


def _areas(neg: np.ndarray, pos: np.ndarray):
    """``area`` of many resamples given as indices: scores become ranks once, and a resample is counted
    at each rank instead of sorted."""
    kinds = np.unique(np.concatenate([neg, pos]))
    a, b = np.searchsorted(kinds, neg).astype(np.int32), np.searchsorted(kinds, pos).astype(np.int32)

    def run(left: np.ndarray, right: np.ndarray) -> list[float]:
        out = []
        for x, y in zip(left, right):
            n, p = np.bincount(a[x], minlength=len(kinds)), np.bincount(b[y], minlength=len(kinds))
            below = np.cumsum(n)
            out.append(float(p @ (2 * below - n)) / 2 / (len(neg) * len(pos)))
        return out

    return run


def uniform(key: Column, replicate: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from md5 of "key:replicate:seed", the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_weight(u: Column) -> Column:
    return sum((F.when(u >= F.lit(p), 1).otherwise(0) for p in _POISSON), F.lit(0))


def weighted(rows: DataFrame, key: str, n_boot: int, seed: int = SEED) -> DataFrame:
    """``rows`` once for each replicate in which their weight isn't zero: columns replicate, weight."""
    every = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    return every.withColumn("weight", poisson_weight(uniform(F.col(key), F.col("replicate"), seed))).filter("weight > 0")


def weighted_ci(rows: DataFrame, key: str, statistic, n_boot: int = 50, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(n_boot, lo, hi), T3 at any size: the interval of any statistic of (score, y). ``statistic``
    takes (replicate, score, one, zero), the weights of both classes at each distinct score of each
    replicate, and returns (replicate, value)."""
    w = materialize(_both_weighted(rows.filter("y = 1"), rows.filter("y = 0"), key, n_boot, seed), "weights")
    return _interval(statistic(w), "value", [], level)


def _interval(replicates: DataFrame, value: str, by: list[str], level: float) -> DataFrame:
    """(by..., n_boot, lo, hi) of one value for each replicate."""
    ends = replicates.groupBy(*by).agg(F.count(value).alias("n_boot"), F.percentile(value, F.array(*(F.lit(e) for e in _ends(level)))).alias("e"))
    return ends.select(*by, "n_boot", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))


def poisson_rate_ci(rows: DataFrame, flag: str, key: str, n_boot: int = 50, seed: int = SEED, level: float = LEVEL, by: list[str] | None = None) -> DataFrame:
    """(by..., n_boot, rate, lo, hi), T3: a proportion's interval from hashed weights."""
    by = by or []
    w = weighted(rows.select(*by, key, flag), key, n_boot, seed).groupBy(*by, "replicate").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col(flag), F.col("weight")).otherwise(0)).alias("k"))
    ends = _interval(w.withColumn("r", F.col("k").cast("double") / F.col("n")), "r", by, level)
    point = rows.groupBy(*by).agg(F.avg(F.col(flag).cast("double")).alias("rate"))
    joined = ends.join(point, by) if by else ends.crossJoin(point)
    return joined.select(*by, "n_boot", "rate", "lo", "hi")


def _both_weighted(ones: DataFrame, zeros: DataFrame, key: str, n_boot: int, seed: int) -> DataFrame:
    """(replicate, score, one, zero): weights of two populations at each score."""
    rows = ones.select(key, "score", F.lit(1).alias("p")).unionByName(zeros.select(key, "score", F.lit(0).alias("p")))
    part = lambda p: F.sum(F.when(F.col("p") == p, F.col("weight")).otherwise(0))
    return weighted(rows, key, n_boot, seed).groupBy("replicate", "score").agg(part(1).alias("one"), part(0).alias("zero"))


def weighted_area(weights: DataFrame) -> DataFrame:
    """(replicate, value): AUROC of each replicate."""
    up = running_totals(weights, "score", ["zero"], within=["replicate"])
    won = F.sum(F.col("one") * (F.col("zero_upto") - F.col("zero") / 2))
    return up.groupBy("replicate").agg(F.try_divide(won, F.sum("zero").cast("double") * F.sum("one").cast("double")).alias("value"))


def poisson_auroc_ci(rows: DataFrame, key: str, n_boot: int = 50, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(n_boot, lo, hi), T3: AUROC per replicate from weighted counts at each distinct score."""
    return weighted_ci(rows, key, weighted_area, n_boot, seed, level)


def _poisson_weights(h: np.ndarray, n_boot: int) -> np.ndarray:
    """(rows, n_boot) Poisson(1) weights from 64-bit row hashes: splitmix of hash and replicate."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64)[:, None] + np.arange(1, n_boot + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u.ravel(), side="right").reshape(u.shape).astype(np.float64)


class _Sweep:
    """Sums of every replicate over rows in ascending order of score. The first score of the sweep and
    the one it is at stay open: neighbouring sweeps may have them too."""

    def __init__(self, n_boot: int):
        zero = lambda: np.zeros(n_boot)
        self.won, self.neg, self.pos = zero(), zero(), zero()
        self.first, self.last = None, None

    def add(self, score: float, neg: np.ndarray, pos: np.ndarray) -> None:
        if self.last is not None and self.last[0] == score:
            self.last = score, self.last[1] + neg, self.last[2] + pos
        else:
            self._close()
            self.last = score, neg, pos

    def inner(self, won, neg, pos) -> None:
        """What lies between two open scores of a neighbour."""
        self._close()
        self.won, self.neg, self.pos = self.won + won + pos * self.neg, self.neg + neg, self.pos + pos

    def _close(self) -> None:
        if self.last is None:
            return
        score, neg, pos = self.last
        if self.first is None:
            self.first = self.last
        else:
            self.won, self.neg, self.pos = self.won + pos * (self.neg + neg / 2), self.neg + neg, self.pos + pos
        self.last = None


def swept_area_ci(rows: DataFrame, key: str, n_boot: int = N_BOOT, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(value, n_boot, lo, hi): AUROC of (score, y) with T3 weights at any size. Rows are range-sorted by
    score; each range sums all replicates in one sweep, and what the ranges hand on is three numbers a
    replicate and their open ends. No row is copied once for each replicate. Equal scores may lie in
    several ranges, so a score that a third of the rows have is no single task's."""
    h = F.xxhash64(F.col(key), F.lit(seed)).alias("h")
    ranged = rows.select(F.col("score").cast("double").alias("score"), F.col("y").cast("int").alias("y"), h).repartitionByRange("score", "h").sortWithinPartitions("score", "h")
    blob = lambda x: np.stack(x).tobytes()

    def sweep(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        # Replicate 0 has weight one everywhere: it is the value itself.
        s, step = _Sweep(n_boot + 1), max(1, _AT_ONCE // (n_boot + 1))
        for batch in batches:
            score, y, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in range(0, len(score), step):
                part, one = score[k : k + step], y[k : k + step, None] == 1
                w = np.concatenate([np.ones((len(part), 1)), _poisson_weights(h[k : k + step], n_boot)], axis=1)
                cuts = np.flatnonzero(np.diff(part, prepend=np.nan) != 0)
                neg, pos = np.add.reduceat(w * ~one, cuts), np.add.reduceat(w * one, cuts)
                for x, a, b in zip(part[cuts].tolist(), neg, pos):
                    s.add(x, a, b)
        if s.last is not None:
            end, s.last = s.last, None
            whole = s.first is None
            first = end if whole else s.first
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first[0]]), pa.array([end[0]]), pa.array([whole]), *(pa.array([x], pa.binary()) for x in (blob(first[1:]), blob((s.won, s.neg, s.pos)), blob(end[1:])))],
                ["part", "low", "high", "whole", "first", "inner", "last"],
            )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _Sweep(n_boot + 1)
        s.first = (-np.inf, np.zeros(n_boot + 1), np.zeros(n_boot + 1))
        load = lambda x: np.frombuffer(x).reshape(-1, n_boot + 1)
        for r in pdf.sort_values("part").itertuples():
            s.add(r.low, *load(r.first))
            if not r.whole:
                s.inner(*load(r.inner))
                s.add(r.high, *load(r.last))
        s._close()
        with np.errstate(invalid="ignore", divide="ignore"):
            got = s.won / (s.neg * s.pos)
        found = got[1:][np.isfinite(got[1:])]
        lo, hi = np.quantile(found, _ends(level)) if len(found) else (np.nan, np.nan)
        return pd.DataFrame({"value": [got[0]], "n_boot": [len(found)], "lo": [lo], "hi": [hi]})

    parts = ranged.mapInArrow(sweep, "part int, low double, high double, whole boolean, first binary, inner binary, last binary")
    # A row for each range.
    return parts.groupBy(F.lit(1).alias("all")).applyInPandas(join, "value double, n_boot int, lo double, hi double")


def auroc_ci(rows: DataFrame, key: str, level: float = LEVEL, n_boot: int = N_BOOT, seed: int = SEED, most: int = EXACT_ROWS) -> DataFrame:
    """(value, lo, hi, n_boot_used, refusal) of (score, y) at any size: T1 in the order of ``key`` up
    to ``most`` rows, which is what a published interval of that size was drawn by, beyond that T3 in
    one sweep over the sorted scores."""
    if rows.limit(most + 1).count() <= most:
        return exact_ci(rows, area, key, level, n_boot, seed, most)
    return swept_area_ci(rows, key, n_boot, seed, level).select("value", "lo", "hi", F.col("n_boot").alias("n_boot_used"), F.lit(None).cast("string").alias("refusal"))


def poisson_ks_ci(reference: DataFrame, candidate: DataFrame, key: str, n_boot: int = 50, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(n_boot, lo, hi), T3: the largest gap of both distribution functions in each replicate."""
    w = materialize(_both_weighted(reference, candidate, key, n_boot, seed), "weights")
    up = running_totals(w, "score", ["one", "zero"], within=["replicate"])
    whole = w.groupBy("replicate").agg(F.sum("one").cast("double").alias("n1"), F.sum("zero").cast("double").alias("n0"))
    gap = F.abs(F.try_divide("one_upto", "n1") - F.try_divide("zero_upto", "n0"))
    return _interval(up.join(F.broadcast(whole), "replicate").groupBy("replicate").agg(F.max(gap).alias("ks")), "ks", [], level)


def poisson_shift_ci(reference: DataFrame, candidate: DataFrame, key: str, qs, n_boot: int = 50, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(q, n_boot, lo, hi), T3: candidate quantile less reference quantile in each replicate, linear
    between order statistics of the weighted rows, which running totals find: no replicate's scores
    meet in one task."""
    from plumbline.operators.shift import between, order_pair

    w = materialize(_both_weighted(reference, candidate, key, n_boot, seed), "weights")
    totals = w.groupBy("replicate").agg(F.sum("one").alias("n_one"), F.sum("zero").alias("n_zero"))
    up = running_totals(w, "score", ["one", "zero"], within=["replicate"]).join(totals, "replicate")
    s = up.groupBy("replicate").agg(*(x for q in qs for side in ("one", "zero") for x in order_pair(side, q)))
    rows = [F.struct(F.lit(float(q)).alias("q"), (between("zero", q) - between("one", q)).alias("delta")) for q in qs]
    z = s.select("replicate", F.explode(F.array(*rows)).alias("z")).select("replicate", F.col("z.q").alias("q"), F.col("z.delta").alias("delta"))
    return _interval(z, "delta", ["q"], level)


def poisson_ece_ci(rows: DataFrame, key: str, by: list[str], bins: int = 10, n_boot: int = 50, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(by..., n_boot, lo, hi), T3: calibration error of (confidence, correct), pairs resampled."""
    b = F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    w = weighted(rows.select(*by, key, "confidence", "correct", b.alias("bin")), key, n_boot, seed)
    # A bin's share times its gap is the absolute difference of its weighted sums over all weight.
    cell = w.groupBy(*by, "replicate", "bin").agg(F.sum("weight").alias("n"), F.abs(F.sum(F.col("weight") * F.col("confidence")) - F.sum(F.col("weight") * F.col("correct").cast("double"))).alias("d"))
    return _interval(cell.groupBy(*by, "replicate").agg((F.sum("d") / F.sum("n")).alias("ece")), "ece", by, level)
