"""Hand-computed cases and brute-force twins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bounds, curves, drift, probes, resample, shift, strata


def scores(spark, neg, pos):
    return spark.createDataFrame([(float(s), 0) for s in neg] + [(float(s), 1) for s in pos], "score double, y int")


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "score double")


def test_equal_error_rate_by_hand(spark):
    r = curves.equal_error_rate(scores(spark, [0] * 75 + [10] * 25, [5] * 100)).first()
    assert (r.eer, r.threshold) == (0.25, 6.25)
    r = curves.equal_error_rate(scores(spark, [1] * 50 + [3] * 50, [2] * 50 + [4] * 50)).first()
    assert (r.eer, r.threshold) == (0.5, 3.0)
    assert curves.equal_error_rate(scores(spark, [1] * 50, [5] * 50)).first().eer == 0.0


def test_auroc_ties_and_floor(spark):
    assert curves.auroc(scores(spark, [0] * 60, [0] * 60)).first().auroc == 0.5
    low = curves.auroc(scores(spark, [0] * 49, [1] * 60)).first()
    assert low.auroc is None and "49" in low.refusal
    assert curves.auroc(scores(spark, [0] * 50, [1] * 50)).first().auroc == 1.0


@pytest.mark.parametrize("seed", range(3))
def test_auroc_and_thresholds_against_brute_force(spark, seed):
    g = np.random.default_rng(seed)
    neg, pos = np.round(g.normal(0, 1, 80), 1), np.round(g.normal(1, 1, 70), 1)
    s = scores(spark, neg, pos)
    assert curves.auroc(s).first().auroc == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]), abs=1e-12)
    for r in curves.threshold_at_fpr(s, (0.01, 0.05, 0.3)).collect():
        t = min((t for t in np.concatenate([neg, pos]) if (neg >= t).mean() <= r.target_fpr), default=max(neg.max(), pos.max()) + 1e-9)
        assert r.threshold == t and r.achieved_tpr == pytest.approx((pos >= t).mean())


def test_no_threshold_meets_the_target(spark):
    r = curves.threshold_at_fpr(scores(spark, [5] * 60, [1] * 60), (0.01,)).first()
    assert r.threshold == 5 + 1e-9 and r.achieved_fpr == 0 == r.achieved_tpr


def test_least_samples():
    assert [bounds.least_sample(a) for a in (0.05, 0.01, 0.005, 0.03)] == [19, 99, 199, 33]
    assert [bounds.least_sample_two_sided(a) for a in (0.05, 0.01, 0.005)] == [39, 199, 399]
    with pytest.raises(ValueError):
        bounds.least_sample(1.0)


def test_band_by_hand(spark):
    b = bounds.conformal_band(values(spark, range(1, 40)), (0.05,)).first()
    assert (b.k, b.lo, b.hi, b.refusal) == (39, 1.0, 39.0, None)
    assert bounds.conformal_band(values(spark, range(38)), (0.05,)).first().refusal
    flat = shift.novelty_table(values(spark, [5] * 39), values(spark, [4, 5, 6] * 10), (0.05,)).first()
    assert flat.n_outside == 20


def test_novelty_and_placements_by_hand(spark):
    n = shift.novelty_table(values(spark, range(1, 200)), values(spark, [0, 100, 300, 150] * 5), (0.01,)).first()
    assert (n.n_outside, n.outside_rate) == (10, 0.5)
    p = {r.score: r for r in shift.placements(values(spark, range(1, 100)), values(spark, [1000, 50])).collect()}
    assert p[1000.0].conformal_p == pytest.approx(0.02) and p[50.0].conformal_p == 1.0
    assert p[50.0].percentile_ref == pytest.approx(50 / 99)


def test_few_candidates_are_refused(spark):
    assert "19" in shift.novelty_table(values(spark, range(200)), values(spark, range(19)), (0.05,)).first().refusal


def test_ks_by_hand(spark):
    assert shift.ks_distance(values(spark, [0, 0, 0, 1]), values(spark, [1, 1, 1])).first().ks == 0.75


def test_conformal_order_statistic(spark):
    t = {r.alpha: r for r in bounds.conformal_table(scores(spark, range(100), [200] * 50)).collect()}
    assert t[0.01].order_statistic == 100 and t[0.01].tpr == 1.0 and "199" in t[0.005].refusal
    assert bounds.next_up(1.0) > 1.0


def test_small_group_is_withheld(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", float(k % 2), 0) for k in range(40)] + [("b", 1.0, 0)] * 5, "g string, score double, y int")
    t = spark.createDataFrame([(1.0,)], "threshold double")
    r = {x.value: x for x in strata.subgroup_rates(rows, {"g": F.col("g")}, t).collect()}
    assert r["a"].fpr == 0.5 and r["b"].fpr is None and r["b"].n_neg == 5 and r["b"].rate_withheld
    assert strata.max_disparity(strata.subgroup_rates(rows, {"g": F.col("g")}, t)).first().gap is None


def test_ppv(spark):
    from pyspark.sql import functions as F

    f = lambda t, q, p: spark.range(1).select(strata.ppv(F.lit(t), F.lit(q), F.lit(p)).alias("v")).first().v
    assert f(0.86, 0.01, 0.01) == pytest.approx(0.0086 / (0.0086 + 0.0099))
    assert math.isnan(f(0.0, 0.0, 0.5))


def test_ece_by_hand(spark):
    rows = spark.createDataFrame([("v", 0.8, True), ("v", 0.8, True), ("v", 0.9, False), ("v", 0.9, False), ("v", 1.5, True)], "vintage string, confidence double, correct boolean")
    r = probes.probability_block(rows, ["vintage"]).first()
    assert r.ece == pytest.approx(0.55) and r.gap == pytest.approx(0.35) and r.n_invalid == 1


def test_answers_normalise(spark):
    from pyspark.sql import functions as F

    from plumbline.functions.text import normalize_answer, normalize_any

    cases = {"The Answer": "answer", "the the answer": "the answer", "the": "the", "U.S.": "us", "well-known": "wellknown", "A cat": "cat"}
    more = {"A Straße": "strasse", "ﬁve": "five", None: ""}
    for fn, want in ((normalize_answer, cases), (normalize_any, cases | more)):
        got = {r.t: r.n for r in spark.createDataFrame([(k,) for k in want], "t string").select("t", fn(F.col("t")).alias("n")).collect()}
        assert got == want


def test_choice_tie(spark):
    r = probes.grade_choice(spark.createDataFrame([({"A": -1.0, "B": -1.0}, "A"), ({"A": -1.0, "B": -2.0}, "A"), ({"A": 1.0}, "Z")], "options map<string,double>, key string")).collect()
    assert (r[0].correct, r[0].chosen, r[0].tie) == (False, None, True) and r[1].correct and r[2].refusal


def _series(spark, ref, obs):
    return spark.createDataFrame([("s", k, float(v), k < len(ref)) for k, v in enumerate([*ref, *obs])], "series string, t int, value double, is_reference boolean")


def test_monitors_against_loops(spark):
    g = np.random.default_rng(3)
    ref, obs = 0.8 + 0.01 * g.standard_normal(10), np.r_[0.8 + 0.01 * g.standard_normal(6), 0.5 + 0.01 * g.standard_normal(6)]
    s = _series(spark, ref, obs)
    x, mean, m, low, cu, ph, cs = -obs, 0.0, 0.0, 0.0, 0.0, [], []
    for k, v in enumerate(x, 1):
        mean += (v - mean) / k
        m += v - mean - 0.005
        low = min(low, m)
        ph.append(m - low)
        cu = max(0.0, cu + v + ref.mean() - 0.01)
        cs.append(cu)
    assert [r.statistic for r in drift.page_hinkley(s).orderBy("t").collect()] == pytest.approx(ph, abs=1e-12)
    assert [r.statistic for r in drift.cusum(s).orderBy("t").collect()] == pytest.approx(cs, abs=1e-12)
    card = {r.monitor: r for r in drift.scorecard(drift.panel(s), 16).collect()}
    assert card["cusum"].latency == 0 and card["cusum"].false_alarms == 0
    few = drift.conformal_alarm(_series(spark, [1, 2, 3], [0])).first()
    assert few.alarm is None and few.refusal


def test_scorecard_by_hand(spark):
    a = spark.createDataFrame([("m", "s", t, t in (2, 7, 9)) for t in range(10)], "monitor string, series string, t int, alarm boolean")
    r = drift.scorecard(a, 6).first()
    assert (r.false_alarms, r.latency) == (1, 1)


def test_intervals_bracket_the_value(spark, sf):
    from plumbline.plans.tables import scored

    s = scored(spark, sf)
    exact = resample.exact_ci(s, resample.area, "doc_id", n_boot=200).first()
    hashed = resample.poisson_auroc_ci(s, "doc_id", 40).first()
    assert exact.lo < exact.value < exact.hi and hashed.lo < exact.value < hashed.hi
    assert abs(exact.lo - hashed.lo) < 0.05
    assert resample.exact_ci(s, resample.area, "doc_id", most=10).first().refusal


def test_auroc_interval_has_no_size_limit(spark, sf):
    from plumbline.plans.tables import scored

    s = scored(spark, sf)
    exact, small, large = (x.first() for x in (resample.exact_ci(s, resample.area, "doc_id", n_boot=100), resample.auroc_ci(s, "doc_id", n_boot=100), resample.auroc_ci(s, "doc_id", n_boot=100, most=10)))
    assert small == exact and large.refusal is None and large.n_boot_used == 100
    assert abs(large.value - exact.value) < 1e-12 and large.lo < large.value < large.hi
    assert abs(large.lo - exact.lo) < 0.05 and abs(large.hi - exact.hi) < 0.05


def test_running_totals(spark):
    from plumbline.plans.prefix import running_totals

    g = np.random.default_rng(1).integers(0, 9, 500)
    df = spark.createDataFrame([(float(k), int(v)) for k, v in enumerate(g)], "k double, v long")
    got = [r.v_upto for r in running_totals(df, "k", ["v"]).orderBy("k").collect()]
    assert got == np.cumsum(g).tolist()


def test_replicates_are_those_of_one_draw(spark):
    """Slices and ranks give what whole matrices of resamples and sorting give, bit for bit."""
    g = np.random.default_rng(3)
    rows = [(k, float(round(x, 1)), int(k % 3 == 0)) for k, x in enumerate(g.normal(size=700))]
    s = spark.createDataFrame(rows, "doc_id long, score double, y int")
    neg, pos = (np.array([x for _, x, c in rows if c == k]) for k in (0, 1))
    h = np.random.default_rng(17)
    a, b = h.choice(neg, (300, len(neg))), h.choice(pos, (300, len(pos)))
    found = [resample.area(x, y) for x, y in zip(a, b)]
    before, resample._AT_ONCE = resample._AT_ONCE, 5000
    try:
        own = lambda x, y: resample.area(x, y)
        for statistic in (resample.area, own):
            r = resample.exact_ci(s, statistic, "doc_id", n_boot=300).first()
            assert (r.lo, r.hi) == pytest.approx(tuple(np.quantile(found, [0.025, 0.975])), abs=1e-15) and r.n_boot_used == 300
    finally:
        resample._AT_ONCE = before


@pytest.mark.parametrize("kinds", [1, 3, 400])
def test_swept_area_by_brute_force(spark, kinds):
    """Ties within and across ranges, a score that most rows have."""
    g = np.random.default_rng(kinds)
    rows = [(k, float(g.integers(0, kinds)) if g.random() < 0.5 else 0.0, int(g.integers(0, 2))) for k in range(900)]
    s = spark.createDataFrame(rows, "doc_id long, score double, y int").repartition(5)
    got = resample.swept_area_ci(s, "doc_id", n_boot=40).first()
    x = s.select("score", "y", F.xxhash64("doc_id", F.lit(17)).alias("h")).toPandas()
    w = resample._poisson_weights(x["h"].to_numpy(), 40)
    one = x["y"].to_numpy() == 1
    won = (x["score"].to_numpy()[one, None] > x["score"].to_numpy()[None, ~one]) + 0.5 * (x["score"].to_numpy()[one, None] == x["score"].to_numpy()[None, ~one])
    each = [w[one, k] @ won @ w[~one, k] / (w[one, k].sum() * w[~one, k].sum()) for k in range(40)]
    assert got.value == pytest.approx(won.mean()) and (got.lo, got.hi) == pytest.approx(tuple(np.quantile(each, [0.025, 0.975]))) and got.n_boot == 40


def test_weighted_interval_of_any_statistic(spark, sf):
    from plumbline.plans.tables import scored

    gap = lambda w: w.groupBy("replicate").agg((F.sum(F.col("one") * F.col("score")) / F.sum("one") - F.sum(F.col("zero") * F.col("score")) / F.sum("zero")).alias("value"))
    s = scored(spark, sf)
    r = resample.weighted_ci(s, "doc_id", gap, 30).first()
    m = {x.y: x.m for x in s.groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert r.n_boot == 30 and r.lo < m[1] - m[0] < r.hi


def test_quantiles_from_running_totals(spark):
    from plumbline.operators import shift

    g = np.random.default_rng(5)
    r, c = g.integers(0, 40, 301).astype(float), g.normal(20, 5, 77).round(1)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "score double")
    for row in shift.quantile_shift(frame(r), frame(c), (0.0, 0.1, 0.37, 0.5, 1.0)).collect():
        assert (row.reference_q, row.candidate_q) == pytest.approx((np.quantile(r, row.q), np.quantile(c, row.q)))
    long = spark.createDataFrame([("a", float(v)) for v in r] + [("b", 1.0), ("b", 2.0), ("c", 7.0)], "k string, v double")
    assert {x.k: x.m for x in shift.medians(long, ["k"], "v").collect()} == pytest.approx({"a": np.median(r), "b": 1.5, "c": 7.0})


def test_answers_in_any_script(spark):
    from plumbline.functions.text import normalize_any

    cases = {"The Answer": "answer", "the the answer": "the answer", "the": "the", "U.S.": "us", "well-known": "wellknown", "A Straße": "strasse", "ﬁve": "five", "「東京」 タワー": "東京 タワー", "A—B": "ab", "an\u3000Ära!": "ära", "": "", "a\n": "a"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.n for r in df.select("t", normalize_any("t").alias("n")).collect()} == cases | {None: ""}


def test_a_report_for_people_leaves_out_what_grows_with_the_rows(spark, tmp_path):
    from plumbline.sources.receipts import write_report

    s = spark.range(300).selectExpr("cast(id as double) AS score", "cast(id % 2 as int) AS y")
    write_report(f"file://{tmp_path}/r", s, {"roc": curves.roc_curve(s), "auroc": curves.auroc(s)}, {})
    text = (tmp_path / "r/report.md").read_text()
    assert "## auroc" in text and "## roc" not in text and spark.read.json(f"file://{tmp_path}/r/roc").count() == 300


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from plumbline.plans import shared

    class Unset:
        """A context of a cluster without a checkpoint folder."""

        def isDefined(self):
            return False

        def getCheckpointDir(self):
            return self

        def sc(self):
            return self

    class Context:
        master = "spark://host:7077"
        applicationId = "x"
        _jsc = Unset()

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    at = shared.write_table(spark.range(3).groupBy("id").count(), "t")
    assert spark.read.parquet(at).count() == 3 and spark.conf.get(shared._CLEANUP) == "false"


def test_class_floor_refuses_rather_than_answers(spark):
    s = spark.createDataFrame([(float(k), int(k < 49)) for k in range(200)], "score double, y int")
    for df, col in ((curves.auroc(s), "auroc"), (curves.equal_error_rate(s), "eer"), (curves.threshold_at_fpr(s), "threshold")):
        assert all(r[col] is None and r.refusal == "needs 50 rows of each class, has 151 and 49" for r in df.collect())
    assert curves.roc_curve(s).count() == 0
