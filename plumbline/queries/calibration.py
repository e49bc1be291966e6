"""Calibration and admission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import SPACE, length_bucket, short_text
from plumbline.operators import bounds, curves, resample, shift, strata
from plumbline.plans.tables import axes, populations, scored

SCORED = rf"""
scored AS (
  SELECT doc_id, lang, source, n_words, CAST(n_chars AS DOUBLE) / n_words AS score, CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS y
  FROM (SELECT *, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents) WHERE n_words > 0
)"""
BUCKET = "CASE WHEN n_words >= 500 THEN '500+w' WHEN n_words >= 250 THEN '250-500w' WHEN n_words >= 100 THEN '100-250w' ELSE '0-100w' END"


def labelled(label: str) -> str:
    y = "toxic" if label == "toxic" else "1 - quality"
    return f"{SCORED}, s AS (SELECT scored.* EXCLUDE (y), CAST({y} AS INTEGER) AS y FROM scored JOIN labels USING (doc_id))"


LANG = f"{SCORED}, s AS (SELECT * FROM scored)"
CURVE = """,
flat AS (SELECT score, count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1) AS pos FROM s GROUP BY score),
n AS (SELECT coalesce(sum(neg), 0)::BIGINT AS n_neg, coalesce(sum(pos), 0)::BIGINT AS n_pos FROM flat),
curve AS (
  SELECT score AS threshold, neg, pos, n_neg, n_pos,
    CAST(sum(neg) OVER w AS DOUBLE) / n_neg AS fpr, CAST(sum(pos) OVER w AS DOUBLE) / n_pos AS tpr
  FROM flat, n WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
)"""
REFUSAL = "CASE WHEN n_neg < 50 OR n_pos < 50 THEN 'needs 50 rows of each class, has ' || n_neg || ' and ' || n_pos END"
FEW = "(n_neg < 50 OR n_pos < 50)"


def auroc_sql(s: str) -> str:
    return f"""WITH {s}{CURVE}, u AS (
      SELECT sum(pos * (below + neg / 2.0::DOUBLE)) AS u FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM flat))
    SELECT n_neg, n_pos, CASE WHEN NOT {FEW} THEN u / (n_neg::DOUBLE * n_pos) END AS auroc, {REFUSAL} AS refusal FROM u, n"""


def eer_sql(s: str) -> str:
    return f"""WITH {s}{CURVE}, d AS (SELECT threshold, fpr, 1 - tpr AS fnr, fpr - (1 - tpr) AS d FROM curve),
    c AS (SELECT *, lag(d) OVER w AS pd, lag(fpr) OVER w AS pf, lag(threshold) OVER w AS pt FROM d WINDOW w AS (ORDER BY threshold DESC)),
    x AS (SELECT * FROM c WHERE d >= 0 ORDER BY threshold DESC LIMIT 1)
    SELECT CASE WHEN {FEW} THEN NULL WHEN pd IS NULL OR d = 0 THEN (fpr + fnr) / 2 ELSE pf + pd / (pd - d) * (fpr - pf) END AS eer,
      CASE WHEN {FEW} THEN NULL WHEN pd IS NULL OR d = 0 THEN threshold ELSE pt + pd / (pd - d) * (threshold - pt) END AS threshold, {REFUSAL} AS refusal FROM x, n"""


def threshold_sql(s: str) -> str:
    return f"""WITH {s}{CURVE}, t AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS target_fpr),
    m AS (SELECT target_fpr, arg_min({{'t': threshold, 'f': fpr, 'p': tpr}}, threshold) AS r FROM t LEFT JOIN curve ON fpr <= target_fpr GROUP BY target_fpr),
    z AS (SELECT target_fpr, n_neg, n_pos, coalesce(r.t, (SELECT max(score) FROM flat) + 1e-9::DOUBLE) AS threshold, coalesce(r.f, 0.0::DOUBLE) AS achieved_fpr, coalesce(r.p, 0.0::DOUBLE) AS achieved_tpr FROM m, n)
    SELECT target_fpr, CASE WHEN NOT {FEW} THEN threshold END AS threshold, CASE WHEN NOT {FEW} THEN achieved_fpr END AS achieved_fpr, CASE WHEN NOT {FEW} THEN achieved_tpr END AS achieved_tpr, {REFUSAL} AS refusal FROM z"""


ALPHA_ROWS = "a AS (SELECT unnest([{'alpha': 0.05::DOUBLE, 'least': 19, 'least2': 39}, {'alpha': 0.01::DOUBLE, 'least': 99, 'least2': 199}, {'alpha': 0.005::DOUBLE, 'least': 199, 'least2': 399}], recursive := true))"


def conformal_sql(s: str) -> str:
    return f"""WITH {s}, {ALPHA_ROWS},
    h AS (SELECT score, row_number() OVER (ORDER BY score) AS r FROM s WHERE y = 0), n AS (SELECT count(*) FILTER (y = 0) AS n, count(*) FILTER (y = 1) AS p FROM s),
    k AS (SELECT alpha, least, n, p, CAST(least(ceil((n + 1)::DOUBLE * (1 - alpha)), n) AS BIGINT) AS k FROM a, n),
    b AS (SELECT k.*, h.score AS bound FROM k LEFT JOIN h ON h.r = k.k)
    SELECT alpha, n AS n_calibration, CASE WHEN n >= least THEN k END AS order_statistic, CASE WHEN n >= least THEN bound END AS bound,
      CASE WHEN n >= least THEN (n + 1 - k) / (n + 1)::DOUBLE END AS conditional_fpr_mean,
      CASE WHEN n >= least THEN sqrt((n + 1 - k) * k / ((n + 1)::DOUBLE * (n + 1) * (n + 2))) END AS conditional_fpr_sd,
      CASE WHEN n >= least THEN (SELECT count(*) FROM s WHERE y = 1 AND s.score > b.bound)::DOUBLE / p END AS tpr,
      CASE WHEN n < least THEN 'needs ' || least || ' reference rows, has ' || n END AS refusal FROM b"""


def rates_sql(s: str) -> str:
    return f"""rates AS (
      SELECT axis, value, n_neg, n_pos, CASE WHEN n_neg >= 20 THEN fp::DOUBLE / n_neg END AS fpr, CASE WHEN n_pos >= 20 THEN tp::DOUBLE / n_pos END AS tpr, (n_neg < 20 OR n_pos < 20) AS rate_withheld
      FROM (SELECT axis, value, count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0 AND score >= t) AS fp, count(*) FILTER (y = 1 AND score >= t) AS tp
        FROM (SELECT 'length' AS axis, {BUCKET} AS value, score, y FROM s UNION ALL SELECT 'source', source, score, y FROM s UNION ALL SELECT 'lang', lang, score, y FROM s), (SELECT min(threshold) AS t FROM curve WHERE fpr <= 0.05::DOUBLE) GROUP BY ALL))"""


PAIR = f"{SCORED}, r AS (SELECT * FROM scored WHERE doc_id % 2 = 0), c AS (SELECT * FROM scored WHERE doc_id % 2 = 1)"
BAND = f"""{ALPHA_ROWS}, ro AS (SELECT score, row_number() OVER (ORDER BY score) AS r FROM r), rn AS (SELECT count(*) AS n FROM r),
  bk AS (SELECT alpha, least2, n, CAST(least(ceil((n + 1)::DOUBLE * (1 - alpha / 2)), n) AS BIGINT) AS k FROM a, rn),
  band AS (SELECT alpha, n AS n_reference, CASE WHEN n >= least2 THEN k END AS k, CASE WHEN n >= least2 THEN l.score END AS lo, CASE WHEN n >= least2 THEN h.score END AS hi,
    CASE WHEN n < least2 THEN 'needs ' || least2 || ' reference rows, has ' || n END AS refusal FROM bk LEFT JOIN ro h ON h.r = k LEFT JOIN ro l ON l.r = n + 1 - k)"""
PLACED = """placed AS (
  SELECT c.*, (SELECT count(*) FROM r WHERE r.score <= c.score) AS le, (SELECT count(*) FROM r WHERE r.score >= c.score) AS ge, (SELECT count(*) FROM r) AS nr FROM c
)"""
P_SQL = "least(1.0::DOUBLE, 2 * least((1 + ge) / (nr + 1)::DOUBLE, (1 + le) / (nr + 1)::DOUBLE))"
WEIGHT = "(" + " + ".join(f"CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in resample._POISSON) + ")"
UNIFORM = "CAST(CAST('0x' || substr(md5(doc_id || ':' || b || ':17'), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496::DOUBLE"

ENDS = lambda v: f"count(*) AS n_boot, quantile_cont({v}, 0.025::DOUBLE) AS lo, quantile_cont({v}, 0.975::DOUBLE) AS hi"


def _rates(spark, d):
    s = scored(spark, d)
    return strata.subgroup_rates(s, axes(), curves.threshold_at_fpr(s, (0.05,)).select("threshold"))


def _outside(spark, d):
    """(doc_id, alpha, flag): whether a candidate is outside each band that the reference supports."""
    r, c = populations(spark, d)
    band = bounds.conformal_band(r).filter("refusal IS NULL")
    return c.select("doc_id", "score").crossJoin(F.broadcast(band)).select("doc_id", "alpha", ((F.col("score") > F.col("hi")) | (F.col("score") < F.col("lo"))).alias("flag"))


#: Sections of a report: (name, keys, numbers, texts).
SECTIONS = (
    ("auroc", (), ("n_neg", "n_pos", "auroc"), ("refusal",)), ("eer", (), ("eer", "threshold"), ("refusal",)), ("threshold", ("target_fpr",), ("threshold", "achieved_fpr", "achieved_tpr"), ("refusal",)),
    ("conformal", ("alpha",), ("n_calibration", "order_statistic", "bound", "conditional_fpr_mean", "conditional_fpr_sd", "tpr"), ("refusal",)),
    ("subgroup", ("axis", "value"), ("n_neg", "n_pos", "fpr", "tpr", "rate_withheld"), ()), ("base_rate", ("target_fpr", "prevalence"), ("wrongly_flagged", "ppv"), ()),
)


def _report(spark, d):
    """All calibration sections as tidy rows (section, key, field, value, note)."""
    s = scored(spark, d)
    tables = {
        "auroc": curves.auroc(s), "eer": curves.equal_error_rate(s), "threshold": curves.threshold_at_fpr(s), "conformal": bounds.conformal_table(s),
        "subgroup": _rates(spark, d), "base_rate": strata.base_rate_table(curves.threshold_at_fpr(s)),
    }
    out = None
    for section, keys, numbers, texts in SECTIONS:
        key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys)) if keys else F.lit("")
        cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("note")) for c in numbers]
        cells += [F.struct(F.lit(c).alias("field"), F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("note")) for c in texts]
        rows = tables[section].select(F.lit(section).alias("section"), key.alias("key"), F.explode(F.array(*cells)).alias("c")).select("section", "key", "c.field", "c.value", "c.note")
        out = rows if out is None else out.unionByName(rows)
    return out


def _report_sql() -> str:
    of = {
        "auroc": auroc_sql(LANG), "eer": eer_sql(LANG), "threshold": threshold_sql(LANG), "conformal": conformal_sql(LANG), "subgroup": ORACLES["subgroup_rates"], "base_rate": ORACLES["base_rate_table"],
    }
    parts = []
    for section, keys, numbers, texts in SECTIONS:
        key = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) or "''"
        for c in numbers:
            parts.append(f"SELECT '{section}' AS section, {key} AS key, '{c}' AS field, CAST({c} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS note FROM ({of[section]})")
        for c in texts:
            parts.append(f"SELECT '{section}', {key}, '{c}', NULL, {c} FROM ({of[section]})")
    return " UNION ALL ".join(parts)


QUERIES = {
    "scored_documents": lambda s, d: scored(s, d).select("doc_id", "n_words", "score", "y", length_bucket("n_words").alias("bucket"), short_text("n_words").alias("short_text")),
    "class_counts": lambda s, d: curves.class_counts(scored(s, d)).withColumn("label", F.lit("lang")).unionByName(curves.class_counts(scored(s, d, "toxic")).withColumn("label", F.lit("toxic"))).unionByName(curves.class_counts(scored(s, d, "quality")).withColumn("label", F.lit("quality"))),
    "midranks": lambda s, d: curves.midranks(scored(s, d)).select("doc_id", "midrank"),
    "auroc": lambda s, d: curves.auroc(scored(s, d)),
    "auroc_toxic": lambda s, d: curves.auroc(scored(s, d, "toxic")),
    "auroc_refused": lambda s, d: curves.auroc(scored(s, d).withColumn("y", F.lit(0))),
    "roc_curve": lambda s, d: curves.roc_curve(scored(s, d)),
    "equal_error_rate": lambda s, d: curves.equal_error_rate(scored(s, d)),
    "equal_error_rate_quality": lambda s, d: curves.equal_error_rate(scored(s, d, "quality")),
    "threshold_at_fpr": lambda s, d: curves.threshold_at_fpr(scored(s, d)),
    "conformal_thresholds": lambda s, d: bounds.conformal_table(scored(s, d)),
    "conformal_thresholds_quality": lambda s, d: bounds.conformal_table(scored(s, d, "quality")),
    "subgroup_rates": _rates,
    "fpr_disparity": lambda s, d: strata.max_disparity(_rates(s, d)),
    "base_rate_table": lambda s, d: strata.base_rate_table(curves.threshold_at_fpr(scored(s, d))),
    "calibration_report": _report,
    "conformal_band": lambda s, d: bounds.conformal_band(populations(s, d)[0]),
    "novelty_rate": lambda s, d: shift.novelty_table(*populations(s, d)),
    "ks_distance": lambda s, d: shift.ks_distance(*populations(s, d)),
    "quantile_shift": lambda s, d: shift.quantile_shift(*populations(s, d)),
    "placements": lambda s, d: shift.placements(*populations(s, d)).select("doc_id", "score", "percentile_ref", "conformal_p", short_text("n_words").alias("short_text")),
    "strata_novelty": lambda s, d: shift.strata_novelty(*populations(s, d), axes()),
    "auroc_ci": lambda s, d: resample.auroc_ci(scored(s, d), "doc_id"),
    "rate_ci": lambda s, d: resample.proportion_ci(scored(s, d).select("lang", (F.col("score") >= 6.0).alias("flag")), "flag", ["lang"]),
    "rate_ci_md5": lambda s, d: resample.poisson_rate_ci(scored(s, d).select("doc_id", (F.col("score") >= 6.0).alias("flag")), "flag", "doc_id"),
    "auroc_ci_md5": lambda s, d: resample.poisson_auroc_ci(scored(s, d), "doc_id", n_boot=20),
    "ks_ci_md5": lambda s, d: resample.poisson_ks_ci(*populations(s, d), "doc_id", n_boot=20),
    "quantile_shift_ci_md5": lambda s, d: resample.poisson_shift_ci(*populations(s, d), "doc_id", shift.QUANTILES, n_boot=20),
    "novelty_ci_md5": lambda s, d: resample.poisson_rate_ci(_outside(s, d), "flag", "doc_id", n_boot=20, by=["alpha"]),
    "subgroup_ci_md5": lambda s, d: resample.poisson_rate_ci(strata.long_axes(scored(s, d).filter("y = 0").withColumn("flag", F.col("score") >= 6.0), {k: v for k, v in axes().items() if k != "lang"}), "flag", "doc_id", n_boot=20, by=["axis", "value"]),
}

ORACLES = {
    "scored_documents": f"WITH {LANG} SELECT doc_id, n_words, score, y, {BUCKET} AS bucket, n_words < 50 AS short_text FROM s",
    "class_counts": " UNION ALL ".join(f"SELECT n_neg, n_pos, {REFUSAL} AS refusal, '{k}' AS label FROM (WITH {s} SELECT count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos FROM s)" for k, s in (("lang", LANG), ("toxic", labelled("toxic")), ("quality", labelled("quality")))),
    "midranks": f"WITH {LANG} SELECT doc_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS midrank FROM s",
    "auroc": auroc_sql(LANG),
    "auroc_toxic": auroc_sql(labelled("toxic")),
    "auroc_refused": auroc_sql(LANG.replace("SELECT * FROM scored", "SELECT * REPLACE (0 AS y) FROM scored")),
    "roc_curve": f"WITH {LANG}{CURVE} SELECT threshold, fpr, tpr FROM curve WHERE NOT {FEW}",
    "equal_error_rate": eer_sql(LANG),
    "equal_error_rate_quality": eer_sql(labelled("quality")),
    "threshold_at_fpr": threshold_sql(LANG),
    "conformal_thresholds": conformal_sql(LANG),
    "conformal_thresholds_quality": conformal_sql(labelled("quality")),
    "subgroup_rates": f"WITH {LANG}{CURVE}, {rates_sql('s')} SELECT * FROM rates",
    "fpr_disparity": f"""WITH {LANG}{CURVE}, {rates_sql('s')},
      g AS (SELECT axis, count(fpr) AS k, max(fpr) AS w, min(fpr) AS b FROM rates GROUP BY axis)
      SELECT axis, CASE WHEN k >= 2 THEN w - b END AS gap, CASE WHEN k >= 2 THEN (SELECT min(value) FROM rates r WHERE r.axis = g.axis AND fpr = w) END AS worst_group, CASE WHEN k >= 2 THEN w END AS worst_fpr,
        CASE WHEN k >= 2 THEN (SELECT min(value) FROM rates r WHERE r.axis = g.axis AND fpr = b) END AS best_group, CASE WHEN k >= 2 THEN b END AS best_fpr, CASE WHEN k >= 2 AND b > 0 THEN w / b END AS ratio FROM g""",
    "base_rate_table": f"""WITH t AS ({threshold_sql(LANG)}), p AS (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) AS prevalence)
      SELECT target_fpr, prevalence, target_fpr * 75000 AS wrongly_flagged, CASE WHEN achieved_tpr IS NOT NULL THEN achieved_tpr * prevalence / (achieved_tpr * prevalence + target_fpr * (1 - prevalence)) END AS ppv FROM t, p""",
    "conformal_band": f"WITH {PAIR}, {BAND} SELECT * FROM band",
    "novelty_rate": f"""WITH {PAIR}, {BAND}, cn AS (SELECT count(*) AS n FROM c), o AS (SELECT alpha, count(*) AS out FROM band, c WHERE score > hi OR score < lo GROUP BY alpha)
      SELECT alpha, n_reference, n AS n_candidate, lo, hi, CASE WHEN refusal IS NULL AND n >= 20 THEN coalesce(out, 0) END AS n_outside, CASE WHEN refusal IS NULL AND n >= 20 THEN coalesce(out, 0)::DOUBLE / n END AS outside_rate,
        alpha AS expected, coalesce(refusal, CASE WHEN n < 20 THEN 'needs 20 candidate rows, has ' || n END) AS refusal FROM band LEFT JOIN o USING (alpha), cn""",
    "ks_distance": f"""WITH {PAIR}, f AS (SELECT score, count(*) FILTER (p = 1) AS a, count(*) FILTER (p = 0) AS b FROM (SELECT score, 1 AS p FROM r UNION ALL SELECT score, 0 FROM c) GROUP BY score),
      u AS (SELECT sum(a) OVER w AS a, sum(b) OVER w AS b FROM f WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)), n AS (SELECT (SELECT count(*) FROM r) AS na, (SELECT count(*) FROM c) AS nb)
      SELECT max(na) AS n_reference, max(nb) AS n_candidate, max(abs(a::DOUBLE / na - b::DOUBLE / nb)) AS ks FROM u, n""",
    "quantile_shift": f"""WITH {PAIR}, q AS (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q, unnest((SELECT quantile_cont(score, [0.1, 0.5, 0.9]) FROM r)) AS reference_q, unnest((SELECT quantile_cont(score, [0.1, 0.5, 0.9]) FROM c)) AS candidate_q)
      SELECT *, candidate_q - reference_q AS delta FROM q""",
    "placements": f"WITH {PAIR}, {PLACED} SELECT doc_id, score, le::DOUBLE / nr AS percentile_ref, {P_SQL} AS conformal_p, n_words < 50 AS short_text FROM placed",
    "strata_novelty": f"""WITH {PAIR}, {BAND}, {PLACED}, b AS (SELECT lo, hi FROM band WHERE refusal IS NULL ORDER BY alpha DESC LIMIT 1),
      l AS (SELECT 'length' AS axis, {BUCKET} AS value, score, le::DOUBLE / nr AS q FROM placed UNION ALL SELECT 'source', source, score, le::DOUBLE / nr FROM placed UNION ALL SELECT 'lang', lang, score, le::DOUBLE / nr FROM placed),
      rb AS (SELECT axis, value, count(*) AS nb FROM (SELECT 'length' AS axis, {BUCKET} AS value FROM r UNION ALL SELECT 'source', source FROM r UNION ALL SELECT 'lang', lang FROM r) GROUP BY ALL),
      g AS (SELECT axis, value, count(*) AS n, count(*) FILTER (score > hi OR score < lo) AS k, quantile_cont(q, 0.5) AS m, count(hi) AS h FROM l LEFT JOIN b ON true GROUP BY ALL)
      SELECT axis, value, n, coalesce(nb, 0) AS n_baseline, CASE WHEN n >= 20 AND h > 0 THEN k::DOUBLE / n END AS outside_rate, CASE WHEN n >= 20 THEN m END AS median_percentile, n < 20 AS rate_withheld FROM g LEFT JOIN rb USING (axis, value)""",
    "rate_ci_md5": f"""WITH {LANG}, w AS (SELECT b, score >= 6.0::DOUBLE AS flag, {WEIGHT} AS w FROM (SELECT *, {UNIFORM} AS u FROM s, range(50) t(b))),
      p AS (SELECT b, sum(w * flag::INTEGER)::DOUBLE / sum(w) AS p FROM w GROUP BY b), q AS (SELECT count(*) AS n_boot, quantile_cont(p, {0.025!r}::DOUBLE) AS lo, quantile_cont(p, {1 - (1 - 0.95) / 2!r}::DOUBLE) AS hi FROM p)
      SELECT n_boot, (SELECT avg((score >= 6.0::DOUBLE)::INTEGER) FROM s) AS rate, lo, hi FROM q""",
    "auroc_ci_md5": f"""WITH {LANG}, w AS (SELECT b, score, y, {WEIGHT} AS w FROM (SELECT *, {UNIFORM} AS u FROM s, range(20) t(b))),
      f AS (SELECT b, score, sum(w) FILTER (y = 0) AS neg0, sum(w) FILTER (y = 1) AS pos0 FROM w WHERE w > 0 GROUP BY ALL), g AS (SELECT b, score, coalesce(neg0, 0)::BIGINT AS neg, coalesce(pos0, 0)::BIGINT AS pos FROM f),
      a AS (SELECT b, sum(pos * (up - neg / 2::DOUBLE)) / (sum(neg)::DOUBLE * sum(pos)) AS a FROM (SELECT *, (sum(neg) OVER (PARTITION BY b ORDER BY score ROWS UNBOUNDED PRECEDING))::BIGINT AS up FROM g) GROUP BY b)
      SELECT count(*) AS n_boot, quantile_cont(a, 0.025::DOUBLE) AS lo, quantile_cont(a, 0.975::DOUBLE) AS hi FROM a""",
    "ks_ci_md5": f"""WITH {PAIR}, w AS (SELECT b, p, score, {WEIGHT} AS w FROM (SELECT *, {UNIFORM} AS u FROM (SELECT doc_id, score, 1 AS p FROM r UNION ALL SELECT doc_id, score, 0 FROM c), range(20) t(b))),
      f AS (SELECT b, score, coalesce(sum(w) FILTER (p = 1), 0)::BIGINT AS one, coalesce(sum(w) FILTER (p = 0), 0)::BIGINT AS zero FROM w WHERE w > 0 GROUP BY ALL),
      g AS (SELECT b, sum(one) OVER o / (sum(one) OVER (PARTITION BY b))::DOUBLE AS x, sum(zero) OVER o / (sum(zero) OVER (PARTITION BY b))::DOUBLE AS y FROM f WINDOW o AS (PARTITION BY b ORDER BY score ROWS UNBOUNDED PRECEDING)),
      k AS (SELECT b, max(abs(x - y)) AS k FROM g GROUP BY b) SELECT {ENDS("k")} FROM k""",
    "quantile_shift_ci_md5": f"""WITH {PAIR}, w AS (SELECT b, p, score, unnest(range({WEIGHT})) FROM (SELECT *, {UNIFORM} AS u FROM (SELECT doc_id, score, 1 AS p FROM r UNION ALL SELECT doc_id, score, 0 FROM c), range(20) t(b))),
      k AS (SELECT b, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q, unnest(quantile_cont(score, [0.1, 0.5, 0.9]) FILTER (p = 0)) - unnest(quantile_cont(score, [0.1, 0.5, 0.9]) FILTER (p = 1)) AS k FROM w GROUP BY b)
      SELECT q, {ENDS("k")} FROM k GROUP BY q""",
    "novelty_ci_md5": f"""WITH {PAIR}, {BAND}, o AS (SELECT doc_id, alpha, score > hi OR score < lo AS flag FROM c, band WHERE refusal IS NULL),
      w AS (SELECT alpha, b, flag, {WEIGHT} AS w FROM (SELECT *, {UNIFORM} AS u FROM o, range(20) t(b))), k AS (SELECT alpha, b, sum(w * flag::INTEGER)::DOUBLE / sum(w) AS k FROM w GROUP BY ALL)
      SELECT alpha, rate, n_boot, lo, hi FROM (SELECT alpha, {ENDS("k")} FROM k GROUP BY alpha) JOIN (SELECT alpha, avg(flag::INTEGER) AS rate FROM o GROUP BY alpha) USING (alpha)""",
    "subgroup_ci_md5": f"""WITH {LANG}, l AS (SELECT doc_id, 'length' AS axis, {BUCKET} AS value, score >= 6.0::DOUBLE AS flag FROM s WHERE y = 0 UNION ALL SELECT doc_id, 'source', source, score >= 6.0::DOUBLE FROM s WHERE y = 0),
      w AS (SELECT axis, value, b, flag, {WEIGHT} AS w FROM (SELECT *, {UNIFORM} AS u FROM l, range(20) t(b))), k AS (SELECT axis, value, b, sum(w * flag::INTEGER)::DOUBLE / sum(w) AS k FROM w WHERE w > 0 GROUP BY ALL)
      SELECT axis, value, rate, n_boot, lo, hi FROM (SELECT axis, value, {ENDS("k")} FROM k GROUP BY ALL) JOIN (SELECT axis, value, avg(flag::INTEGER) AS rate FROM l GROUP BY ALL) USING (axis, value)""",
}
ORACLES["calibration_report"] = _report_sql()
