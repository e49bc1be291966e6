"""Probe, series and monitor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import SPACE, normalize_any
from plumbline.operators import detectors, drift, probes, resample, series
from plumbline.plans.tables import answers, daily_series, load
from plumbline.queries.calibration import ENDS, UNIFORM, WEIGHT

CUTOFF = "2024-01-10"
DAILY = """d AS (SELECT event_type AS series, CAST(date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS INTEGER) AS t, avg(value) AS value FROM events GROUP BY ALL),
x AS (SELECT series, t, -value AS x, t < 20 AS is_reference FROM d)"""
PH = """ph AS (
  SELECT series, t, m - least(0.0::DOUBLE, min(m) OVER w) AS statistic FROM (
    SELECT series, t, sum(dev) OVER w AS m FROM (SELECT series, t, x - avg(x) OVER w - 0.005::DOUBLE AS dev FROM x WHERE NOT is_reference WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING))"""
CU = """cu AS (
  SELECT series, t, c - least(0.0::DOUBLE, min(c) OVER w) AS statistic FROM (
    SELECT series, t, sum(x - m - 0.01::DOUBLE) OVER w AS c FROM x JOIN (SELECT series, avg(x) AS m FROM x WHERE is_reference GROUP BY series) USING (series) WHERE NOT is_reference WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING))
  WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING))"""
CF = """rr AS (SELECT series, x, row_number() OVER (PARTITION BY series ORDER BY x) AS r, count(*) OVER (PARTITION BY series) AS n FROM x WHERE is_reference),
rb AS (SELECT series, max(n) AS n_reference, max(x) FILTER (r = least(ceil((n + 1)::DOUBLE * 0.8::DOUBLE), n)) AS b FROM rr GROUP BY series),
cf AS (SELECT series, t, x AS statistic, CASE WHEN coalesce(n_reference, 0) >= 4 THEN x > b END AS alarm, CASE WHEN coalesce(n_reference, 0) >= 4 THEN -b END AS bound, coalesce(n_reference, 0) AS n_reference,
  CASE WHEN coalesce(n_reference, 0) < 4 THEN 'needs 4 reference intervals, has ' || coalesce(n_reference, 0) END AS refusal FROM x LEFT JOIN rb USING (series) WHERE NOT is_reference)"""
PANEL = f"""WITH {DAILY}, {PH}, {CU}, {CF}, panel AS (
  SELECT 'conformal' AS monitor, series, t, statistic, alarm, refusal FROM cf UNION ALL SELECT 'page_hinkley', series, t, statistic, statistic > 0.05::DOUBLE, NULL FROM ph UNION ALL SELECT 'cusum', series, t, statistic, statistic > 0.05::DOUBLE, NULL FROM cu)"""
WORD = lambda c: f"regexp_split_to_array(trim({c}), '[ \\n]+')[1]"
ANSWERS = f"""a AS (SELECT u.conv_id, u.turn, 't' || (u.conv_id % 3) AS vintage, {WORD("u.text")} AS answer, {WORD("r.text")} AS response, u.text AS prompt
  FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 WHERE u.role = 'user' AND r.role = 'assistant')"""


def norm(c: str) -> str:
    return rf"regexp_replace(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '\p{{P}}', '', 'g'), '{SPACE}'), lambda w: w <> ''), ' '), '^(a|an|the) (.)', '\2')"


GRADED = f"{ANSWERS}, g AS (SELECT *, {norm('response')} AS normalized, {norm('answer')} = {norm('response')} AS correct FROM a)"
CONF = "c AS (SELECT vec_id, 'v' || (vec_id % 4) AS vintage, 1 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)) AS confidence, label % 2 = 0 AS correct FROM embeddings)"
BINS = "b AS (SELECT vintage, least(floor(confidence * 10)::INTEGER, 9) AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(correct::INTEGER) AS accuracy FROM c GROUP BY ALL)"
PROBES = f"""p AS (SELECT conv_id || '-' || (turn % 4) AS id, prompt, CASE WHEN conv_id % 7 = 0 THEN '...' ELSE answer END AS answer, [answer, lower(answer)] AS aliases,
  (DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER)) AS source_date, CASE WHEN conv_id % 5 <> 0 THEN (DATE '2024-01-15' + CAST(turn AS INTEGER)) END AS authored, vintage FROM a)"""
RUNS = "runs AS (SELECT event_type AS vintage, CAST(user_id % 8 AS INTEGER) AS run, avg(value) AS accuracy, user_id % 8 < 4 AS replicate FROM events GROUP BY ALL)"
BOUND = "bd AS (SELECT vintage, count(*) FILTER (replicate) AS n_replicates, avg(accuracy) FILTER (replicate) AS mean, 2 * stddev_pop(accuracy) FILTER (replicate) AS bound FROM runs GROUP BY vintage)"


def _confidence(s, d):
    e = load(s, d, "embeddings")
    share = probes.true_share(e.embedding[0].cast("double"), e.embedding[1].cast("double"))
    return e.select("vec_id", F.concat(F.lit("v"), (F.col("vec_id") % 4).cast("string")).alias("vintage"), share.alias("confidence"), (F.col("label") % 2 == 0).alias("correct"))


def _choices(s, d):
    e = load(s, d, "embeddings")
    option = F.create_map(*(x for k, n in enumerate("ABCD") for x in (F.lit(n), F.round(e.embedding[k].cast("double"), 1))))
    return e.select("vec_id", option.alias("options"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("label") % 4 + 1).cast("int")).alias("key"))


def probe_set(s, d):
    a = answers(s, d)
    return a.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") % 4).cast("string")).alias("id"), "prompt", F.when(F.col("conv_id") % 7 == 0, "...").otherwise(F.col("answer")).alias("answer"), F.array("answer", F.lower("answer")).alias("aliases"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("source_date"), F.when(F.col("conv_id") % 5 != 0, F.date_add(F.lit("2024-01-15").cast("date"), F.col("turn").cast("int"))).alias("authored"), "vintage",
    )


def _runs(s, d):
    e = load(s, d, "events")
    return e.groupBy(F.col("event_type").alias("vintage"), (F.col("user_id") % 8).cast("int").alias("run")).agg(F.avg("value").alias("accuracy")).withColumn("replicate", F.col("run") < 4)


def _identity(s, d, rounded=1):
    """(field, value) pairs of a derived instrument: the counts of each event type, rounded down; another
    rounding makes another instrument, whose fields are equal where the count is a multiple."""
    n = F.count("*") - F.count("*") % rounded
    return load(s, d, "events").groupBy(F.col("event_type").alias("field")).agg(n.cast("string").alias("value"))


IDENT = lambda k: f"SELECT event_type AS field, CAST(count(*) - count(*) % {k} AS VARCHAR) AS value FROM events GROUP BY event_type"
HASH = lambda src: f"""SELECT vintage, sum(n)::BIGINT AS n, sha256(string_agg(bh, chr(10) ORDER BY b)) AS content_hash FROM (
  SELECT vintage, substr(h, 1, 2) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS bh FROM (SELECT vintage, sha256(conv_id || chr(31) || turn || chr(31) || answer) AS h FROM {src}) GROUP BY ALL) GROUP BY vintage"""  # noqa: E731

EDITED = "(SELECT * REPLACE (CASE WHEN conv_id = 1 THEN 'edited' ELSE answer END AS answer) FROM a)"

QUERIES = {
    "probe_grades": lambda s, d: probes.grade_free_text(answers(s, d)).select("conv_id", "turn", "vintage", "normalized", "correct"),
    "probe_grades_any_script": lambda s, d: probes.grade_free_text(answers(s, d), normalize_any).select("conv_id", "turn", "normalized", "correct"),
    "choice_grades": lambda s, d: probes.grade_choice(_choices(s, d)).select("vec_id", "chosen", "tie", "correct"),
    "ptrue": lambda s, d: _confidence(s, d).select("vec_id", "confidence"),
    "vintage_accuracy": lambda s, d: probes.vintage_accuracy(probes.grade_free_text(answers(s, d))),
    "post_cutoff_share": lambda s, d: probes.post_cutoff_share(probe_set(s, d), CUTOFF),
    "ece_bins": lambda s, d: probes.ece_bins(_confidence(s, d), ["vintage"]),
    "probability_block": lambda s, d: probes.probability_block(_confidence(s, d), ["vintage"]),
    "ece_ci_md5": lambda s, d: resample.poisson_ece_ci(_confidence(s, d), "vec_id", ["vintage"], n_boot=20),
    "probe_lint": lambda s, d: probes.lint(probe_set(s, d), CUTOFF),
    "vintage_hashes": lambda s, d: probes.vintage_hashes(answers(s, d), "vintage", ["conv_id", "turn", "answer"]),
    "vintage_freeze_violations": lambda s, d: probes.freeze_violations(probes.vintage_hashes(answers(s, d), "vintage", ["conv_id", "turn", "answer"]), probes.vintage_hashes(answers(s, d).withColumn("answer", F.when(F.col("conv_id") == 1, "edited").otherwise(F.col("answer"))), "vintage", ["conv_id", "turn", "answer"])),
    "series_identity": lambda s, d: _identity(s, d).select("field", series.identity_hash(["field", "value"]).alias("series_id")),
    "identity_diff": lambda s, d: series.identity_diff(_identity(s, d), _identity(s, d, 2).filter("field <> 'click'")),
    "pinned_mismatches": lambda s, d: series.pinned_mismatches(_identity(s, d), _identity(s, d, 2)),
    "variance_bound": lambda s, d: series.variance_bound(_runs(s, d)),
    "movement": lambda s, d: series.movement(_runs(s, d)),
    "run_sequences": lambda s, d: series.sequences(_runs(s, d)),
    "series_listing": lambda s, d: series.list_series(_runs(s, d).withColumn("series_id", F.substring(F.sha2("vintage", 256), 1, 12))).select("series_id", "n_runs", "n_replicates", F.array_join("vintages", ",").alias("vintages")),
    "page_hinkley": lambda s, d: drift.page_hinkley(daily_series(s, d)),
    "cusum": lambda s, d: drift.cusum(daily_series(s, d)),
    "conformal_alarm": lambda s, d: drift.conformal_alarm(daily_series(s, d)),
    "monitor_panel": lambda s, d: drift.panel(daily_series(s, d)),
    "monitor_scorecard": lambda s, d: drift.scorecard(drift.panel(daily_series(s, d)), 25),
    "interval_counts": lambda s, d: drift.interval_counts(load(s, d, "events"), "ts", "event_type", "value").select("event_type", F.to_date("start").alias("day"), "n", "total"),
    "token_discrepancy": lambda s, d: detectors.token_discrepancy(detectors.vector_logits(load(s, d, "embeddings"))),
    "perplexity_ratio": lambda s, d: detectors.perplexity_ratio(detectors.vector_logits(load(s, d, "embeddings"))),
}

ORACLES = {
    "probe_grades": f"WITH {GRADED} SELECT conv_id, turn, vintage, normalized, correct FROM g",
    "probe_grades_any_script": f"WITH {GRADED} SELECT conv_id, turn, replace(normalized, 'ß', 'ss') AS normalized, correct FROM g",
    "choice_grades": """WITH o AS (SELECT vec_id, [round(embedding[1]::DOUBLE, 1), round(embedding[2]::DOUBLE, 1), round(embedding[3]::DOUBLE, 1), round(embedding[4]::DOUBLE, 1)] AS v, substr('ABCD', (label % 4 + 1)::INTEGER, 1) AS key FROM embeddings),
      t AS (SELECT *, len(list_filter(v, lambda x: x = list_max(v))) AS k, substr('ABCD', list_position(v, list_max(v))::INTEGER, 1) AS top FROM o)
      SELECT vec_id, CASE WHEN k = 1 THEN top END AS chosen, k > 1 AS tie, k = 1 AND top = key AS correct FROM t""",
    "ptrue": f"WITH {CONF} SELECT vec_id, confidence FROM c",
    "vintage_accuracy": f"WITH {GRADED} SELECT vintage, count(*) AS n, avg(correct::INTEGER) AS accuracy FROM g GROUP BY vintage",
    "post_cutoff_share": f"WITH {ANSWERS}, {PROBES} SELECT vintage, count(*) AS n, count(*) FILTER (source_date > DATE '{CUTOFF}') AS n_after, avg((source_date > DATE '{CUTOFF}')::INTEGER) AS share FROM p GROUP BY vintage",
    "ece_bins": f"WITH {CONF}, {BINS} SELECT vintage, bin, coalesce(n, 0) AS n, mean_confidence, accuracy FROM (SELECT DISTINCT vintage FROM c) CROSS JOIN (SELECT unnest(range(10))::INTEGER AS bin) LEFT JOIN b USING (vintage, bin)",
    "probability_block": f"""WITH {CONF}, {BINS}, h AS (SELECT vintage, count(*) AS n, avg((confidence - correct::INTEGER) ** 2) AS brier, avg(confidence) - avg(correct::INTEGER) AS gap, avg(confidence) AS mean_confidence FROM c GROUP BY vintage)
      SELECT vintage, h.n, 0::BIGINT AS n_invalid, (SELECT sum(b.n * abs(accuracy - b.mean_confidence)) / sum(b.n) FROM b WHERE b.vintage = h.vintage) AS ece, brier, gap, h.mean_confidence FROM h""",
    "ece_ci_md5": f"""WITH {CONF}, w AS (SELECT vintage, b, least(floor(confidence * 10)::INTEGER, 9) AS bin, confidence, correct, {WEIGHT} AS w FROM (SELECT *, {UNIFORM.replace("doc_id", "vec_id")} AS u FROM c, range(20) t(b))),
      cell AS (SELECT vintage, b, bin, sum(w) AS n, abs(sum(w * confidence) - sum(w * correct::INTEGER)) AS d FROM w WHERE w > 0 GROUP BY ALL), k AS (SELECT vintage, b, sum(d) / sum(n) AS k FROM cell GROUP BY ALL)
      SELECT vintage, {ENDS("k")} FROM k GROUP BY vintage""",
    "probe_lint": f"""WITH {ANSWERS}, {PROBES}, r AS (
      SELECT 'error' AS severity, id AS probe_id, 'authored missing' AS rule FROM p WHERE authored IS NULL UNION ALL SELECT 'error', id, 'authored before its source' FROM p WHERE authored < source_date
      UNION ALL SELECT 'error', id, 'source not after the cutoff' FROM p WHERE source_date <= DATE '{CUTOFF}' UNION ALL SELECT 'error', id, 'answer normalises to nothing' FROM p WHERE {norm('answer')} = ''
      UNION ALL SELECT 'warning', id, 'alias repeats under normalisation' FROM p WHERE {norm('aliases[1]')} = {norm('aliases[2]')}
      UNION ALL SELECT 'error', id, 'id repeats' FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'warning', id, 'prompt repeats' FROM p WHERE prompt IN (SELECT prompt FROM p GROUP BY prompt HAVING count(*) > 1)) SELECT * FROM r""",
    "vintage_hashes": f"WITH {ANSWERS} {HASH('a')}",
    "vintage_freeze_violations": f"WITH {ANSWERS}, o AS ({HASH('a')}), n AS ({HASH(EDITED)}) SELECT vintage, o.content_hash AS was, n.content_hash AS now FROM o JOIN n USING (vintage) WHERE o.content_hash <> n.content_hash",
    "series_identity": f"""SELECT field, substr(sha256('{{"field":"' || field || '","value":"' || value || '"}}'), 1, 12) AS series_id FROM ({IDENT(1)})""",
    "identity_diff": f"SELECT field, a.value AS was, b.value AS now FROM ({IDENT(1)}) a FULL JOIN (SELECT * FROM ({IDENT(2)}) WHERE field <> 'click') b USING (field) WHERE a.value IS DISTINCT FROM b.value",
    "pinned_mismatches": f"SELECT field, a.value AS was, b.value AS now FROM ({IDENT(1)}) a JOIN ({IDENT(2)}) b USING (field) WHERE a.value <> b.value",
    "variance_bound": f"WITH {RUNS}, {BOUND} SELECT vintage, n_replicates, CASE WHEN n_replicates >= 2 THEN mean END AS mean, CASE WHEN n_replicates >= 2 THEN bound END AS bound, CASE WHEN n_replicates < 2 THEN 'needs 2 replicates, has ' || n_replicates END AS refusal FROM bd",
    "movement": f"WITH {RUNS}, {BOUND} SELECT vintage, run, accuracy - mean AS delta, bound, CASE WHEN n_replicates < 2 THEN 'no bound' WHEN abs(accuracy - mean) > bound THEN 'moved' ELSE 'within' END AS verdict FROM runs JOIN bd USING (vintage) WHERE NOT replicate",
    "run_sequences": f"WITH {RUNS} SELECT vintage AS series, CAST(row_number() OVER (PARTITION BY vintage, replicate ORDER BY run) - 1 AS INTEGER) AS t, accuracy AS value, replicate AS is_reference FROM runs",
    "series_listing": f"WITH {RUNS} SELECT substr(sha256(vintage), 1, 12) AS series_id, count(DISTINCT run) AS n_runs, count(DISTINCT run) FILTER (replicate) AS n_replicates, string_agg(DISTINCT vintage, ',') AS vintages FROM runs GROUP BY 1",
    "page_hinkley": f"WITH {DAILY}, {PH} SELECT series, t, statistic, statistic > 0.05::DOUBLE AS alarm FROM ph",
    "cusum": f"WITH {DAILY}, {CU} SELECT series, t, statistic, statistic > 0.05::DOUBLE AS alarm FROM cu",
    "conformal_alarm": f"WITH {DAILY}, {CF} SELECT * FROM cf",
    "monitor_panel": f"{PANEL} SELECT * FROM panel",
    "monitor_scorecard": f"{PANEL} SELECT monitor, series, count(*) FILTER (alarm AND t < 25) AS false_alarms, min(t) FILTER (alarm AND t >= 25) - 25 AS latency FROM panel GROUP BY ALL",
    "interval_counts": "SELECT event_type, ts::DATE AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    "token_discrepancy": detectors.DISCREPANCY_SQL,
    "perplexity_ratio": detectors.RATIO_SQL,
}
