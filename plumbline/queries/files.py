"""Files that a user has, written from the test tables and read back by the scans."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from plumbline.operators import probes
from plumbline.plans.shared import own_dir
from plumbline.plans.tables import load, scored
from plumbline.queries.calibration import LANG, SCORED
from plumbline.queries.monitoring import ANSWERS, PROBES, probe_set
from plumbline.sources import receipts, tables

TEMPLATE, OPTIONS = "Question: {prompt}\nProposed answer: {answer}\nIs it right?", {"true": " yes", "false": " no"}


def _new(spark, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _corpus(s, d):
    """Labelled JSON lines of every document: a line without text would be refused, so null is empty."""
    at = _new(s, "corpus")
    label = F.when(F.col("lang") == "en", "human").otherwise("ai")
    row = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), label.alias("label"), F.create_map(F.lit("source"), F.coalesce("source", F.lit("none"))).alias("meta"))
    load(s, d, "documents").select(F.to_json(row).alias("value")).write.text(at)
    return at


def _labelled(s, d):
    return tables.read_labelled(s, _corpus(s, d)).select("id", "label", F.col("meta")["source"].alias("source"), F.md5("text").alias("text_md5"))


def _candidates(s, d):
    rows, labels = tables.read_candidates(s, _corpus(s, d))
    return rows.select("id", F.md5("text").alias("text_md5"), F.lit(labels).alias("labels_noted"))


def _report(s, d):
    """A report folder as a user has it: scores.csv, env.json, results.json."""
    at = _new(s, "report")
    rows = scored(s, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("y") == 1, "ai").otherwise("human").alias("label"), "score", "n_words", F.to_json(F.struct("source")).alias("meta"))
    rows.write.option("header", True).option("escape", '"').csv(f"{at}/scores.csv")
    receipts.put_text(s, f"{at}/env.json", json.dumps({"detector": {"name": "characters-per-word"}, "corpus": {"name": "documents"}}))
    receipts.put_text(s, f"{at}/results.json", json.dumps({"n_boot": 1000}))
    return at


def _scores(s, d):
    return tables.read_scores(s, f"{_report(s, d)}/scores.csv").select("id", "label", "score", "n_words", F.col("meta")["source"].alias("source"))


def _row_numbers(s, d):
    """Rows are numbered from 0 without a gap, however many files and splits they are in."""
    rows = tables.read_scores(s, f"{_report(s, d)}/scores.csv")
    return rows.agg(F.count("*").alias("n"), F.min("row_ix").alias("first"), F.max("row_ix").alias("last"), F.count_distinct("row_ix").alias("numbers"))


def _loaded(s, d):
    scores, env = receipts.load_report(s, _report(s, d))
    name, corpus = env["detector"]["name"], env["corpus"]["name"]
    return scores.groupBy("label").agg(F.count("*").alias("n"), F.sum("y").alias("positive"), F.max("score").alias("top")).select("*", F.lit(name).alias("detector"), F.lit(corpus).alias("corpus"))


def _instrument(s, d):
    scores, env, results = receipts.load_instrument(s, _report(s, d))
    return scores.select("score", "y", F.lit(env["detector"]["name"]).alias("detector"), F.lit(results["n_boot"]).alias("n_boot"))


def _states(s, d):
    """A run that begins, goes on, completes, and is refused to another scorer."""
    at, n = _new(s, "run"), load(s, d, "documents").count()
    corpus, told = {"name": "documents", "counts": {"all": n}}, []
    note = lambda step, state: told.append((step, state["corpus"]["counts"]["all"], state["complete"]))
    note("begun", receipts.begin_run(s, at, corpus, {"detector": "a"}))
    note("resumed", receipts.begin_run(s, at, corpus, {"detector": "a"}))
    note("completed", receipts.complete_run(s, at))
    try:
        receipts.begin_run(s, at, corpus, {"detector": "b"})
    except tables.Refusal:
        note("refused", receipts.read_run(s, at))
    return s.createDataFrame(told, "step string, documents long, complete boolean")


def _probe_json(s, d):
    """Probes as lines of a file, with a private key; texts as digests, since SQL has no way to escape
    what isn't ASCII."""
    p = probe_set(s, d)
    row = F.to_json(F.struct("vintage", F.md5("prompt").alias("prompt"), "id", F.lit("x").alias("_note"), F.md5("answer").alias("answer")))
    return p.select("vintage", row.alias("json"))


def _fingerprint(s, d):
    f = probes.template_fingerprint(TEMPLATE, OPTIONS, "1")
    return load(s, d, "conversations").agg(F.count("*").alias("n")).select(F.lit(f["template_sha256"]).alias("template_sha256"), "n")


QUERIES = {
    "labelled_scan": _labelled, "candidate_scan": _candidates, "score_scan": _scores, "score_row_numbers": _row_numbers, "report_scan": _loaded, "instrument_scan": _instrument, "run_states": _states,
    "content_hashes": lambda s, d: probes.content_hashes(_probe_json(s, d)), "template_fingerprint": _fingerprint,
}

ORACLES = {
    "labelled_scan": "SELECT 'd' || doc_id AS id, CASE WHEN lang = 'en' THEN 'human' ELSE 'ai' END AS label, coalesce(source, 'none') AS source, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "candidate_scan": "SELECT 'd' || doc_id AS id, md5(coalesce(text, '')) AS text_md5, true AS labels_noted FROM documents",
    "score_scan": f"WITH {LANG} SELECT 'd' || doc_id AS id, CASE WHEN y = 1 THEN 'ai' ELSE 'human' END AS label, score, n_words, source FROM s",
    "score_row_numbers": f"WITH {SCORED} SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS numbers FROM scored",
    "report_scan": f"WITH {LANG} SELECT CASE WHEN y = 1 THEN 'ai' ELSE 'human' END AS label, count(*) AS n, sum(y)::BIGINT AS positive, max(score) AS top, 'characters-per-word' AS detector, 'documents' AS corpus FROM s GROUP BY y",
    "instrument_scan": f"WITH {LANG} SELECT score, y, 'characters-per-word' AS detector, 1000 AS n_boot FROM s",
    "content_hashes": f"""WITH {ANSWERS}, {PROBES}, j AS (SELECT vintage, '{{"answer": "' || md5(answer) || '", "id": "' || id || '", "prompt": "' || md5(prompt) || '", "vintage": "' || vintage || '"}}' AS j FROM p)
      SELECT vintage, count(*) AS n, sha256(string_agg(j, chr(10) ORDER BY j)) AS content_hash FROM j GROUP BY vintage""",
    "run_states": "SELECT unnest(['begun', 'resumed', 'completed', 'refused']) AS step, n AS documents, unnest([false, false, true, true]) AS complete FROM (SELECT count(*) AS n FROM documents)",
    "template_fingerprint": f"SELECT sha256('Question: {{prompt}}' || chr(10) || 'Proposed answer: {{answer}}' || chr(10) || 'Is it right?||[(''false'', '' no''), (''true'', '' yes'')]') AS template_sha256, count(*) AS n FROM conversations",
}
