"""Records, evidence, feasibility and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import curves, drift, evidence, rules, shift
from plumbline.plans.shared import own_dir, shared_dir
from plumbline.plans.tables import daily_series, load, scored
from plumbline.queries.calibration import CURVE, LANG, SCORED, _rates, rates_sql, threshold_sql
from plumbline.queries.monitoring import CU, DAILY, PH

CONFIGS = [("small", "ram", None), ("medium", "gpu", None), ("large", "gpu", 24.0), ("served", "ram", None)]
MEASURED = [("small", "ram", 8.0), ("medium", "gpu", 13.7), ("served", "gpu", 5.0)]
ERRORS = [None, "ManifestNotFound: no manifest", "No module named c2pa", "broken pipe"]


def _floors(s):
    return rules.effective_floor(s.createDataFrame(CONFIGS, "name string, kind string, explicit_gb double"), s.createDataFrame(MEASURED, "name string, kind string, gb double"), 6.0)


def _modes(s, d):
    rows = scored(s, d).withColumn("label", F.when(F.col("y") == 1, "ai").otherwise("human"))
    each = [shift.ks_distance(shift.reference_rows(rows, m), rows).select(F.lit(m).alias("mode"), "n_reference", "ks") for m in shift.MODES]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _evidence(s, d):
    p = load(s, d, "pages").select("page_id", F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("page_id") % 4 + 1).cast("int")).alias("error"))
    status = F.when(F.col("page_id") % 8 == 7, rules.carrier_negative(F.col("page_id") % 16 == 7)).otherwise(rules.reader_status(F.col("error")))
    rows = p.select("page_id", status.alias("status"), F.lit("reader outcome").alias("explanation"), F.lit(True).alias("self_test"))
    return rules.check_statuses(rows).select("page_id", "status")


def _verdicts(s, d):
    """Each document against the thresholds that all of them calibrate."""
    rows = scored(s, d)
    t = curves.threshold_at_fpr(rows).filter("refusal IS NULL")
    return rows.select("doc_id", "score").crossJoin(F.broadcast(t)).select("doc_id", "target_fpr", (F.col("score") >= F.col("threshold")).alias("flagged"))


def _stream(s, d):
    """The monitors over observed days as a stream, written and read back."""
    import uuid

    from plumbline.streaming.monitors import run_once, stream_monitors

    at = f"{shared_dir(s)}/plumbline/stream-{uuid.uuid4().hex}"
    days = daily_series(s, d)
    x = drift.oriented(days)
    centre = x.filter("is_reference").groupBy("series").agg(F.avg("x").alias("centre"))
    days.filter("NOT is_reference").select("series", "t", "value").write.parquet(f"{at}/in")
    stream = s.readStream.schema("series string, t int, value double").parquet(f"{at}/in")
    run_once(stream_monitors(stream, centre), f"{at}/out", f"{at}/checkpoint")
    return s.read.parquet(f"{at}/out")


def _index(s, d):
    """Exports of one document for each event type, listed again."""
    import uuid

    from plumbline.sources.receipts import export_document, rebuild_index

    root = f"{shared_dir(s)}/plumbline/export-{uuid.uuid4().hex}"
    types = [r.event_type for r in load(s, d, "events").select("event_type").distinct().collect()]
    for t in types:
        export_document(s, root, t, {"id": t, "detector": "characters-per-word", "corpus": "events", "auroc": None, "version": "1", "generated_utc": "1970-01-01T00:00:00Z"})
    return rebuild_index(s, root).select("id", "detector", "corpus")


def _reservoir(s, d):
    """Five documents of each language and source, from a stream of document files."""
    import uuid

    from plumbline.streaming.monitors import Reservoir

    at = f"{own_dir(s)}/reservoir-{uuid.uuid4().hex}"
    docs = load(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    docs.repartition(4).write.parquet(f"{at}/in")
    keep = Reservoir(f"{at}/state", ["lang", "source"], 5)
    stream = s.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return keep.read(s, docs.schema)


def _files(s, d):
    """Pages as files of several kinds."""
    suffix = F.element_at(F.array(*map(F.lit, (".html", ".png", ".mp4", ".dat"))), (F.col("page_id") % 4 + 1).cast("int"))
    return load(s, d, "pages").select(F.concat(F.lit("/p"), F.col("page_id").cast("string"), suffix).alias("path"), F.col("html").cast("binary").alias("content"))


def _sweep(s, d):
    schemes = [evidence.signed_manifest(), evidence.image_watermark(b"mark"), evidence.PORTAL]
    return evidence.sweep_files(_files(s, d), schemes).select("path", "sha256", "scheme", "status")


QUERIES = {
    "evidence_sweep": _sweep,
    "text_evidence": lambda s, d: evidence.sweep_texts(load(s, d, "documents"), evidence.TEXT_SCHEMES, "doc_id", "text").select("id", "chars", "sha256", "scheme", "status"),
    "stream_reservoir": _reservoir,
    "page_addresses": lambda s, d: load(s, d, "pages").select("page_id", text.url_host("url").alias("host"), text.url_quoted("url").alias("quoted")),
    "rates_for_people": lambda s, d: _rates(s, d).select("axis", "value", text.percent("fpr").alias("fpr"), text.signed(F.col("tpr") - F.col("fpr")).alias("gain")),
    "reference_modes": lambda s, d: _modes(s, d),
    "memory_floor": lambda s, d: _floors(s),
    "feasibility": lambda s, d: rules.feasibility(_floors(s), s.createDataFrame([(12.0, 7.0)], "gpu_gb double, ram_gb double")),
    "evidence_statuses": _evidence,
    "media_kinds": lambda s, d: load(s, d, "pages").select("page_id", rules.media_kind(F.regexp_replace("url", r"[?#].*$", "")).alias("kind")),
    "document_verdicts": _verdicts,
    "stream_monitors": _stream,
    "receipt_index": _index,
}
VALUES = "c(name, kind, e) AS (VALUES ('small', 'ram', NULL::DOUBLE), ('medium', 'gpu', NULL), ('large', 'gpu', 24.0::DOUBLE), ('served', 'ram', NULL)), m(name, kind, gb) AS (VALUES ('small', 'ram', 8.0::DOUBLE), ('medium', 'gpu', 13.7::DOUBLE), ('served', 'gpu', 5.0::DOUBLE))"
FLOORS = f"WITH {VALUES}, f AS (SELECT name, kind, coalesce(e, gb, 6.0::DOUBLE) AS floor_gb, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN gb IS NOT NULL THEN 'measured' ELSE 'default' END AS basis FROM c LEFT JOIN m USING (name, kind))"
ORACLES = {
    "memory_floor": f"{FLOORS} SELECT * FROM f",
    "feasibility": f"{FLOORS} SELECT name, kind, floor_gb, a AS available_gb, a >= floor_gb AS fits, CASE WHEN a < floor_gb THEN 'needs ' || printf('%.1f', floor_gb) || ' GB of ' || kind || ' memory' END AS refusal FROM (SELECT *, CASE WHEN kind = 'gpu' THEN 12.0::DOUBLE ELSE 7.0::DOUBLE END AS a FROM f)",
    "evidence_statuses": "SELECT page_id, CASE WHEN page_id % 16 = 7 THEN 'ABSENT' WHEN page_id % 8 = 7 THEN 'INCONCLUSIVE' ELSE ['PRESENT', 'ABSENT', 'UNAVAILABLE', 'INCONCLUSIVE'][page_id % 4 + 1] END AS status FROM pages",
    "media_kinds": r"SELECT page_id, CASE WHEN s IN ('.html', '.txt', '.md') THEN 'text' WHEN s IN ('.png', '.jpg', '.jpeg', '.webp') THEN 'image' WHEN s IN ('.mp4', '.mov') THEN 'video' WHEN s IN ('.wav', '.mp3') THEN 'audio' ELSE 'other' END AS kind FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1)) AS s FROM pages)",
}
ORACLES["document_verdicts"] = f"WITH t AS (SELECT target_fpr, threshold FROM ({threshold_sql(LANG)}) WHERE refusal IS NULL), {SCORED} SELECT doc_id, target_fpr, score >= threshold AS flagged FROM scored, t"
ORACLES["stream_monitors"] = f"WITH {DAILY}, {PH}, {CU} SELECT series, t, ph.statistic AS page_hinkley, ph.statistic > 0.05::DOUBLE AS ph_alarm, cu.statistic AS cusum, cu.statistic > 0.05::DOUBLE AS cusum_alarm, false AS out_of_order FROM ph JOIN cu USING (series, t)"
ORACLES["receipt_index"] = "SELECT DISTINCT event_type AS id, 'characters-per-word' AS detector, 'events' AS corpus FROM events"
FILES = "f AS (SELECT '/p' || page_id || ['.html', '.png', '.mp4', '.dat'][page_id % 4 + 1] AS path, page_id % 4 AS k, sha256(html) AS sha256 FROM pages)"
ORACLES["evidence_sweep"] = f"""WITH {FILES} SELECT path, sha256, 'signed-manifest' AS scheme, 'UNAVAILABLE' AS status FROM f
  UNION ALL SELECT path, sha256, 'image-watermark', 'INCONCLUSIVE' FROM f WHERE k = 1 UNION ALL SELECT path, sha256, 'portal-only', 'UNAVAILABLE' FROM f WHERE k IN (1, 2)"""
ORACLES["text_evidence"] = "SELECT doc_id AS id, CAST(length(coalesce(text, '')) AS INTEGER) AS chars, sha256(coalesce(text, '')) AS sha256, unnest(['keyed-sampling', 'keyed-partition']) AS scheme, 'UNAVAILABLE' AS status FROM documents"
ORACLES["stream_reservoir"] = "SELECT doc_id AS id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('17:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5"
ORACLES["page_addresses"] = r"SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host, url_encode(url) AS quoted FROM pages"
ORACLES["rates_for_people"] = f"WITH {LANG}{CURVE}, {rates_sql('s')} SELECT axis, value, CASE WHEN fpr IS NULL THEN 'withheld' ELSE printf('%.1f %%', 100 * fpr) END AS fpr, printf('%+.3f', tpr - fpr) AS gain FROM rates"
ORACLES["reference_modes"] = f"""WITH {LANG}, m AS (SELECT unnest(['all', 'human', 'ai']) AS mode), r AS (SELECT mode, score FROM m, s WHERE mode = 'all' OR mode = CASE WHEN y = 1 THEN 'ai' ELSE 'human' END),
  f AS (SELECT mode, score, sum(p) AS a, sum(1 - p) AS b FROM (SELECT mode, score, 1 AS p FROM r UNION ALL SELECT mode, score, 0 FROM m, s) GROUP BY ALL),
  u AS (SELECT mode, sum(a) OVER w / (sum(a) OVER (PARTITION BY mode))::DOUBLE AS x, sum(b) OVER w / (sum(b) OVER (PARTITION BY mode))::DOUBLE AS y FROM f WINDOW w AS (PARTITION BY mode ORDER BY score ROWS UNBOUNDED PRECEDING))
  SELECT mode, (SELECT count(*) FROM r WHERE r.mode = u.mode) AS n_reference, max(abs(x - y)) AS ks FROM u GROUP BY mode"""
