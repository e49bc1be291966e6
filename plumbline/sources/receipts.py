"""Sinks: report folders, exports, registries, appended partial results.

Paths go through Spark, so any store it reads will do. Tables that are rendered (Markdown, JSON) are
result tables, bounded by thresholds, groups and alphas."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.sources.tables import UNKNOWN, Refusal, as_binary, read_scores


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first().value


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file at once: to a neighbour, then renamed."""
    at, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"could not write {path}")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False) + "\n"


def percent(x: float | None) -> str:
    return "withheld" if x is None else f"{100 * x:.1f} %"


def markdown(name: str, df: DataFrame) -> str:
    """A result table as Markdown, in the order of its columns."""
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = df.orderBy(*[c for c, t in df.dtypes if not t.startswith("map")]).collect()
    lines = [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows), ""])


#: Tables with a row for each distinct score: they have a file, and no place in a report for people.
_UNBOUNDED = ("roc",)


def write_report(out: str, scores: DataFrame, tables: dict[str, DataFrame], environment: dict, title: str = "Report") -> None:
    """scores (Parquet), one JSON-lines table for each result, env.json and report.md, which has the
    tables that are bounded by thresholds, groups and alphas."""
    spark = scores.sparkSession
    scores.write.mode("overwrite").parquet(f"{out}/scores")
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{out}/{name}")
    put_text(spark, f"{out}/env.json", canonical_json(environment))
    put_text(spark, f"{out}/report.md", "\n".join([f"# {title}", "", *(markdown(n, t) for n, t in tables.items() if n not in _UNBOUNDED)]))


def load_report(spark: SparkSession, out: str) -> tuple[DataFrame, dict]:
    """(scores, environment) of a report: this library's, or a folder with a scores.csv; a missing
    environment, or a missing part of it, is unknown. Neither table is no report."""
    env = read_text(spark, f"{out}/env.json")
    environment = {"detector": UNKNOWN, "corpus": UNKNOWN, "version": UNKNOWN} | (json.loads(env) if env else {}) if not env or path_exists(spark, f"{out}/scores.csv") else json.loads(env)
    if path_exists(spark, f"{out}/scores"):
        return spark.read.parquet(f"{out}/scores"), environment
    if not path_exists(spark, f"{out}/scores.csv"):
        raise Refusal(f"{out} has no scores: it is not a report")
    return as_binary(read_scores(spark, f"{out}/scores.csv")), environment


def load_instrument(spark: SparkSession, out: str) -> tuple[DataFrame, dict, dict]:
    """((score, y), environment, results) of a report, for placing new scores: any label but that of the
    negative class is positive. Scores stay a table; their order is the operators' business."""
    if not path_exists(spark, f"{out}/scores.csv"):
        raise Refusal(f"{out} has no scores.csv")
    texts = [read_text(spark, f"{out}/{name}.json") for name in ("env", "results")]
    if None in texts:
        raise Refusal(f"{out} lacks env.json or results.json")
    scores = as_binary(read_scores(spark, f"{out}/scores.csv", labelled=False), strict=False)
    return scores.select("score", "y"), json.loads(texts[0]), json.loads(texts[1])


STATE = "run.json"
#: What of an instrument must not change between the parts of one run.
PINNED = ("detector", "model_id", "quant_requested", "max_tokens", "device", "versions")


def begin_run(spark: SparkSession, out: str, corpus: dict, instrument: dict, reproduce: str = "", pinned=PINNED) -> dict:
    """The state of the run in ``out``: a new one, written before anything is scored, or that which is
    there, if corpus and pinned fields are the same; otherwise a refusal that names what differs."""
    now = {"corpus": corpus, "detector": {k: instrument.get(k) for k in pinned}, "reproduce": reproduce, "complete": False}
    old = read_text(spark, f"{out}/{STATE}")
    if old is None:
        put_text(spark, f"{out}/{STATE}", canonical_json(now))
        return now
    state = json.loads(old)
    differ = [f"corpus.{k}" for k in sorted({*state["corpus"], *corpus}) if state["corpus"].get(k) != corpus.get(k)]
    differ += [k for k in pinned if state["detector"].get(k) != now["detector"][k]]
    if differ:
        raise Refusal(f"{out} holds a run of another instrument or corpus: {', '.join(differ)}")
    return state


def read_run(spark: SparkSession, out: str) -> dict:
    text = read_text(spark, f"{out}/{STATE}")
    if text is None:
        raise Refusal(f"{out} has no {STATE}: there is no run to go on with")
    return json.loads(text)


def complete_run(spark: SparkSession, out: str) -> dict:
    """Mark the run as complete."""
    state = read_run(spark, out) | {"complete": True}
    put_text(spark, f"{out}/{STATE}", canonical_json(state))
    return state


def export_document(spark: SparkSession, root: str, name: str, document: dict, force: bool = False) -> bool:
    """Write a public document; the same bytes again are no change (False), other bytes need force."""
    path, text = f"{root}/receipts/{name}.json", canonical_json(document)
    old = read_text(spark, path)
    if old == text:
        return False
    if old is not None and not force:
        raise Refusal(f"{name} exists with other content")
    put_text(spark, path, text)
    return True


INDEX = "id string, detector string, corpus string, auroc double, version string, generated_utc string"


def rebuild_index(spark: SparkSession, root: str) -> DataFrame:
    """(path, id, …) of the documents that have the public shape, by id."""
    docs = spark.read.schema(INDEX).json(f"{root}/receipts", multiLine=True).select(F.col("_metadata.file_name").alias("path"), "*")
    return docs.filter("id IS NOT NULL AND detector IS NOT NULL").orderBy("id")


def series_id(identity: dict) -> str:
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def record_run(registry: str, runs: DataFrame, hashes: DataFrame, identity: dict) -> str:
    """Append (vintage, run, accuracy, replicate) to the series of this identity; a vintage whose
    content hash differs from the recorded one is refused."""
    from plumbline.operators.probes import freeze_violations

    spark, key = runs.sparkSession, series_id(identity)
    at, fs = _fs(spark, f"{registry}/hashes/series_id={key}")
    if fs.exists(at):
        stored = spark.read.parquet(str(at))
        broken = [r.vintage for r in freeze_violations(stored, hashes).limit(8).collect()]
        if broken:
            raise Refusal(f"frozen vintages changed: {', '.join(broken)}")
        hashes = hashes.join(stored, "vintage", "left_anti")
    hashes.select("vintage", "content_hash").write.mode("append").parquet(str(at))
    runs.withColumn("series_id", F.lit(key)).write.mode("append").partitionBy("series_id").parquet(f"{registry}/runs")
    return key


def append_scored(path: str, scored: DataFrame) -> DataFrame:
    """Append rows whose id isn't there yet; returns what was appended. Each append is committed
    whole, so an interrupted one leaves nothing behind."""
    spark = scored.sparkSession
    at, fs = _fs(spark, path)
    if fs.exists(at):
        scored = scored.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    scored.write.mode("append").parquet(path)
    return scored


def new_probe_set(spark: SparkSession, path: str, vintage: str, cutoff: str, examples: int = 2) -> None:
    """A probe set to fill in, beside its manifest; refuses to overwrite."""
    import datetime

    if read_text(spark, path) is not None:
        raise Refusal(f"{path} exists")
    day = (datetime.date.fromisoformat(cutoff) + datetime.timedelta(days=1)).isoformat()
    row = lambda k: {"id": f"{vintage}-{k}", "prompt": "REPLACE", "answer": "REPLACE", "vintage": vintage, "source": "REPLACE", "source_date": day, "authored": day, "aliases": []}
    put_text(spark, path, "".join(json.dumps(row(k)) + "\n" for k in range(1, examples + 1)))
    manifest = {"manifest_version": 1, "probe_file": path.rsplit("/", 1)[-1], "training_cutoff": cutoff, "grading": {"rule": "normalised-exact", "version": "1"}, "decoding": {"policy": "greedy", "temperature": 0.0, "top_p": 1.0, "top_k": 0}, "control": {"benchmark": "REPLACE", "sha256": "REPLACE", "path": "REPLACE", "scoring": "REPLACE"}}
    put_text(spark, f"{path}.manifest.json", canonical_json(manifest))
