"""Scans of labelled corpora, candidates, score tables, probe sets, manifests and reports.

A scan reads with an explicit schema and refuses bad rows with :class:`Refusal`, naming the first of
them; what is optional and missing becomes null columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

LABELS = ("human", "ai")
UNKNOWN = "unknown"


class Refusal(ValueError):
    """Input that the operators won't compute on, with the reason."""


def _refuse(bad: DataFrame, what: str, by: str) -> None:
    first = bad.orderBy(by).limit(1).collect()
    if first:
        raise Refusal(f"{what}: {by} {first[0][by]}")


def require_columns(df: DataFrame, needed) -> None:
    """Refuses a table that lacks columns, naming them: its schema has drifted."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise Refusal(f"missing columns: {', '.join(missing)}")


def numbered(rows: DataFrame, number: str) -> DataFrame:
    """``rows`` of a file scan (with columns _file and _block: the file and where the split begins in it)
    with ``number``: their place in their file, from 0, and _before: how many rows earlier files have.

    Within a split rows come in file order; the splits' row counts, a row for each split, say where each
    begins. So a large file is read by many tasks and no window sees its rows."""
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    # The count of a scan that only reads where rows are; splits don't depend on the columns read.
    counts = at.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("_file").agg(F.sum("_n").alias("_of_file"))
    files = sizes.select("_file", F.coalesce(F.sum("_of_file").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(files, "_file")
    out = at.join(starts, ["_file", "_block"])
    return out.withColumn(number, F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_first", "_n", "_start", "_block")


_PLACE = ("_metadata.file_path AS _file", "_metadata.file_block_start AS _block")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(stem, line, value) of JSON-lines files, numbered from 0 by physical line of each file."""
    raw = spark.read.text(path).selectExpr(*_PLACE, "regexp_extract(_metadata.file_name, '^(.*?)(?:[.][^.]*)?$', 1) AS stem", "value")
    return numbered(raw, "line").select("stem", "line", "value").filter(F.trim("value") != "")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label, meta, line) of a labelled corpus; a line without text or with another label
    is refused, a missing id is made from the file's stem and the line."""
    j = _lines(spark, path).withColumn("r", F.from_json("value", "id string, text string, label string, meta map<string,string>"))
    rows = j.select(F.coalesce("r.id", F.concat_ws("-", "stem", "line")).alias("id"), "r.text", "r.label", F.col("r.meta").alias("meta"), "line")
    _refuse(rows.filter(F.col("text").isNull() | ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))), "a row needs text and a known label", "line")
    return rows


def read_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """((id, text, meta, line), whether labels were present): labels are noted and left out; an empty
    file is refused."""
    j = _lines(spark, path).withColumn("r", F.from_json("value", "id string, text string, label string, meta map<string,string>"))
    rows = j.select(F.coalesce("r.id", F.concat_ws("-", "stem", "line")).alias("id"), "r.text", "r.label", F.col("r.meta").alias("meta"), "line")
    _refuse(rows.filter("text IS NULL"), "a candidate needs text", "line")
    seen = rows.agg(F.count("*").alias("n"), F.count("label").alias("k")).first()
    if not seen.n:
        raise Refusal("no candidates")
    return rows.drop("label"), seen.k > 0


SCORE_FIELDS = ("id", "label", "score", "seconds", "n_words", "meta")


def read_scores(spark: SparkSession, path: str, labelled: bool = True, partial: bool = False, multi_line: bool = False) -> DataFrame:
    """(id, label, score, seconds, n_words, meta, row_ix) of a score table with a header; columns
    beyond score (and label) are optional. ``partial``: a file whose last line may be cut off; rows
    without a readable score are then dropped instead of refused. A file is read in splits, so a line is
    a row; ``multi_line`` reads fields that hold line breaks, a file to a task. row_ix is the row's place
    in the file, over several files in the order of their paths."""
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, multiLine=multi_line, escape='"', mode="DROPMALFORMED" if partial else "PERMISSIVE")
    require_columns(raw, ["score", "label"] if labelled else ["score"])
    known = [c for c in SCORE_FIELDS if c in raw.columns]
    rows = numbered(raw.selectExpr(*_PLACE, *known), "row_ix").withColumn("row_ix", F.col("_before") + F.col("row_ix"))
    has = lambda c: F.col(c) if c in known else F.lit(None).cast("string")
    words = F.expr("cast(try_cast(n_words as double) as int)") if "n_words" in known else F.lit(None).cast("int")
    out = rows.select(
        F.coalesce(has("id"), F.concat(F.lit("row"), F.col("row_ix").cast("string"))).alias("id"), has("label").alias("label"), F.expr("try_cast(score as double)").alias("score"),
        F.expr("try_cast(seconds as double)").alias("seconds") if "seconds" in known else F.lit(None).cast("double").alias("seconds"), words.alias("n_words"), F.from_json(has("meta"), "map<string,string>").alias("meta"), "row_ix",
    )
    if partial:
        return out.filter("score IS NOT NULL")
    bad = F.col("score").isNull() | (~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)) if labelled else F.lit(False))
    _refuse(out.filter(bad), "a row needs a score and a known label" if labelled else "a row needs a score", "row_ix")
    if out.isEmpty():
        raise Refusal("no scores")
    return out


def as_binary(scores: DataFrame, strict: bool = True) -> DataFrame:
    """(…, y): 1 for the positive class. Not strict: any label but "human" is positive."""
    y = F.when(F.col("label") == "human", 0)
    return scores.withColumn("y", y.when(F.col("label") == "ai", 1) if strict else y.otherwise(1))


PROBE_FIELDS = ("id", "prompt", "answer", "vintage", "source", "source_date")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(id, prompt, answer, vintage, source, source_date, authored, aliases, line): required fields,
    unique ids and ISO dates, or a refusal."""
    schema = "id string, prompt string, answer string, vintage string, source string, source_date string, authored string, aliases array<string>"
    rows = _lines(spark, path).withColumn("r", F.from_json("value", schema)).select("line", "r.*")
    if rows.isEmpty():
        raise Refusal("no probes")
    absent = F.lit(False)
    for f in PROBE_FIELDS:
        absent = absent | F.col(f).isNull()
    _refuse(rows.filter(absent), "a probe lacks a required field", "line")
    _refuse(rows.groupBy("id").agg(F.min("line").alias("line"), F.count("*").alias("n")).filter("n > 1"), "a probe id repeats", "line")
    date = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_cast({c} as date)"))
    _refuse(rows.filter(date("source_date").isNull() | (F.col("authored").isNotNull() & date("authored").isNull())), "a probe's date is not an ISO date", "line")
    return rows.select("id", "prompt", "answer", "vintage", "source", date("source_date").alias("source_date"), date("authored").alias("authored"), "aliases", "line")


def probe_rows(spark: SparkSession, path: str) -> DataFrame:
    """(vintage, json): each probe as it is in the file, for :func:`plumbline.operators.probes.content_hashes`."""
    return _lines(spark, path).select(F.get_json_object("value", "$.vintage").alias("vintage"), F.col("value").alias("json"))


MANIFEST = "manifest_version int, probe_file string, training_cutoff string, grading struct<rule:string,version:string>, decoding struct<policy:string,temperature:double,top_p:double,top_k:int>, control struct<benchmark:string,sha256:string,path:string,scoring:string>"


def read_manifest(spark: SparkSession, probes_path: str) -> DataFrame | None:
    """The one-row manifest beside a probe set, or None if there is none."""
    path = f"{probes_path}.manifest.json"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def lint_manifest(manifest: DataFrame, probe_file: str) -> DataFrame:
    """(severity, rule) of a manifest's violations."""
    c = F.col
    rules = [
        ("unknown manifest version", ~c("manifest_version").eqNullSafe(1)), ("names another probe file", ~c("probe_file").eqNullSafe(probe_file)),
        ("unknown grading rule", c("grading.rule").isNull() | c("grading.version").isNull()), ("decoding is not greedy", ~c("decoding.policy").eqNullSafe("greedy") | ~c("decoding.temperature").eqNullSafe(0.0)),
        ("control is not named", c("control.benchmark").isNull()), ("control has no scoring", c("control.scoring").isNull()), ("control hash is not sha256", ~F.coalesce(c("control.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("cutoff is not an ISO date", F.expr("try_cast(training_cutoff as date)").isNull()),
    ]
    hits = F.filter(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in rules)), lambda x: x.isNotNull())
    return manifest.select(F.lit("error").alias("severity"), F.explode(hits).alias("rule"))


def may_run(manifest: DataFrame | None, probe_file: str, lints: DataFrame | None = None, temperature: float = 0.0) -> str:
    """"unenforced" without a manifest, "enforced" if all is clean; otherwise a refusal."""
    if manifest is None:
        return "unenforced"
    errors = [r.rule for r in lint_manifest(manifest, probe_file).limit(8).collect()]
    if lints is not None:
        errors += [r.rule for r in lints.filter("severity = 'error'").limit(8).collect()]
    if temperature != 0:
        errors.append("temperature is not zero")
    if errors:
        raise Refusal("; ".join(errors[:8]))
    return "enforced"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
