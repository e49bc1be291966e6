"""Probe answers: grading, calibration of stated probabilities, accuracy by vintage, lint, hashes."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.text import normalize_answer, word_count

ECE_BINS = 10
ANSWER_WORDS = 5


def grade_free_text(answers: DataFrame, normalize=normalize_answer, aliases: str | None = None) -> DataFrame:
    """``answers`` (answer, response[, aliases]) with ``normalized``, ``correct`` and ``matched``: the
    first of the key and its aliases whose normalised form is the response's."""
    keys = F.array("answer") if aliases is None else F.concat(F.array("answer"), F.coalesce(aliases, F.array().cast("array<string>")))
    out = answers.withColumn("normalized", normalize("response"))
    found = F.filter(keys, lambda k: normalize_answer(k) == F.col("normalized"))
    return out.withColumn("matched", F.try_element_at(found, F.lit(1))).withColumn("correct", F.size(found) > 0)


def grade_choice(rows: DataFrame, options: str = "options", key: str = "key") -> DataFrame:
    """``rows`` with chosen, tie, correct from a map of option to log-probability: the largest wins; a
    tie at the top is wrong and chooses nothing; a key that isn't among the options is refused."""
    top = F.array_max(F.map_values(options))
    best = F.map_keys(F.map_filter(options, lambda _, v: v == top))
    known = F.array_contains(F.map_keys(options), F.col(key))
    return rows.select(
        "*", F.when(F.size(best) == 1, best[0]).alias("chosen"), (F.size(best) > 1).alias("tie"),
        F.when(known, (F.size(best) == 1) & (best[0] == F.col(key))).alias("correct"), F.when(~known, F.lit("the key is not an option")).alias("refusal"),
    )


def true_share(log_true: Column, log_false: Column) -> Column:
    """Two-way softmax, shifted by the larger so that it can't overflow."""
    m = F.greatest(log_true, log_false)
    t, f = F.exp(log_true - m), F.exp(log_false - m)
    return t / (t + f)


def vintage_accuracy(graded: DataFrame) -> DataFrame:
    """(vintage, n, accuracy)."""
    return graded.groupBy("vintage").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def post_cutoff_share(probes: DataFrame, cutoff: str) -> DataFrame:
    """(vintage, n, n_after, share) of probes whose source is later than the training cutoff."""
    late = F.col("source_date") > F.lit(cutoff).cast("date")
    return probes.groupBy("vintage").agg(F.count("*").alias("n"), F.count_if(late).alias("n_after"), F.avg(late.cast("double")).alias("share"))


def ece_bins(rows: DataFrame, by: list[str] | None = None, bins: int = ECE_BINS) -> DataFrame:
    """(by..., bin, n, confidence, accuracy) of (confidence, correct), empty bins included."""
    by = by or []
    b = F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    seen = rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(seen, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def probability_block(rows: DataFrame, by: list[str], bins: int = ECE_BINS) -> DataFrame:
    """(by..., n, ece, brier, gap, mean_confidence) of (confidence in [0, 1], correct); rows outside
    are counted as ``n_invalid`` and left out."""
    fine = F.col("confidence").between(0, 1) & F.col("correct").isNotNull()
    c, y = F.col("confidence"), F.col("correct").cast("double")
    head = rows.groupBy(*by).agg(
        F.count_if(fine).alias("n"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("n_invalid"), F.avg(F.when(fine, F.pow(c - y, 2))).alias("b"),
        (F.avg(F.when(fine, c)) - F.avg(F.when(fine, y))).alias("gap"), F.avg(F.when(fine, c)).alias("mean_confidence"),
    )
    parts = ece_bins(rows.filter(fine), by, bins).groupBy(*by).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("e"))
    return head.join(parts, by, "left").select(*by, "n", "n_invalid", F.try_divide(F.col("e"), F.col("all").cast("double")).alias("ece"), F.coalesce("b", F.lit(float("nan"))).alias("brier"), "gap", "mean_confidence")


def lint(probes: DataFrame, cutoff: str) -> DataFrame:
    """(severity, probe_id, rule) of (id, prompt, answer, aliases, source_date, authored)."""
    cut = F.lit(cutoff).cast("date")
    key = normalize_answer("answer")
    shared = F.size(F.array_distinct(F.transform(F.col("aliases"), normalize_answer))) < F.size("aliases")
    rules = [
        ("error", "required field missing", F.col("prompt").isNull() | F.col("answer").isNull() | F.col("source_date").isNull()),
        ("error", "authored missing", F.col("authored").isNull()), ("error", "authored before its source", F.col("authored") < F.col("source_date")),
        ("error", "source not after the cutoff", F.col("source_date") <= cut), ("error", "answer normalises to nothing", F.col("answer").isNotNull() & (key == "")),
        ("warning", "alias repeats under normalisation", F.coalesce(shared, F.lit(False))), ("warning", "answer is long", word_count("answer") > ANSWER_WORDS),
    ]
    hits = F.filter(F.array(*(F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, cond in rules)), lambda x: x.isNotNull())
    own = probes.withColumn("h", F.explode(hits)).select("h.severity", F.col("id").alias("probe_id"), "h.rule")
    # Repeats by aggregation and a join back, so that a prompt shared by many meets no window.
    same = lambda col: probes.groupBy(col).agg(F.count("*").alias("c")).filter("c > 1").select(col)
    ids = same("id").select(F.lit("error").alias("severity"), F.col("id").alias("probe_id"), F.lit("id repeats").alias("rule"))
    prompts = probes.join(same("prompt"), "prompt", "left_semi").select(F.lit("warning").alias("severity"), F.col("id").alias("probe_id"), F.lit("prompt repeats").alias("rule"))
    return own.unionByName(ids).unionByName(prompts)


def content_hashes(rows: DataFrame) -> DataFrame:
    """(vintage, n, content_hash) of (vintage, json): sha256 of a vintage's probes, each as JSON with
    sorted keys and without private ones (those that begin with an underscore), sorted and joined by
    line breaks. That is what a frozen vintage is compared by, so it can't be hashed in parts: a vintage
    is sorted by the cluster and hashed as it streams by, one probe in memory at a time."""

    @F.arrow_udf("string")
    def canonical(texts: pa.Array) -> pa.Array:
        plain = lambda x: json.dumps({k: v for k, v in json.loads(x).items() if not k.startswith("_")}, sort_keys=True)
        return pa.array([None if t is None else plain(t) for t in texts.to_pylist()], pa.string())

    def run(batches):
        held, digest, n = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([held]), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["vintage", "n", "content_hash"])
        for batch in batches:
            for vintage, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or vintage != held:
                    if digest is not None:
                        yield done()
                    held, digest, n = vintage, hashlib.sha256(), 0
                digest.update(("\n" if n else "").encode() + text.encode())
                n += 1
        if digest is not None:
            yield done()

    each = rows.filter("vintage IS NOT NULL AND json IS NOT NULL").select("vintage", canonical("json").alias("text"))
    return each.repartition("vintage").sortWithinPartitions("vintage", "text").mapInArrow(run, "vintage string, n long, content_hash string")


def template_fingerprint(template: str, options: dict[str, str], version: str) -> dict[str, str]:
    """What a yes-or-no prompt adds to an instrument's identity: a changed template is another one."""
    material = template + "||" + repr(sorted(options.items()))
    return {"version": version, "template_sha256": hashlib.sha256(material.encode()).hexdigest()}


def vintage_hashes(rows: DataFrame, vintage: str, columns: list[str]) -> DataFrame:
    """(vintage, n, content_hash): independent of row order, for vintages too large to be hashed in one
    stream (:func:`content_hashes` gives the hash that a frozen vintage is known by). Rows are hashed, gathered into buckets
    by their hash's first two digits, and the buckets' hashes hashed, so that a large vintage is
    spread over its buckets."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    r = rows.select(F.col(vintage).alias("vintage"), h.alias("h"))
    b = r.groupBy("vintage", F.substring("h", 1, 2).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("bh"))
    return b.groupBy("vintage").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "bh"))), lambda x: x["bh"]), "\n"), 256).alias("content_hash"))


def freeze_violations(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(vintage, was, now): vintages whose content changed; new ones pass."""
    return stored.select("vintage", F.col("content_hash").alias("was")).join(now.select("vintage", F.col("content_hash").alias("now")), "vintage").filter("was <> now")
