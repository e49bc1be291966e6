"""The roles that the star-schema test tables play for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.text import has_words, length_bucket, short_text, word_count
from plumbline.plans.shared import read_table, table_exists, write_table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PREPARED: dict[tuple, tuple[str, DataFrame]] = {}


def _stamp(spark: SparkSession, df: DataFrame) -> tuple:
    """The files of a table and when each was written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(df.inputFiles())]
    return tuple((str(p), p.getFileSystem(conf).getFileStatus(p).getModificationTime()) for p in at)


def counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_words, score) of documents that have words. Counting words is most of
    what any statistic over documents costs, so it is done once for each session and state of the
    files, and the narrow result is written."""
    docs = load(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, *_stamp(spark, docs))
    if key not in _PREPARED or not table_exists(spark, _PREPARED[key][0]):
        # Few files or row groups would be as few tasks; words are counted in as many as there are cores.
        slices = docs.select("doc_id", "lang", "source", "text", F.col("n_chars").cast("double").alias("c")).filter(has_words("text"))
        if slices.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            slices = slices.repartition(spark.sparkContext.defaultParallelism)
        rows = slices.select("doc_id", "lang", "source", "c", word_count("text").alias("n_words"))
        rows = rows.select("doc_id", "lang", "source", "n_words", (F.col("c") / F.col("n_words")).alias("score"))
        path = write_table(rows, "documents-counted")
        _PREPARED[key] = path, read_table(spark, path, rows.schema)
    return _PREPARED[key][1]


def scored(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """(doc_id, lang, source, n_words, score, y): score is characters per word. ``label``: "lang"
    (positive: not English), "toxic" or "quality" (positive: quality 0), the latter two for
    labelled documents only. Documents without words have no score and stay out."""
    docs = counted_documents(spark, sf_dir)
    if label == "lang":
        return docs.withColumn("y", F.when(F.col("lang") != "en", 1).otherwise(0))
    labels = load(spark, sf_dir, "labels")
    y = F.col("toxic") if label == "toxic" else 1 - F.col("quality")
    return docs.join(labels.select("doc_id", y.cast("int").alias("y")), "doc_id")


def populations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference (even doc_id) and candidate (odd doc_id) documents."""
    s = scored(spark, sf_dir)
    return s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1")


def axes() -> dict:
    return {"length": length_bucket("n_words"), "source": F.col("source"), "lang": F.col("lang")}


def daily_series(spark: SparkSession, sf_dir: str, reference_days: int = 20) -> DataFrame:
    """(series, t, value, is_reference): mean event value for each type and day; the first days are
    the reference."""
    e = load(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    first = e.agg(F.min("day").alias("d0"))
    d = e.groupBy("event_type", "day").agg(F.avg("value").alias("value")).crossJoin(F.broadcast(first))
    t = F.datediff("day", "d0")
    return d.select(F.col("event_type").alias("series"), t.alias("t"), "value", (t < reference_days).alias("is_reference"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, vintage, prompt, answer, response): a user turn and the assistant turn next to
    it; the key is the turn's first word, the response's is its own."""
    c = load(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    word = lambda t: F.element_at(F.split(F.trim(t), "[ \\n]+"), 1)
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("vintage"), "prompt", word(F.col("prompt")).alias("answer"), word(F.col("reply")).alias("response")
    )


__all__ = ["load", "scored", "populations", "axes", "daily_series", "answers", "short_text"]
