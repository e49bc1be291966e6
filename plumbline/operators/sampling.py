"""Corpus preparation: keyed, order-free sampling.

Where a seeded shuffle would depend on row order, rows are ordered by md5 of "seed:id": uniform,
repeatable, the same in any engine and mergeable, so the smallest n of each cell are a uniform
sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.text import clip_words, word_count

SEED = 17
PER_CELL, CELL_WORDS = 60, (50, 500)
SUBSAMPLE, SUBSAMPLE_WORDS = 100, (50, 300)
POOL_FACTOR = 3


def order_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def map_rows(raw: DataFrame) -> DataFrame:
    """(id, text, label, meta) of benchmark rows (id, model, domain, attack, generation): model
    "human" is the negative class; blank fields are "unknown", a blank attack "none"."""
    fill = lambda c, v: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v))
    meta = F.create_map(F.lit("domain"), fill("domain", "unknown"), F.lit("model"), fill("model", "unknown"), F.lit("attack"), fill("attack", "none"))
    return raw.select("id", F.col("generation").alias("text"), F.when(F.col("model") == "human", "human").otherwise("ai").alias("label"), meta.alias("meta"))


def within_words(rows: DataFrame, low: int, high: int, text: str = "text") -> DataFrame:
    return rows.filter(word_count(text).between(low, high))


def clip_and_filter(rows: DataFrame, least: int, most: int, text: str = "text") -> DataFrame:
    """Texts of at least ``least`` words, clipped to ``most``."""
    return rows.filter(word_count(text) >= least).withColumn(text, clip_words(text, most))


def cell_grid(**axes: list[str]) -> list[dict]:
    """Every combination of the axes' values but human texts under an attack."""
    import itertools

    every = [dict(zip(axes, v)) for v in itertools.product(*axes.values())]
    return [c for c in every if not (c.get("model") == "human" and c.get("attack", "none") != "none")]


def cell_key(*columns: str) -> Column:
    return F.concat_ws("|", *columns)


def wanted(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of the wanted cells (a semi join on the cells' columns)."""
    return rows.join(cells, cells.columns, "left_semi")


def first_of_each(rows: DataFrame, by: list[str], n: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """The n rows of each cell that sort first by key. Each task first keeps the n best of what it
    has (a rank filter that runs before the shuffle), so a hot cell sends n rows a task."""
    w = Window.partitionBy(*by).orderBy(order_key(id_col, seed), id_col)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def class_subsample(rows: DataFrame, n: int, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """(label, taken, refusal, ids...) n rows of each class; a class that is short is refused whole."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    short = counts.filter(F.col("_n") < n).select(label)
    return first_of_each(rows.join(short, label, "left_anti"), [label], n, id_col, seed)


def window_subsample(rows: DataFrame, by: list[str], n: int, id_col: str, pool: int = POOL_FACTOR, seed: int = SEED) -> DataFrame:
    """Of each cell's first ``pool`` times n rows by identifier, each identifier once, the n that sort
    first by key."""
    distinct = rows.dropDuplicates([*by, id_col])
    w = Window.partitionBy(*by).orderBy(id_col)
    window = distinct.withColumn("_w", F.row_number().over(w)).filter(F.col("_w") <= n * pool).drop("_w")
    return first_of_each(window, by, n, id_col, seed)


def shuffled(rows: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    return rows.orderBy(order_key(id_col, seed), id_col)


def prepare_slice(rows: DataFrame, cells: DataFrame, per_cell: int = PER_CELL, words=CELL_WORDS, id_col: str = "id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The slice: wanted cells, word range, a sample of each cell, in keyed order."""
    if per_cell < 1 or words[0] > words[1]:
        raise ValueError("per_cell must be positive and the word range ascending")
    kept = within_words(wanted(rows, cells), *words, text)
    return shuffled(first_of_each(kept, cells.columns, per_cell, id_col, seed), id_col, seed)


def first_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the one that sorts first (a map-side minimum, not a window)."""
    rest = [c for c in rows.columns if c not in key and c != order]
    return rows.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_f")).select(*key, "_f.*")


def still_to_do(corpus: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    return corpus.join(done.select(id_col), id_col, "left_anti")


def rehydrate(done: DataFrame, corpus: DataFrame, id_col: str = "id") -> DataFrame:
    """Scored rows with the corpus's own columns: the corpus is the truth for all but the score."""
    own = [c for c in corpus.columns if c != id_col]
    return done.drop(*own).join(corpus, id_col)
