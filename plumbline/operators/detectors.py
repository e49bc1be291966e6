"""Scorers: a protocol for plug-in detectors, and the arithmetic of two of them on logits.

Model weights are not part of this library: :class:`Detector` wraps any batch scorer, and a scorer
whose libraries are missing refuses with what to install."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.text import word_count


class Detector:
    """A named scorer of texts; higher means more of the positive class.

    ``load`` runs once in each worker and returns a function from texts to scores."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list[float]]], metadata: dict | None = None, needs: tuple[str, ...] = ()):
        self.name, self.load, self.metadata, self.needs = name, load, dict(metadata or {}), needs

    def check(self) -> None:
        import importlib.util

        missing = [m for m in self.needs if importlib.util.find_spec(m) is None]
        if missing:
            raise RuntimeError(f"{self.name} needs {', '.join(missing)}, not installed here")

    def score(self, rows: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """``rows`` with the score as column ``out``."""
        self.check()
        load = self.load

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = load()
            for part in parts:
                yield pd.Series(scorer(part.fillna("").tolist()), dtype="float64")

        return rows.withColumn(out, run(F.col(text)))


class ColumnScorer:
    """A scorer that is a column expression of the text: no Python on the executors."""

    def __init__(self, name: str, expression: Callable[[Column], Column], metadata: dict | None = None):
        self.name, self.expression, self.metadata = name, expression, dict(metadata or {})

    def score(self, rows: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        return rows.withColumn(out, self.expression(F.col(text)))


def characters_per_word() -> ColumnScorer:
    """Characters of the text over its words; null without words."""
    return ColumnScorer("characters-per-word", lambda t: F.try_divide(F.char_length(t).cast("double"), word_count(t).cast("double")))


def fast_discrepancy() -> Detector:
    return Detector("token-discrepancy", lambda: None, needs=("torch", "transformers"))


def cross_perplexity() -> Detector:
    return Detector("perplexity-ratio", lambda: None, needs=("torch", "transformers"))


#: Scorers by name.
SCORERS = {"characters-per-word": characters_per_word, "token-discrepancy": fast_discrepancy, "perplexity-ratio": cross_perplexity}


def vector_logits(vectors: DataFrame, steps: int = 8, kinds: int = 8) -> DataFrame:
    """(id, logits array<array<double>>, other array<array<double>>, tokens array<int>): each vector
    read as ``steps`` rows of ``kinds`` logits; the other model's rows are the same in reverse."""
    row = lambda k: F.transform(F.slice("embedding", k * kinds + 1, F.lit(kinds)), lambda x: x.cast("double"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), row)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.pmod(F.coalesce("label", F.lit(0)) + k, F.lit(kinds)).cast("int"))
    return vectors.filter(F.size("embedding") == steps * kinds).select(F.col("vec_id").alias("id"), rows.alias("logits"), F.reverse(rows).alias("other"), tokens.alias("tokens"))


def log_softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - m))
    return F.transform(logits, lambda x: x - m - F.log(total))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def token_discrepancy(rows: DataFrame) -> DataFrame:
    """(id, score): summed log-likelihood of the tokens less its expectation under the model, over
    the root of the summed variance; null without variance."""
    r = rows.select("id", "tokens", F.transform("logits", log_softmax).alias("lp"))
    r = r.select(
        "id", F.zip_with("lp", "tokens", lambda lp, t: F.get(lp, t)).alias("ll"), F.transform("lp", lambda lp: _sum(F.transform(lp, lambda x: F.exp(x) * x))).alias("mean"), F.transform("lp", lambda lp: _sum(F.transform(lp, lambda x: F.exp(x) * x * x))).alias("square")
    )
    variance = _sum(F.zip_with("square", "mean", lambda q, m: q - m * m))
    return r.select("id", ((_sum(F.col("ll")) - _sum(F.col("mean"))) / F.nullif(F.sqrt(variance), F.lit(0.0))).alias("score"))


def perplexity_ratio(rows: DataFrame) -> DataFrame:
    """(id, score): minus the log-perplexity of the tokens over the cross-perplexity of both models."""
    r = rows.select("id", "tokens", F.transform("logits", log_softmax).alias("lp"), F.transform("other", log_softmax).alias("lo"))
    own = _sum(F.zip_with("lp", "tokens", lambda lp, t: F.get(lp, t)))
    cross = _sum(F.transform(F.arrays_zip("lp", "lo"), lambda z: _sum(F.zip_with(z["lp"], z["lo"], lambda a, b: F.exp(b) * a))))
    return r.select("id", (-own / F.nullif(cross, F.lit(0.0))).alias("score"))


_LONG = """WITH e AS (SELECT vec_id AS id, label, embedding, unnest(range(8)) AS k FROM embeddings WHERE len(embedding) = 64),
l AS (SELECT id, label, k, unnest(range(8)) AS j, unnest(embedding[k * 8 + 1 : k * 8 + 8])::DOUBLE AS x FROM e),
p AS (SELECT id, label, k, j, x - ln(sum(exp(x)) OVER (PARTITION BY id, k)) AS lp FROM l)"""
DISCREPANCY_SQL = f"""{_LONG}, t AS (SELECT id, k, sum(lp) FILTER (j = (label + k) % 8) AS ll, sum(exp(lp) * lp) AS m, sum(exp(lp) * lp * lp) AS q FROM p GROUP BY id, k)
SELECT id, (sum(ll) - sum(m)) / sqrt(sum(q - m * m)) AS score FROM t GROUP BY id"""
RATIO_SQL = f"""{_LONG}, o AS (SELECT a.id, a.k, a.j, a.label, a.lp, b.lp AS lo FROM p a JOIN p b ON a.id = b.id AND b.k = 7 - a.k AND a.j = b.j)
SELECT id, -sum(lp) FILTER (j = (label + k) % 8) / sum(exp(lo) * lp) AS score FROM o GROUP BY id"""
