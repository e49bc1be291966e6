"""Drift monitors and registries on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.drift import CUSUM_H, CUSUM_K, PH_DELTA, PH_LAMBDA
from plumbline.sources.tables import Refusal

OUT = "series string, t int, page_hinkley double, ph_alarm boolean, cusum double, cusum_alarm boolean, out_of_order boolean"


class CumulativeMonitors(StatefulProcessor):
    """Page-Hinkley and CUSUM of each series, with state (n, sum, m, lowest m, S, last t).

    Intervals of one micro-batch are taken in order of t; one that is older than what the state has
    seen can't be placed any more and comes back flagged, without a statistic."""

    def __init__(self, delta=PH_DELTA, lam=PH_LAMBDA, k=CUSUM_K, h=CUSUM_H):
        self.delta, self.lam, self.k, self.h = delta, lam, k, h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "n long, total double, m double, low double, s double, last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, m, low, s, last = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0, -(1 << 31))
        out = []
        for r in pd.concat(list(rows)).sort_values("t").itertuples():
            if r.t <= last:
                out.append((key[0], int(r.t), None, None, None, None, True))
                continue
            n, total, last = n + 1, total + r.x, int(r.t)
            m += r.x - total / n - self.delta
            low = min(low, m)
            s = max(0.0, s + r.x - r.centre - self.k)
            out.append((key[0], last, m - low, m - low > self.lam, s, s > self.h, False))
        self.state.update((n, total, m, low, s, last))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_monitors(observed: DataFrame, centre: DataFrame, direction: str = "down", **limits) -> DataFrame:
    """Monitor rows of a stream of observed intervals (series, t, value), each series against its
    frozen reference mean (series, centre)."""
    spark = observed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = -F.col("value") if direction == "down" else F.col("value")
    rows = observed.withColumn("x", x).join(centre, "series").select("series", F.col("t").cast("int").alias("t"), "x", "centre")
    return rows.groupBy("series").transformWithStateInPandas(CumulativeMonitors(**limits), OUT, "append", "none")


def stream_alarms(observed: DataFrame, bounds: DataFrame, direction: str = "down") -> DataFrame:
    """(series, t, value, alarm): each interval against its series' frozen order statistic, oriented."""
    x = -F.col("value") if direction == "down" else F.col("value")
    return observed.join(bounds, "series").select("series", "t", "value", (x > F.col("bound")).alias("alarm"))


def guard_identity(spark, checkpoint: str, identity: dict) -> None:
    """Refuses to go on from a checkpoint that another instrument wrote; call before ``start``."""
    from plumbline.sources.receipts import canonical_json, put_text, read_text

    path, text = f"{checkpoint}/identity.json", canonical_json(identity)
    old = read_text(spark, path)
    if old is None:
        put_text(spark, path, text)
    elif old != text:
        raise Refusal("the checkpoint was written by another instrument")


def append_new(path: str):
    """A ``foreachBatch`` sink that appends rows whose id isn't there yet: replays add nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        from plumbline.sources.receipts import append_scored

        append_scored(path, batch.dropDuplicates(["id"]))

    return sink


class Reservoir:
    """A uniform sample of a stream, n of each cell, in one pass: of what it has and what comes, the rows
    that sort first by key stay. The state is a table of at most n rows a cell, one version for each
    micro-batch; a replayed batch starts from the version before it, so nothing counts twice."""

    def __init__(self, path: str, by: list[str], n: int, id_col: str = "id"):
        self.path, self.by, self.n, self.id_col = path.rstrip("/"), by, n, id_col

    def _versions(self, spark) -> list[int]:
        from plumbline.sources.receipts import _fs

        at, fs = _fs(spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x[6:]) for x in names if x.startswith("epoch=") and fs.exists(_fs(spark, f"{self.path}/{x}/_SUCCESS")[0]))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from plumbline.operators.sampling import first_of_each

        spark = batch.sparkSession
        before = [v for v in self._versions(spark) if v < epoch]
        rows = batch.dropDuplicates([*self.by, self.id_col])
        if before:
            held = spark.read.schema(batch.schema).parquet(f"{self.path}/epoch={before[-1]}")
            rows = held.unionByName(rows.join(held, [*self.by, self.id_col], "left_anti"))
        first_of_each(rows, self.by, self.n, self.id_col).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self, spark, schema) -> DataFrame:
        """The sample as it is now."""
        versions = self._versions(spark)
        return spark.read.schema(schema).parquet(f"{self.path}/epoch={versions[-1]}") if versions else spark.createDataFrame([], schema)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, to Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
