"""Connected components by alternating large and small stars, entirely on shared tables.

Neither links nor components visit the driver: each round writes its links to the shared folder
and only a row count and a checksum come back. A hub's links meet no grouped task: the minima are
aggregated map-side, written, and joined back from a table, which lets adaptive execution split
a hub's rows among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.shared import drop_table, read_table, write_table


def _step(links: DataFrame, small: bool) -> DataFrame:
    """One star operation over links (a, b) with a > b."""
    spark = links.sparkSession
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    path = write_table(least, "cc-min")
    joined = both.join(read_table(spark, path, least.schema), "a")
    if small:
        out = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(read_table(spark, path, least.schema).select("a", F.col("m").alias("b")))
    else:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = out.distinct()
    done = write_table(out, "cc-links")
    drop_table(spark, path)
    return done, out.schema


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): for every node a that reaches a smaller one, the smallest b it reaches.

    ``links`` has columns a and b of one ordered type, in any order; repeats, self links and nulls count for
    nothing. Raises if it hasn't settled after ``rounds`` (links of n nodes settle in about
    log(n) squared rounds, in practice under ten).
    """
    spark = links.sparkSession
    start = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    path, schema, before = write_table(start, "cc-links"), start.schema, None
    for _ in range(rounds):
        now = read_table(spark, path, schema)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now
        before = mark
        wide, schema = _step(now, small=False)
        drop_table(spark, path)
        path, schema = _step(read_table(spark, wide, schema), small=True)
        drop_table(spark, wide)
    raise RuntimeError(f"components had not settled after {rounds} rounds")
