"""Column selection shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.plans.shared import materialize

#: Rows an Arrow batch may hold: texts can be very long, so batches are kept short.
BATCH_ROWS = 1000


def utf8(text_col: str = "text") -> Column:
    """UTF-8 of the whole text, null read as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def raw_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, raw binary): UTF-8 of whole texts, null read as empty. Other columns are left
    behind, so extra columns of any name can't clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        utf8(text_col).alias("raw"),
    )


def short_batches(spark) -> None:
    """Bound the memory of a Python worker: batches end at a row count as well as at bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_hash(column: str, modulus: int):
    """crc32 of the identifier's decimal text, modulo ``modulus`` (null for a null identifier)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


#: Rows of a few numbers that may go to every executor: tens of megabytes.
BROADCAST_ROWS = 1 << 20


def narrow(keys: DataFrame, label: str) -> DataFrame:
    """``keys`` (a few numbers a row), written and counted: sent to every executor if there are at most
    ``BROADCAST_ROWS`` of them, so that the texts they are joined to stay where they are, and joined by a
    shuffle if there are more."""
    keys = materialize(keys, label)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
