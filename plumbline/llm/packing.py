"""Best-fit packing of whole documents into sequences of bounded length.

Documents are tokenized once and cut only where they exceed a sequence. Pieces are range-sorted
by length on the cluster. Lengths are whole numbers no larger than the capacity, so the sorted
pieces and the sorted gaps are both at most ``capacity`` runs of equal values, whatever the input;
the supersteps of best fit (each run of pieces, longest first, sweeps to its successor, the
smallest gap that holds it; a piece's rank in its run decides which gap of that run it gets; gaps
shrink; repeat) therefore pass over runs, exactly as they would over the rows. What they return is
a table of runs of ranks, again bounded by the capacity, with which every piece finds its place
in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import raw_texts, short_batches
from plumbline.llm.wordids import loaded
from plumbline.plans.shared import materialize

CAPACITY = 1024
END_ID = 2


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one of what is over."""
    if length <= capacity:
        return [(0, length)]
    over = length % capacity
    return ([(0, over)] if over else []) + [(s, capacity) for s in range(over, length, capacity)]


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing over runs. ``counts``: pieces by length. Returns arrays (first position,
    sequence of that position, offset): positions number the pieces by ascending length, and those
    from one first position to the next go to successive sequences at the same offset."""
    lengths = sorted(counts)
    before, total = {}, 0
    for n in lengths:
        before[n] = total
        total += counts[n]
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    fresh, rows = 0, []
    for n in reversed(lengths):
        at, left = before[n], counts[n]
        size = n
        while left:
            while size < capacity and not gaps[size]:
                size += 1
            deep = size // n
            wide = -(-left // deep)
            if gaps[size]:
                lo, hi = gaps[size].pop()
                if hi - lo > wide:
                    gaps[size].append((lo + wide, hi))
                    hi = lo + wide
            else:
                lo, hi = fresh, fresh + wide
                fresh = hi
            full = min(hi - lo, left // deep)
            for lo_, hi_, layers in ((lo, lo + full, deep), (lo + full, hi, left - full * deep)):
                if hi_ == lo_ or layers <= 0:
                    continue
                for k in range(layers):
                    rows.append((at, lo_, capacity - size + k * n))
                    at += hi_ - lo_
                    left -= hi_ - lo_
                if size - layers * n:
                    gaps[size - layers * n].append((lo_, hi_))
            size = n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, row, part = loaded(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = words.encode(raw.as_py().decode("utf-8", "replace")) + end
                for k, (start, length) in enumerate(cut(len(coded) // 4, capacity)):
                    span = coded[4 * start : 4 * (start + length)]
                    for c, x in zip(out, (doc_id, k, start, length, zlib.crc32(span), (part << 40) + row, span if with_ids else None)):
                        c.append(x)
                    row += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "row", "ids"])

    return run


def _numbered(batches):
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "idx"])
        at += n


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row,
    and with ``with_ids`` the piece's ids (little-endian unsigned 32-bit). A null or empty text is
    the end id alone; repeated rows and null identifiers are packed like any other."""
    short_batches(docs.sparkSession)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, ids binary"
    pieces = raw_texts(docs, id_col, text_col).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)
    pieces = materialize(pieces.select(*keep, "row"), "pack-pieces")
    # The row number comes last, so that even equal rows can be dealt to several ranges.
    order = ["length", "doc_id", "piece", "row"]
    ranged = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    ranged = materialize(ranged.mapInArrow(_numbered, f"{fields}, part int, idx long"), "pack-ranged")
    # A row for each range and each length: bounded by the partitions and by the capacity.
    sizes = dict(ranged.groupBy("part").count().collect())
    counts = dict(ranged.groupBy("length").count().collect())
    base, total = {}, 0
    for part in sorted(sizes):
        base[part] = total
        total += sizes[part]
    first, sequence, offset = best_fit_runs(counts, capacity)
    names = [*keep, "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            t = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            start = np.array([base[p] for p in t["part"].to_pylist()], np.int64)
            at = start + t["idx"].to_numpy()
            run = np.searchsorted(first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(t[k] for k in keep), pa.array(sequence[run] + at - first[run]), pa.array(offset[run])], names)

    return ranged.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids array<long>) of the packed sequences, from rows that carry ids."""

    def run(batches):
        for batch in batches:
            joined = [np.frombuffer(b"".join(x["ids"] for x in sorted(v.as_py(), key=lambda x: x["offset"])), "<u4").astype(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in joined], pa.int64()), pa.array(joined, pa.list_(pa.int64()))], ["sequence_id", "length", "ids"])

    # A group is one sequence: at most ``capacity`` ids.
    grouped = placed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("pieces"))
    return grouped.mapInArrow(run, "sequence_id long, length long, ids array<long>")
