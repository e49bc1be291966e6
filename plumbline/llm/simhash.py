"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile against tile.

Fingerprints are made once per text in Arrow batches. Distinct fingerprints are gathered into groups
of bounded size by the bit counts of their two halves; a pair of groups is one task, unless the
counts of all of one differ from all of the other's by more than the radius: those hold no link and
never meet. Within a task both sides are sorted by the same counts and cut into tiles, pairs of
tiles beyond the radius are skipped likewise, and the others are compared whole by numpy's
exclusive-or and bit counts. A task returns a spanning forest of its links, so a group of copies
never leaves as all its pairs, and no link between components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import narrow, raw_texts, short_batches, utf8
from plumbline.llm.components import smallest_reachable
from plumbline.plans.shared import materialize

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints in a group at most (about): two groups are a task's whole memory.
GROUP_ROWS = 1 << 17
MIN_GROUPS = 8
TILE = 256
_ROWS, _COLUMNS = 16, 4096
_CHUNK = 1 << 15
_GONE_ID, _GONE_TEXT = "_plumbline_gone_id", "_plumbline_gone_text"
#: The bits of each byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a whole UTF-8 text. A-Z are lower-cased, words end at ASCII white space; fewer
    words than a shingle form one; a text without words has fingerprint zero."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    total, shingles = np.zeros(64, np.int64), n - words_each + 1
    for at in range(0, shingles, _CHUNK):
        to = min(at + _CHUNK, shingles)
        first, last = starts[at:to].tolist(), ends[at + words_each - 1 : to + words_each - 1].tolist()
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], dtype="<u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            total[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    bits = np.packbits(2 * total > shingles, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        fp = np.fromiter((fingerprint(x) for x in (v.as_py() for v in batch.column(1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "same"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long, same long): a row for each row of ``docs``, fp the signed view of the
    64 bits, same a hash of the text that tells apart rows with one identifier."""
    short_batches(docs.sparkSession)
    raws = raw_texts(docs, id_col, text_col).withColumn("same", F.xxhash64("raw"))
    return raws.mapInArrow(_fingerprints, "doc_id long, fp long, same long")


class Forest:
    """Components of a bounded set of nodes; links come in arrays and are forgotten at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        while True:
            ru, rv = root[u], root[v]
            apart = ru != rv
            if not apart.any():
                break
            u, v = u[apart], v[apart]
            np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
        self.root = root


def _tiles(fp: np.ndarray):
    """Order by the bit counts of both halves, and the tiles: (from, to, low, high least, high most)."""
    low = np.bitwise_count(fp & np.uint64(0xFFFFFFFF)).astype(np.int64)
    high = np.bitwise_count(fp >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    cuts = np.flatnonzero(np.diff(low, prepend=-1))
    spans = [(a, min(a + TILE, b)) for s, b in zip(cuts, [*cuts[1:], len(fp)]) for a in range(s, b, TILE)]
    box = np.array([(a, b, low[a], high[a], high[b - 1]) for a, b in spans], np.int64).reshape(-1, 5)
    return order, box


def link_forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Root of each of the fingerprints a, then b, under links of at most ``radius`` bits (within a
    alone if b is None). Exact: each pair is compared unless its tiles' bit counts rule it out."""
    own = b is None
    order_a, box_a = _tiles(a)
    order_b, box_b = (order_a, box_a) if own else _tiles(b)
    sa, sb = a[order_a], (a if own else b)[order_b]
    forest = Forest(len(a) + (0 if own else len(b)))
    shift = 0 if own else len(a)
    found_u, found_v, held = [], [], 0
    wide, count = np.empty(_ROWS * _COLUMNS, np.uint64), np.empty(_ROWS * _COLUMNS, np.uint8)
    for k, (i, j, low, least, most) in enumerate(box_a):
        near = np.abs(box_b[:, 2] - low) + np.maximum(0, np.maximum(box_b[:, 3] - most, least - box_b[:, 4])) <= radius
        if own:
            near[:k] = False
        for s, t in _runs(box_b[near, :2]):
            for top in range(i, j, _ROWS):
                left = sa[top : min(top + _ROWS, j), None]
                size = len(left) * (t - s)
                x, c = wide[:size].reshape(len(left), t - s), count[:size]
                np.bitwise_count(np.bitwise_xor(left, sb[None, s:t], out=x).reshape(-1), out=c)
                if c.min() > radius:
                    continue
                u, v = np.divmod(np.flatnonzero(c <= radius), t - s)
                if own:
                    keep = u + top < v + s
                    u, v = u[keep], v[keep]
                if len(u):
                    found_u.append(order_a[u + top])
                    found_v.append(order_b[v + s] + shift)
                    held += len(u)
        if held > 1 << 20:
            forest.add(np.concatenate(found_u), np.concatenate(found_v))
            found_u, found_v, held = [], [], 0
    if held:
        forest.add(np.concatenate(found_u), np.concatenate(found_v))
    return forest.root


def _runs(spans: np.ndarray):
    """Adjacent tiles joined, then cut so that a strip of comparisons stays in cache."""
    if not len(spans):
        return
    cut = np.flatnonzero(spans[1:, 0] != spans[:-1, 1]) + 1
    for s, e in zip(spans[np.concatenate(([0], cut)), 0], spans[np.concatenate((cut - 1, [len(spans) - 1])), 1]):
        for x in range(s, e, _COLUMNS):
            yield x, min(x + _COLUMNS, e)


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [table.column("fps")[k].values.to_numpy() for k in np.argsort(table.column("g").to_numpy())]
        fps = [np.ascontiguousarray(fp).view(np.uint64) for fp in parts]
        own = table.column("ci")[0].as_py() == table.column("cj")[0].as_py()
        if not own and len(fps) < 2:
            root = np.arange(len(fps[0]))
        else:
            root = link_forest(fps[0], None if own else fps[1], radius)
        both = np.concatenate(parts)
        moved = root != np.arange(len(root))
        return pa.table({"a": both[moved], "b": both[root[moved]]})

    return run


def _bands(counts: dict[tuple[int, int], int], most: int):
    """Classes of fingerprints (bit counts of the low and the high half) gathered in order into bands
    of about ``most``; a class that is larger is a band of several groups. Returns the band of each
    class and, for each band, (low least, low most, high least, high most, groups)."""
    of, bands, held = {}, [], 0
    for low, high in sorted(counts):
        n = counts[low, high]
        if not bands or held + n > most:
            bands.append([low, low, high, high, max(1, math.ceil(n / most))])
            held = 0
        held += n
        box = bands[-1]
        box[1], box[2], box[3] = low, min(box[2], high), max(box[3], high)
        of[low, high] = len(bands) - 1
    return of, bands


def _near(bands, radius: int):
    """(band, first group, last group) of every band that may hold a link to it, itself included."""
    first = [0, *np.cumsum([x[4] for x in bands]).tolist()]
    gap = lambda a, b, k: max(0, a[k] - b[k + 1], b[k] - a[k + 1])
    return first, [(i, first[j], first[j + 1] - 1) for i, a in enumerate(bands) for j, b in enumerate(bands) if gap(a, b, 0) + gap(a, b, 2) <= radius]


def cells(distinct: DataFrame, radius: int, group_rows: int, lists: dict[str, str]) -> DataFrame:
    """Pairs of groups that may hold a link, a row for each side: (ci, cj, g and a list for each entry of
    ``lists``, of the column it names). ``distinct`` has a column fp and is a written table."""
    low, high = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("fp", 32))
    marked = distinct.withColumns({"low": low.cast("int"), "high": high.cast("int")})
    # At most 33 x 33 rows, whatever the input.
    counts = {(r.low, r.high): r["count"] for r in marked.groupBy("low", "high").count().collect()}
    of, bands = _bands(counts, min(group_rows, max(1, math.ceil(sum(counts.values()) / MIN_GROUPS))))
    first, near = _near(bands, radius)
    return deal(marked, ["low", "high"], of, first, [x[4] for x in bands], near, lists)


def deal(marked: DataFrame, keys: list[str], of: dict[tuple, int], first: list[int], groups: list[int], near: list[tuple[int, int, int]], lists: dict[str, str]) -> DataFrame:
    """Rows gathered into groups, and groups into pairs: ``of`` has the band of each class (the values of
    ``keys``), ``first`` and ``groups`` the first group of each band and how many it has, ``near`` the
    groups (band, from, to) that a band meets. All of these are bounded by the number of classes."""
    spark = marked.sparkSession
    named = ", ".join(f"{k} int" for k in keys)
    classes = spark.createDataFrame([(*c, b, int(first[b]), groups[b]) for c, b in of.items()], f"{named}, band int, first long, groups long")
    near = spark.createDataFrame([(b, int(i), int(j)) for b, i, j in near], "band int, from long, to long")
    spread = F.pmod(F.xxhash64("fp", *(c for c in lists.values() if c == "node")), F.col("groups"))
    dealt = marked.join(F.broadcast(classes), keys).groupBy("band", (F.col("first") + spread).alias("g")).agg(*(F.collect_list(c).alias(name) for name, c in lists.items()))
    return dealt.join(F.broadcast(near), "band").withColumn("other", F.explode(F.sequence("from", "to"))).select(
        F.least("g", "other").alias("ci"), F.greatest("g", "other").alias("cj"), "g", *lists
    )


def components(fps: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(fp, component_id) for each distinct fp of ``fps`` (doc_id, fp): the smallest doc_id that
    links of at most ``radius`` bits reach. Fingerprints that only rows without a doc_id have, and link to
    no other, have none."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    links = cells(distinct, radius, group_rows, {"fps": "fp"}).groupBy("ci", "cj").applyInArrow(_compare(radius), "a long, b long")
    # Links join fingerprints: an identifier that several texts have would join what isn't alike.
    roots = smallest_reachable(links)
    placed = distinct.join(roots, distinct.fp == roots.a, "left").select("fp", "rep", F.coalesce("b", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return materialize(placed.join(smallest, "root").select("fp", "component_id"), "simhash-components")


def _linked(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(doc_id, fp, same, component_id) of every row."""
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    return fps.join(components(fps, radius), "fp", "left")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Empty and null texts have fingerprint 0 and link like any other. Repeated rows come back
    repeated. A row with a null doc_id comes back with its fingerprint and the component of equal
    or linked fingerprints that have an identifier, null if there is none. An empty table gives
    an empty table.
    """
    return _linked(docs, id_col, text_col, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each group of near copies: the one with the smallest identifier.

    A row goes if its own text is a near copy of a document with a smaller identifier, whatever
    other rows have its identifier. Rows without an identifier go if their group has a document
    with one and stay if it has none. Rows of a group that all have its smallest identifier
    are one document and stay together."""
    return without_copies(docs, _linked(docs, id_col, text_col, radius), id_col, text_col)


def without_copies(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose (doc_id, same) has a component_id that isn't the doc_id."""
    gone = marked.filter("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias(_GONE_ID), F.col("same").alias(_GONE_TEXT)).distinct()
    here = F.col(id_col).cast("long").eqNullSafe(F.col(_GONE_ID)) & (F.xxhash64(utf8(text_col)) == F.col(_GONE_TEXT))
    return docs.join(narrow(gone, "simhash-gone"), here, "left_anti")
