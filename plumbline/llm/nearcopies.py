"""Near copies by SimHash candidates and exact similarity of word shingles.

A text is the set of its shingles of five words. Texts with one set are one node. Nodes are compared
as in :mod:`plumbline.llm.simhash`: every pair of fingerprints meets in a tile, by exclusive-or and bit
counts. The radius is wide enough for the similarity asked for (``RADIUS`` bits hold 99.97 % of pairs at
a similarity of exactly 0.8), so it also lets pairs through that are alike by chance; a sketch of each
set, a byte for the least hash in each of ``BINS`` bins, rules those out in the tile. This first pass
says which nodes may have a link at all: few of most corpora. The second pass compares those alone, in
the same tiles, and decides by the two whole sets. A pair whose ends are linked already is passed over,
so a group of copies is never weighed, nor sent on, as all its pairs; the links that a task finds leave it
as a spanning forest. What stands doesn't depend on the order in which rows come.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import simhash
from plumbline.llm.common import narrow, short_batches, utf8
from plumbline.llm.components import smallest_reachable
from plumbline.plans.shared import materialize

WORDS, SIMILARITY, RADIUS = 5, 0.8, 20
BINS = 128
#: How far a sketch may fall short of the similarity (about 3.5 standard deviations).
_SHORT = 0.12
#: Bytes of sets in a group of the second pass (about): two groups are a task's memory.
_GROUP_BYTES = 24 << 20
#: Logarithm of the size ratio of neighbouring size classes.
_CLASS = math.log(1.05)


def shingle_set(raw: bytes, words_each: int = WORDS, seed: int = simhash.SEED) -> np.ndarray:
    """The distinct shingles of a whole UTF-8 text as sorted hashes; fewer words than a shingle form one, a
    text without words has none."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    first, last = (ends - lengths + 1)[: len(words) - words_each + 1].tolist(), ends[words_each - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first)))


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set: a bit is the majority of its members'."""
    octets = shingles.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.concatenate([np.bincount(octets[:, k], minlength=256) @ simhash._BITS for k in range(8)])
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view("<u8")[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A byte for each bin of the hash space: of the least member there, zero for none."""
    mixed = (shingles ^ (shingles >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    key = np.sort((mixed % np.uint64(BINS)) << np.uint64(56) | mixed >> np.uint64(8))
    bins = (key >> np.uint64(56)).astype(np.int64)
    at = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[at]] = (key[at] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sketches, row by row: the share of bins that are alike among those either has."""
    either = np.count_nonzero(a | b, axis=1)
    return np.count_nonzero((a == b) & (a > 0), axis=1) / np.maximum(either, 1)


def _node(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _described(batches):
    """(doc_id, same, node, fp, many, sketch) of (doc_id, raw, same)."""
    for batch in batches:
        sets = [shingle_set(v.as_py()) for v in batch.column(1)]
        columns = [
            batch.column(0), batch.column(2), pa.array(map(_node, sets), pa.binary()), pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)),
            pa.array(map(len, sets), pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "same", "node", "fp", "many", "sketch"])


_DESCRIBED = "doc_id long, same long, node binary, fp long, many long, sketch binary"


def _tiles(fp: np.ndarray, many: np.ndarray):
    """Order by set size, and the tiles: (from, to, least and most members, least and most bits set)."""
    order = np.argsort(many, kind="stable")
    bits, many = np.bitwise_count(fp[order]).astype(np.int64), many[order]
    starts = np.arange(0, len(fp), simhash.TILE)
    ends = np.minimum(starts + simhash.TILE, len(fp))
    return order, np.stack([starts, ends, many[starts], many[ends - 1], np.minimum.reduceat(bits, starts), np.maximum.reduceat(bits, starts)], axis=1)


def candidates(fp: np.ndarray, many: np.ndarray, sketches: np.ndarray, own: int, radius: int, similarity: float, wanted):
    """Index pairs (u, v), strip by strip, that may be as similar as that: among all rows (``own`` 0), or
    between the first ``own`` and the rest. Tile pairs whose bit counts differ by more than the radius are
    skipped, and those whose sets differ too much in size. ``wanted(u, v)`` says which pairs are still
    worth a look, before their sketches are compared."""
    left, right = (slice(None), slice(None)) if not own else (slice(own), slice(own, None))
    order_a, box_a = _tiles(fp[left], many[left])
    order_b, box_b = (order_a, box_a) if not own else _tiles(fp[right], many[right])
    sa, sb = fp[left][order_a], fp[right][order_b]
    wide, count = np.empty(simhash._ROWS * simhash._COLUMNS, np.uint64), np.empty(simhash._ROWS * simhash._COLUMNS, np.uint8)
    for k, (i, j, fewest, most, low, high) in enumerate(box_a):
        near = (box_b[:, 3] >= similarity * fewest) & (most >= similarity * box_b[:, 2])
        near &= np.maximum(box_b[:, 4] - high, low - box_b[:, 5]) <= radius
        if not own:
            near[:k] = False
        for s, t in simhash._runs(box_b[near, :2]):
            for top in range(i, j, simhash._ROWS):
                rows = sa[top : min(top + simhash._ROWS, j), None]
                size = len(rows) * (t - s)
                x, c = wide[:size].reshape(len(rows), t - s), count[:size]
                np.bitwise_count(np.bitwise_xor(rows, sb[None, s:t], out=x).reshape(-1), out=c)
                hit = np.flatnonzero(c <= radius)
                if not len(hit):
                    continue
                u, v = np.divmod(hit, t - s)
                if not own:
                    keep = u + top < v + s
                    u, v = u[keep], v[keep]
                u, v = order_a[u + top], order_b[v + s] + own
                keep = (np.minimum(many[u], many[v]) >= similarity * np.maximum(many[u], many[v])) & wanted(u, v)
                u, v = u[keep], v[keep]
                if len(u):
                    keep = estimate(sketches[u], sketches[v]) >= similarity - _SHORT
                    if keep.any():
                        yield u[keep], v[keep]


def candidate_nodes(fp, many, sketches, own: int, radius: int, similarity: float) -> np.ndarray:
    """Which rows have a candidate."""
    has = np.zeros(len(fp), bool)
    for u, v in candidates(fp, many, sketches, own, radius, similarity, lambda u, v: ~(has[u] & has[v])):
        has[u] = has[v] = True
    return has


def similar(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted members, are as similar as that."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both)


def exact_forest(fp, many, sketches, members: list[np.ndarray], own: int, radius: int, similarity: float) -> np.ndarray:
    """Root of each row under links that the whole sets bear out."""
    forest = simhash.Forest(len(fp))
    for u, v in candidates(fp, many, sketches, own, radius, similarity, lambda u, v: forest.root[u] != forest.root[v]):
        while len(u):
            ru, rv = forest.root[u], forest.root[v]
            apart = ru != rv
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            # One pair of each two groups is decided at a time: if it stands, their others needn't be.
            _, pick = np.unique(np.minimum(ru, rv) * len(fp) + np.maximum(ru, rv), return_index=True)
            stands = np.array([similar(members[a], members[b], similarity) for a, b in zip(u[pick].tolist(), v[pick].tolist())], bool)
            if stands.any():
                forest.add(u[pick][stands], v[pick][stands])
            u, v = np.delete(u, pick), np.delete(v, pick)
    return forest.root


def cells(nodes: DataFrame, similarity: float, group_rows: int, lists: dict[str, str]) -> DataFrame:
    """Pairs of groups as :func:`plumbline.llm.simhash.cells` has them, but by set size: sets of which one
    is smaller than ``similarity`` times the other can't be that similar and never meet."""
    marked = nodes.withColumn("class", F.floor(F.log(F.col("many").cast("double")) / F.lit(_CLASS)).cast("int"))
    # A class for each 5 % of size: a few hundred rows, whatever the input.
    counts = {r["class"]: r["count"] for r in marked.groupBy("class").count().collect()}
    most = min(group_rows, max(1, math.ceil(sum(counts.values()) / simhash.MIN_GROUPS)))
    of, bands, held = {}, [], 0
    for c in sorted(counts):
        if not bands or held + counts[c] > most:
            bands.append([c, c, max(1, math.ceil(counts[c] / most))])
            held = 0
        held += counts[c]
        bands[-1][1] = c
        of[c,] = len(bands) - 1
    first = [0, *np.cumsum([b[2] for b in bands]).tolist()]
    # Classes are closed by one more at both ends, for logarithms that round.
    apart = lambda a, b: (b[0] - 1) * _CLASS + math.log(similarity) > (a[1] + 2) * _CLASS
    near = [(i, first[j], first[j + 1] - 1) for i, a in enumerate(bands) for j, b in enumerate(bands) if not apart(a, b) and not apart(b, a)]
    return simhash.deal(marked, ["class"], of, first, [b[2] for b in bands], near, lists)


_LISTS = {"fps": "fp", "manys": "many", "sketches": "sketch", "nodes": "node"}


def _read(table: pa.Table, lists):
    """(rows of both groups by list, how many the first has or 0 if the cell is one group's own), or None
    where the other group is empty."""
    rows = table.sort_by("g")
    same = rows.column("ci")[0].as_py() == rows.column("cj")[0].as_py()
    if not same and rows.num_rows < 2:
        return None
    parts = {c: [rows.column(c)[k].values for k in range(rows.num_rows)] for c in lists}
    joined = {c: pa.concat_arrays(v) for c, v in parts.items()}
    return joined, 0 if same else len(parts["fps"][0])


def _numbers(got):
    sketches = np.frombuffer(b"".join(got["sketches"].to_pylist()), np.uint8).reshape(-1, BINS)
    return got["fps"].to_numpy().view(np.uint64), got["manys"].to_numpy(), sketches


def _find(radius: int, similarity: float):
    def run(table: pa.Table) -> pa.Table:
        read = _read(table, _LISTS)
        if read is None:
            return pa.table({"node": pa.array([], pa.binary())})
        got, own = read
        return pa.table({"node": got["nodes"].filter(pa.array(candidate_nodes(*_numbers(got), own, radius, similarity)))})

    return run


def _decide(radius: int, similarity: float):
    def run(table: pa.Table) -> pa.Table:
        read = _read(table, [*_LISTS, "sets"])
        if read is None:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        got, own = read
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in got["sets"]]
        root = exact_forest(*_numbers(got), members, own, radius, similarity)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": got["nodes"].take(pa.array(moved)), "b": got["nodes"].take(pa.array(root[moved]))})

    return run


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(v.as_py()) for v in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, group_rows: int = 2 * simhash.GROUP_ROWS) -> DataFrame:
    """(doc_id, same, component_id) of every row of ``docs``: same is a hash of the text, component_id the
    smallest doc_id that links of at least ``similarity`` reach; null where no row of the group has one.
    Texts without words are alike. Repeated rows come back repeated."""
    short_batches(docs.sparkSession)
    raws = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw")).withColumn("same", F.xxhash64("raw"))
    rows = materialize(raws.mapInArrow(_described, _DESCRIBED), "near-rows")
    first = lambda c: F.any_value(c).alias(c)
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))["same"].alias("same"), first("fp"), first("many"), first("sketch")), "near-nodes")
    found = cells(nodes.filter("many > 0"), similarity, group_rows, _LISTS).groupBy("ci", "cj").applyInArrow(_find(radius, similarity), "node binary")
    involved = materialize(nodes.join(found.distinct(), "node", "left_semi"), "near-involved")
    asked = narrow(involved.select("rep", F.col("same").alias("its")).distinct(), "near-asked")
    # A node's set is made from one row's text, found by identifier and text, so that copies don't meet;
    # rows without an identifier lose their copies before they are dealt.
    named, nameless = raws.filter("doc_id IS NOT NULL"), raws.filter("doc_id IS NULL").dropDuplicates(["same"])
    chosen = named.unionByName(nameless).join(asked, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("same") == F.col("its")), "left_semi")
    # Repeated rows of one identifier and text come out as one set.
    sets = chosen.select("raw").mapInArrow(_sets, "node binary, members binary").groupBy("node").agg(F.any_value("members").alias("members"))
    sets = materialize(involved.join(sets, "node"), "near-sets")
    size = sets.agg(F.sum("many").alias("members"), F.count("*").alias("n")).first()
    fits = max(256, _GROUP_BYTES // max(1, 8 * (size.members or 0) // max(1, size.n)))
    links = cells(sets, similarity, min(group_rows, fits), {**_LISTS, "sets": "members"}).groupBy("ci", "cj").applyInArrow(_decide(radius, similarity), "a binary, b binary")
    roots = smallest_reachable(links)
    placed = nodes.join(roots, nodes.node == roots.a, "left").select("node", "rep", F.coalesce("b", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "same", "node").join(placed.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "same", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of texts that links of at least ``similarity`` join: the one with the
    smallest identifier. What counts as its row is as in :func:`plumbline.llm.simhash.drop_near_duplicates`."""
    return simhash.without_copies(docs, similar_groups(docs, id_col, text_col, similarity), id_col, text_col)
