"""Language-model scores from a weighted backoff automaton over runs of three words.

A state is a context: the two words before, the one before, or none (the root). Its arcs are the
words seen after it in training; its failure arc leads to the context that is a word shorter, with
the weight left over (Dirichlet smoothing: a context's counts plus ``PRIORS`` counts of the shorter
context, so the probabilities of every state sum to one). Reading a word takes an arc of the state
or fails to a shorter one until there is an arc; a text's score accumulates along one left-to-right
traversal that carries the state.

No machine holds the whole automaton. Texts are tokenized once into blocks of a bounded number of
tokens. First the blocks' distinct words go to buckets of the hash range, which count them over the
corpus, number them (frequent words low) and answer: words are compared as bytes, so numbers stand
for words exactly. Then the distinct pairs and triples of a block go, as numbers, to buckets that
sum them over the corpus and answer in the order in which they were asked. A block then builds just
the part of the automaton that its texts can reach. Every count covers all training documents: there
is no pruning, no cap and no hashed count. A key reaches its bucket once a block however often
it occurs, so a hot word or pair is as many entries as there are blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import id_hash, raw_texts, short_batches
from plumbline.plans.shared import materialize

#: Tokens in a block (a longer text is a block of its own) and blocks' keys in a bucket.
BLOCK_TOKENS = 1 << 19
BLOCKS_PER_BUCKET = 4
MIN_BUCKETS = 64
#: Weight of the shorter context in each state, in tokens: contexts of one word, of two words (of those
#: tried, the best for held-out documents of the test tables).
PRIORS = (4000.0, 8.0)
#: Words that are read one after another from one place of a text.
STRIDE = 256
END, BEGIN = 0, 1
_ODD_A, _ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def planes(values: np.ndarray) -> bytes:
    """The bytes of the values, plane by plane: high planes of small numbers are zeros and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers, with their lengths, compressed."""
    sizes = np.array([len(a) for a in arrays], "<u8").tobytes()
    return zstandard.compress(sizes + b"".join(planes(np.ascontiguousarray(a, np.uint32)) for a in arrays), 1)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    out, at = [], 8 * n
    for size in np.frombuffer(raw, "<u8", n).tolist():
        out.append(unplanes(raw[at : at + 4 * size], np.uint32))
        at += 4 * size
    return out


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Block:
    """Texts being gathered."""

    def __init__(self):
        self.ids, self.docs, self.held, self.lengths, self.tokens, self.size = _Ids({b"": 0}), [], [], [], [], 0

    def add(self, doc_id, held, raw):
        words = raw.lower().split()
        words.append(b"")
        self.tokens.append(np.fromiter(map(self.ids.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(words))
        self.size += len(words)

    def row(self, number):
        """Words in the order of their hashes, the end of a text (no word) first."""
        words = list(self.ids)
        order = np.argsort(_hashes(words[1:]), kind="stable") + 1
        rank = np.zeros(len(words), np.uint32)
        rank[order] = np.arange(1, len(words))
        words = zstandard.compress(b" ".join(map(words.__getitem__, order.tolist())), 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([self.docs], pa.list_(pa.int64())),
                pa.array([packed(np.array(self.held, np.uint32), np.array(self.lengths, np.uint32), rank[np.concatenate(self.tokens)])], pa.binary()),
                pa.array([words], pa.binary()),
            ],
            ["block", "doc_ids", "tokens", "words"],
        )


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _words(data: bytes) -> list[bytes]:
    joined = zstandard.decompress(data)
    return joined.split(b" ") if joined else []


def _gather(block_tokens):
    def run(batches):
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for doc_id, raw, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                block.add(doc_id, held, raw.as_py())
                if block.size >= block_tokens:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.size:
            yield block.row(number)

    return run


class Tokens:
    """A block's texts read back. Local words are numbered by hash; 0 is the end of a text."""

    def __init__(self, data: bytes):
        held, lengths, tokens = unpacked(data, 3)
        self.held, self.lengths, self.tokens = held.astype(bool), lengths.astype(np.int64), tokens.astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.learnt = np.repeat(~self.held, self.lengths)


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def _messages(rows):
    """One record batch of (bucket, block, payload)."""
    out = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "block", "payload"])


_SENT = "bucket int, block long, payload binary"


def _send_words(buckets):
    edges = _edges(buckets)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, words = batch.column(0)[k].as_py(), _words(batch.column(2)[k].as_py())
                texts = Tokens(batch.column(1)[k].as_py())
                counts = np.bincount(texts.tokens[texts.learnt], minlength=len(words) + 1)[1:]
                cut = np.concatenate(([0], np.searchsorted(_hashes(words), edges), [len(words)])).tolist()
                yield _messages([(b, block, packed(counts[i:j]) + b"|" + zstandard.compress(b" ".join(words[i:j]), 1)) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i])

    return run


def _split(payload: bytes) -> tuple[bytes, bytes]:
    """The two compressed parts of a words message."""
    at = zstandard.ZstdDecompressor().decompressobj()
    at.decompress(payload)
    rest = at.unused_data
    return payload[: len(payload) - len(rest)], rest[1:]


def _count_words(buckets):
    def run(table: pa.Table) -> pa.Table:
        """One bucket's words over the corpus: their numbers and counts for each block, and its share
        of the statistics."""
        ids, codes, counts = _Ids(), [], []
        for payload in table.column("payload"):
            numbers, words = _split(payload.as_py())
            words = _words(words)
            codes.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            counts.append(unpacked(numbers, 1)[0])
        total = np.bincount(np.concatenate(codes), np.concatenate(counts), minlength=len(ids)).astype(np.int64)
        bucket, n = table.column("bucket")[0].as_py(), len(codes)
        number = np.empty(len(ids), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(ids)) * buckets + bucket + BEGIN + 1
        if number.max() >= 1 << 32:
            raise OverflowError("more distinct words than 32-bit numbers")
        answers = [packed(number[c], total[c] & 0xFFFFFFFF, total[c] >> 32) for c in codes]
        return _answer_table(table, bucket, answers, int((total > 0).sum()), int(total.sum()))

    return run


def _answer_table(table, bucket, answers, kinds=0, seen=0):
    n = len(answers)
    return pa.table(
        {
            "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.array([-1], pa.int64())]),
            "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "payload": pa.array([*answers, b""], pa.binary()),
            "kinds": pa.array([0] * n + [kinds], pa.int64()),
            "seen": pa.array([0] * n + [seen], pa.int64()),
        }
    )


_ANSWERED = "block long, bucket int, payload binary, kinds long, seen long"


def _numbers(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, corpus counts) of a block's local words, without the end."""
    parts = [unpacked(v.as_py(), 3) for v in answers.sort_by("bucket").column("payload")]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    number, low, high = (np.concatenate(p).astype(np.int64) for p in zip(*parts))
    return number, low | high << 32


class Grams:
    """The distinct pairs and triples of a block, in the order in which buckets are asked.

    At each token: the pair of the token before (or the beginning) and itself, and the triple of that
    pair and the token after (or the end again, after the end)."""

    def __init__(self, texts: Tokens, numbers: np.ndarray, buckets: int):
        n = len(numbers) + 1
        #: Local words, then the beginning, to corpus numbers.
        self.number = np.concatenate(([END], numbers, [BEGIN])).astype(np.uint64)
        self.begin = n
        before, after = np.empty_like(texts.tokens), np.empty_like(texts.tokens)
        before[1:] = texts.tokens[:-1]
        before[texts.first] = n
        after[:-1] = texts.tokens[1:]
        after[texts.first + texts.lengths - 1] = 0
        pairs, pair_of = np.unique(before * (n + 1) + texts.tokens, return_inverse=True)
        u, v = pairs // (n + 1), pairs % (n + 1)
        key = self.number[u] << np.uint64(32) | self.number[v]
        mixed = (key ^ (key >> np.uint64(31))) * _ODD_A
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD_B
        bucket = np.searchsorted(_edges(buckets), mixed, side="right")
        order = np.lexsort((key, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.u, self.v, self.key, self.bucket, pair_of = u[order], v[order], key[order], bucket[order], place[pair_of]
        triples, triple_of = np.unique(pair_of * (n + 1) + after, return_inverse=True)
        self.pair, w = triples // (n + 1), triples % (n + 1)
        by_number = np.lexsort((self.number[w], self.pair))
        self.pair, self.w = self.pair[by_number], w[by_number]
        place = np.empty(len(by_number), np.int64)
        place[by_number] = np.arange(len(by_number))
        self.counts = np.bincount(place[triple_of[texts.learnt]], minlength=len(place))

    def messages(self, block: int):
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        many = np.bincount(self.pair, minlength=len(self.u))
        ends = np.concatenate(([0], np.cumsum(many)))
        number = self.number[self.w]
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(self.bucket)]):
            a, b = ends[i], ends[j]
            high, low = self.key[i:j] >> np.uint64(32), self.key[i:j] & np.uint64(0xFFFFFFFF)
            yield int(self.bucket[i]), block, packed(np.diff(high, prepend=np.uint64(0)), low, many[i:j], number[a:b], self.counts[a:b])

    def totals(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(corpus counts of the pairs, of the triples) from the buckets' answers."""
        parts = [unpacked(v.as_py(), 4) for v in answers.sort_by("bucket").column("payload")]
        low, high, low3, high3 = (np.concatenate(p).astype(np.int64) for p in zip(*parts))
        return low | high << 32, low3 | high3 << 32


def _send_grams(buckets):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            numbers, _ = _numbers(right)
            grams = Grams(Tokens(left.column("tokens")[0].as_py()), numbers, buckets)
            rows = list(grams.messages(left.column("block")[0].as_py()))
        return pa.Table.from_batches([_messages(rows)])

    return run


def _sum_grams(table: pa.Table) -> pa.Table:
    """One bucket: corpus counts of its pairs and triples for each block that asked."""
    parts = [unpacked(v.as_py(), 5) for v in table.column("payload")]
    pair = np.concatenate([np.cumsum(p[0].astype(np.uint64)) << np.uint64(32) | p[1].astype(np.uint64) for p in parts])
    many = np.concatenate([p[2] for p in parts]).astype(np.int64)
    _, pair_at = np.unique(pair, return_inverse=True)
    triple = np.repeat(pair_at, many) << 32 | np.concatenate([p[3] for p in parts]).astype(np.int64)
    kinds, triple_at = np.unique(triple, return_inverse=True)
    total3 = np.bincount(triple_at, np.concatenate([p[4] for p in parts]), minlength=len(kinds)).astype(np.int64)
    total2 = np.bincount(kinds >> 32, total3).astype(np.int64)
    two, three = total2[pair_at], total3[triple_at]
    cut2, cut3 = np.cumsum([len(p[0]) for p in parts])[:-1], np.cumsum([len(p[3]) for p in parts])[:-1]
    answers = [packed(a & 0xFFFFFFFF, a >> 32, b & 0xFFFFFFFF, b >> 32) for a, b in zip(np.split(two, cut2), np.split(three, cut3))]
    return _answer_table(table, table.column("bucket")[0].as_py(), answers)


class Automaton:
    """The part of the model that a block's texts can reach.

    States: the root, the block's words (the beginning among them), the block's pairs; those never
    seen in training have no arcs into them. Arcs are sorted by (state, word); ``fail_to`` and
    ``fail`` are each state's failure arc and its weight."""

    ROOT = 0

    def __init__(self, grams: Grams, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, ends: int, seen: int, kinds: int, priors=PRIORS):
        words = np.concatenate(([ends], words))
        self.width = width = len(words) + 1
        share = (words + 0.5) / (seen + 0.5 * (kinds + 1))
        self.root = np.log10(share)
        #: Where the root's arc of a word leads: to the word's state, if training has it.
        self.root_to = np.where(words > 0, np.arange(len(words)) + 1, self.ROOT)
        self.root_to[END] = self.ROOT
        # As many texts begin as end, so the beginning was a context as often as the end was a word.
        visits = np.append(words, ends).astype(float)
        u, v, w, of = grams.u, grams.v, grams.w, grams.pair
        one = (pairs + priors[0] * share[v]) / (visits[u] + priors[0])
        # The share of a triple's last word after its middle one is that of a pair, which may not be
        # asked for by this block's own pairs only where the middle word ends a text.
        by_local = np.argsort(u * width + v)
        middle = _look_up((u * width + v)[by_local], v[of] * width + w)
        middle = np.where(middle >= 0, by_local[middle], -1)
        shorter = np.where(middle >= 0, one[middle], share[w])
        two = (triples + priors[1] * shorter) / (pairs[of] + priors[1])
        # The end of a text leads nowhere on: to the root, from which nothing more is read.
        pair_state = np.where(v == END, self.ROOT, 1 + width + np.arange(len(u)))
        self.begin = 1 + grams.begin
        self.fail_to = np.concatenate(([self.ROOT], np.full(width, self.ROOT), v + 1))
        self.fail = np.concatenate(([0.0], np.log10(priors[0] / (visits + priors[0])), np.log10(priors[1] / (pairs + priors[1]))))
        seen_local = by_local[pairs[by_local] > 0]
        self.pair_keys, self.pair_states = (u * width + v)[seen_local], pair_state[seen_local]
        lower, upper = pairs > 0, (triples > 0) & (v[of] != END)
        to = np.where(middle >= 0, pair_state[middle], self.ROOT)
        keys = np.concatenate(((1 + u[lower]) * width + v[lower], pair_state[of[upper]] * width + w[upper]))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.weight = np.concatenate((np.log10(one[lower]), np.log10(two[upper])))[order]
        self.to = np.concatenate((pair_state[lower], to[upper]))[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, weights) of reading a word in each of several states: arcs are taken where there
        are any, failure arcs elsewhere, down to the root, which has an arc for every word."""
        state, weight = state.copy(), np.zeros(len(state))
        to, left = np.empty(len(state), np.int64), np.arange(len(state))
        while len(left):
            here, read = state[left], word[left]
            at = _look_up(self.keys, here * self.width + read)
            hit = at >= 0
            weight[left[hit]] += self.weight[at[hit]]
            to[left[hit]] = self.to[at[hit]]
            down = ~hit & (here == self.ROOT)
            weight[left[down]] += self.root[read[down]]
            to[left[down]] = self.root_to[read[down]]
            left = left[~hit & ~down]
            weight[left] += self.fail[state[left]]
            state[left] = self.fail_to[state[left]]
        return to, weight

    def context(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The states that texts ending in these two words are in: the longest context in training."""
        if not len(self.pair_keys):
            return self.root_to[last]
        at = _look_up(self.pair_keys, before * self.width + last)
        return np.where(at >= 0, self.pair_states[at], self.root_to[last])

    def walk(self, texts: Tokens, stride: int = STRIDE) -> np.ndarray:
        """The log10 probability of each text, read from left to right, one word a step, with the state
        carried along. All texts of the block are read together; a long one from several places at
        once, each beginning in the state that the words before it lead to."""
        parts = -(-texts.lengths // stride)
        text = np.repeat(np.arange(len(parts)), parts)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * stride
        order = np.argsort(-np.minimum(stride, texts.lengths[text] - at), kind="stable")
        text, at = text[order], at[order]
        first, lengths = texts.first[text] + at, np.minimum(stride, texts.lengths[text] - at)
        state, later = np.full(len(text), self.begin), np.flatnonzero(at)
        state[later] = self.context(texts.tokens[first[later] - 2], texts.tokens[first[later] - 1])
        total = np.zeros(len(text))
        still = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
        for k, n in enumerate(still.tolist()):
            state[:n], weight = self.step(state[:n], texts.tokens[first[:n] + k])
            total[:n] += weight
        return np.bincount(text, total, minlength=len(parts))


def _look_up(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked key is among the sorted keys, -1 where it isn't."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _score(buckets: int, ends: int, seen: int, kinds: int, priors):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _OUT})
        row = left.to_pylist()[0]
        texts = Tokens(row["tokens"])
        said = right.column("grams").to_numpy()
        numbers, words = _numbers(right.filter(pa.array(~said)))
        grams = Grams(texts, numbers, buckets)
        pairs, triples = grams.totals(right.filter(pa.array(said)))
        machine = Automaton(grams, words, pairs, triples, ends, seen, kinds, priors)
        known = np.concatenate(([ends], words)) > 0
        sums = lambda x: np.add.reduceat(x[texts.tokens], texts.first)
        cols = [row["doc_ids"], texts.held, texts.lengths, sums(known.astype(np.int64)), np.full(len(texts.lengths), seen), sums(machine.root), machine.walk(texts)]
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(_OUT, cols)})

    return run


_OUT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
_OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", priors: tuple[float, float] = PRIORS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A row whose identifier's crc32 modulo 5 is 1 is held out of training; a null identifier isn't.
    A null or empty text is its end alone. Repeated rows train as often as they occur and come back
    repeated. An empty table gives an empty table; without training rows every word is unknown.
    """
    short_batches(docs.sparkSession)
    texts = raw_texts(docs, id_col, text_col).withColumn("held", F.coalesce(id_hash("doc_id", 5) == 1, F.lit(False)))
    blocks = materialize(texts.mapInArrow(_gather(block_tokens), "block long, doc_ids array<long>, tokens binary, words binary"), "lm-blocks")
    buckets = max(MIN_BUCKETS, math.ceil(blocks.count() / BLOCKS_PER_BUCKET))
    words = blocks.select("block", "tokens", "words").mapInArrow(_send_words(buckets), _SENT).groupBy("bucket").applyInArrow(_count_words(buckets), _ANSWERED)
    words = materialize(words, "lm-words")
    whole = words.agg(F.sum("kinds").alias("kinds"), F.sum("seen").alias("seen")).first()
    ends = texts.filter("not held").count()
    told = words.filter("block >= 0").select("block", "bucket", "payload")
    sent = blocks.select("block", "tokens").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send_grams(buckets), _SENT)
    grams = materialize(sent.groupBy("bucket").applyInArrow(_sum_grams, _ANSWERED), "lm-grams")
    answers = told.withColumn("grams", F.lit(False)).unionByName(grams.filter("block >= 0").select("block", "bucket", "payload", F.lit(True).alias("grams")))
    model = _score(buckets, ends, (whole.seen or 0) + ends, (whole.kinds or 0) + (ends > 0), priors)
    return blocks.select("block", "doc_ids", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(model, _OUT_SQL)
