"""The text operators by brute force, and on odd rows: nulls, empty and very long texts, repeats,
empty tables, columns whose names clash with theirs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import nearcopies, ngrams, packing, pieces, pii, quality, simhash, telephony, wordids
from plumbline.llm.registry import vocabulary

ODD = [
    (1, "One two  three\tfour five\n", "x", 1), (2, None, "x", 1), (3, "", None, 1), (3, "", None, 1), (None, "no identifier here at all", "x", 1), (4, "A a A a", "x", None),
    (5, "wörter üben naïve façade 東京 🙂   end", "x", 1), (6, "word " * 60_000, "x", 1), (7, "one two three four five", "x", 1), (-8, " \n\t ", "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns named like those the operators make or use inside."""
    return spark.createDataFrame(ODD, "doc_id long, text string, raw string, score int").selectExpr("*", "1 AS fp", "2 AS component_id", "'z' AS spans", "3 AS part", "4 AS length", "5 AS block", "6 AS n_tokens")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# -- 1 ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    """prints: {doc: fingerprint} → {doc: smallest reachable doc}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(docs, texts):
    rows = simhash.simhash_components(docs).collect()
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)


def test_simhash_odd(odd, none):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert {got[i].component_id for i in (2, 3, -8)} == {-8} and got[2].fingerprint == "0" * 16
    assert got[None].component_id is None and got[6].fingerprint == f"{brute_fingerprint('word ' * 9):016x}"
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, None, 4, 5, 6, -8} | ({7} if got[7].component_id == 7 else set())


@pytest.mark.parametrize("sizes", [(300, 200), (1, 1), (2000, 5)])
def test_tiles_find_every_link(sizes):
    g = np.random.default_rng(sum(sizes))
    a = g.integers(0, 1 << 64, sizes[0], dtype=np.uint64)
    b = g.integers(0, 1 << 64, sizes[1], dtype=np.uint64)
    for k in range(min(len(a), len(b), 60)):
        b[k] = a[k] ^ np.uint64(sum(1 << int(x) for x in g.choice(64, k % 7, replace=False)))
    both = np.concatenate([a, b])
    near = np.bitwise_count(both[:, None] ^ both[None, :]) <= 4
    for root, mask in ((simhash.link_forest(a, b), lambda i, j: (i < len(a)) != (j < len(a))), (simhash.link_forest(both, None), lambda i, j: True)):
        want = list(range(len(both)))

        def find(x):
            while want[x] != x:
                x = want[x]
            return x

        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            if mask(i, j):
                x, y = sorted((find(i), find(j)))
                want[y] = x
        assert root.tolist() == [find(k) for k in range(len(both))]


@pytest.mark.parametrize("group_rows", [1 << 17, 40])
def test_groups_by_bit_counts_lose_no_link(spark, group_rows):
    g = np.random.default_rng(1)
    base = g.integers(0, 1 << 64, 700, dtype=np.uint64)
    moved = [base[k % 200] ^ np.uint64(sum(1 << int(x) for x in g.choice(64, k % 7, replace=False))) for k in range(700)]
    a = np.array([*base, *moved, *[np.uint64(0)] * 3, np.uint64((1 << 64) - 1), np.uint64(1)], np.uint64)
    root = simhash.link_forest(a, None)
    rows = [(k, int(v)) for k, v in enumerate(a.view(np.int64))]
    got = {r.fp: r.component_id for r in simhash.components(spark.createDataFrame(rows, "doc_id long, fp long"), group_rows=group_rows).collect()}
    assert [got[fp] for _, fp in rows] == root.tolist()


def brute_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_groups(texts, similarity=0.8):
    """texts: [(doc, text)] → the smallest doc that links by exact shingle sets reach, row by row."""
    sets = [brute_shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if sets[i] == sets[j] or (sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for k, (doc, _) in enumerate(texts):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [least.get(find(k)) for k in range(len(texts))]


def edited(g, words, edits):
    words = list(words)
    for _ in range(edits):
        words[g.randrange(len(words))] = f"edit{g.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("group_rows", [1 << 18, 40])
def test_similar_groups_against_brute_force(spark, docs, texts, group_rows):
    """The test documents, and families of copies with more and more words changed, each from the one
    before or from the first."""
    g = random.Random(11)
    rows = list(texts.items())
    for family in range(12):
        words = [f"f{family}w{g.randrange(300)}" for _ in range(g.choice([60, 200, 500]))]
        last = words
        for k in range(8):
            text = edited(g, last if family % 2 else words, g.randint(0, len(words) // 40))
            rows.append((10_000 + 100 * family + k, text))
            last = text.split(" ")
    rows += [(None, rows[-1][1]), (None, "an identifier less text"), (3, rows[-1][1]), (20_000, None), (20_001, " \t "), (20_002, "four words are one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS same", "3 AS fp")
    got = Counter((r.doc_id, r.component_id) for r in nearcopies.similar_groups(df, group_rows=group_rows).collect())
    assert got == Counter((i, c) for (i, _), c in zip(rows, brute_groups(rows)))
    kept = nearcopies.drop_similar(df)
    assert kept.columns == df.columns
    want = Counter((i, t) for (i, t), c in zip(rows, brute_groups(rows)) if c is None or c == i)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_similar_odd(odd, none):
    kept = nearcopies.drop_similar(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, None, 4, 5, 6, -8}
    assert nearcopies.drop_similar(none).count() == 0


def test_groups_at_the_border_by_brute_force(spark):
    """Families whose pairs lie on both sides of 0.8, in whatever order they come: the groups are those
    of all pairs, every time."""
    g = random.Random(5)
    rows = []
    for family in range(6):
        words = [f"f{family}w{g.randrange(5000)}" for _ in range(300)]
        rows += [(1000 * family + k, edited(g, words, g.choice([3, 5, 6, 7, 8]))) for k in range(30)]
    want = Counter(zip((i for i, _ in rows), brute_groups(rows)))
    assert 6 < len({c for _, c in want}) < len(rows)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3 + seed)
        for group_rows in (1 << 18, 50):
            assert Counter((r.doc_id, r.component_id) for r in nearcopies.similar_groups(df, group_rows=group_rows).collect()) == want


def test_one_identifier_of_unlike_texts_joins_nothing(spark):
    """(3, X') links to (1, X); what else has identifier 3 doesn't."""
    g = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    x, y, own = " ".join(words), edited(g, words, 1), "a text that nothing else is like, of a few words"
    assert 0 < (brute_fingerprint(x) ^ brute_fingerprint(y)).bit_count() <= 4
    rows = [(1, x), (3, own), (3, y), (5, own + " once more")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, f"{brute_fingerprint(t):016x}"): c for (i, t), c in zip(rows, (1, 3, 1, 5))}


def test_components_of_a_long_chain_and_a_hub(spark):
    from plumbline.llm.components import smallest_reachable

    links = [(k, k + 1) for k in range(100, 140)] + [(500, 500 + k) for k in range(1, 200)] + [(7, 7), (None, 3), (101, 100)]
    got = {r.a: r.b for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {k: 500 for k in range(501, 700)}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------


def test_pieces_match_the_library(docs, texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = pieces.encode_pieces(docs, path)
    rows = {r.doc_id: r for r in coded.collect()}
    for i, t in texts.items():
        assert list(rows[i].ids) == lib.encode(t) and rows[i].round_trip and rows[i].n_unequal == 0
    assert {r.doc_id: r.text for r in pieces.decode_pieces(coded, path).collect()} == texts


def test_pieces_odd(odd, none):
    path = vocabulary("piece_bpe_32k.model")
    rows = pieces.encode_pieces(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert pieces.encode_pieces(none, path).count() == 0


def message(*fields):
    """A protobuf message of (number, value): int, float, str or bytes."""
    import struct

    def number(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += number(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += number(k << 3) + number(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += number(k << 3 | 2) + number(len(v)) + v
    return out


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model_with_byte_fallback(tmp_path, squeeze):
    """A hand-written unigram model: scores decide, what no piece covers falls to bytes."""
    import sentencepiece

    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = {"▁": -3.0, "a": -4.0, "b": -4.0, "ab": -5.0, "▁ab": -4.5, "aba": -5.5, "▁a": -6.0, "ba": -6.5}
    found = [message((1, message((1, p), (2, s), (3, k)))) for p, s, k in kinds + [(w, s, 1) for w, s in words.items()]]
    trainer, norm = message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)), message((1, "identity"), (3, 1), (4, squeeze), (5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(b"".join(found) + message((2, trainer), (3, norm)))
    coder, lib = pieces.PieceCoder(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    g = random.Random(1)
    cases = ["", "ab", "abab aba", "é b", "a  b", " ab "] + ["".join(g.choice("ab é") for _ in range(g.randint(1, 30))) for _ in range(200)]
    for t, (ids, unknown, same, unequal) in zip(cases, coder.encode(cases)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t), t
        assert unequal == unknown == 0 and coder.whole.encode(t, add_special_tokens=False).ids == lib.encode(t)
        back = coder.decode(np.frombuffer(ids, "<u4"))
        assert same == (back == coder.normalize(t).replace(pieces.MARK, " ")[int(coder.spec.prefix and bool(t)) :]), t


def as_unigram(data):
    """The same pieces as a unigram model: a piece's score is the logarithm of its rank, as if by Zipf."""
    out, rank = b"", 1
    for number, value in pieces.fields(data):
        if number == 1:
            piece = dict(pieces.fields(value))
            rank += 1
            value = message((1, piece[1]), (2, -math.log(rank) - 2.0), (3, piece.get(3, pieces.NORMAL)))
        if number == 2:
            value = message(*((k, 1 if k == 3 else v) for k, v in raw_fields(value)))
        out += message((number, value))
    return out


def raw_fields(data):
    """Fields with 32-bit ones as floats, so that they can be written again."""
    import struct

    for number, value in pieces.fields(data):
        yield number, struct.unpack("<f", value)[0] if isinstance(value, bytes) and len(value) == 4 and number in (10, 12, 13, 14, 15) else value


def test_whole_documents_by_a_unigram_model(docs, texts, tmp_path):
    """The public model's pieces and scores read as a unigram model, over all documents."""
    import sentencepiece

    path = tmp_path / "unigram.model"
    path.write_bytes(as_unigram(open(vocabulary("piece_bpe_32k.model"), "rb").read()))
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    coded = pieces.encode_pieces(docs, str(path))
    rows = {r.doc_id: r for r in coded.collect()}
    assert pieces.PieceModel(path.read_bytes()).kind == pieces.UNIGRAM
    # The library adds up a whole text's scores in single precision, so that ties fall otherwise in long ones.
    differ = [i for i, t in texts.items() if list(rows[i].ids) != lib.encode(t)]
    by_word = lambda t: sum((lib.encode(w) for w in t.split(" ")), [])
    assert all(list(rows[i].ids) == by_word(texts[i]) or rows[i].n_unequal > 0 or "  " in texts[i] for i in differ) and len(differ) <= len(texts) // 10
    assert {r.doc_id: r.text for r in pieces.decode_pieces(coded, str(path)).collect()} == texts


def test_disagreement_is_reported_and_not_hidden():
    coder = pieces.PieceCoder(vocabulary("piece_bpe_32k.model"))
    own = coder.encode(["some words here"])[0][0]

    class Other:
        def encode(self, words, num_threads):
            return [[1] for _ in words]

    coder.words.clear()
    coder.native = Other()
    ids, _, same, unequal = coder.encode(["some words here"])[0]
    assert ids == own and unequal == 3 and same


# -- 4 ---------------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity=1024):
    """rows against whole-text ids by the tokenizers library."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want, bins = Counter(), {}
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        over = len(ids) % capacity
        cuts = [0, *range(over or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r.length for r in rows)
    return len(bins), math.ceil(total / capacity)


def test_packing_against_whole_texts(docs, texts):
    used, least = check_packing(packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).collect(), texts.items())
    assert used <= least + 1


def test_packing_odd(odd, none):
    path = vocabulary("byte_bpe_50k.json")
    check_packing(packing.pack_documents(odd, path).collect(), [(i, t) for i, t, *_ in ODD])
    assert packing.pack_documents(none, path).count() == 0
    whole = packing.assemble(packing.pack_documents(odd, path, with_ids=True)).collect()
    assert all(len(r.ids) == r.length <= 1024 for r in whole) and sum(r.length for r in whole) == sum(r.length for r in packing.pack_documents(odd, path).collect())


def test_best_fit_runs_equal_best_fit_rows():
    """Runs open exactly as many sequences as best-fit decreasing over single rows."""
    g = random.Random(4)
    for _ in range(60):
        rows = [g.randint(1, g.choice([6, 30, 64])) for _ in range(g.randint(1, 200))]
        first, seq, off = packing.best_fit_runs(Counter(rows), 64)
        gaps = []
        for n in sorted(rows, reverse=True):
            fit = min((x for x in range(len(gaps)) if gaps[x] >= n), key=lambda x: gaps[x], default=None)
            if fit is None:
                gaps.append(64 - n)
            else:
                gaps[fit] -= n
        at = np.arange(len(rows))
        run = np.searchsorted(first, at, side="right") - 1
        assert len(set(seq[run] + at - first[run])) == len(gaps)


def test_word_ids_equal_whole_text_ids():
    w = wordids.WordIds(vocabulary("byte_bpe_50k.json"))
    assert w.ranked is not None
    g = random.Random(2)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", " ", "　", "'s", "12", "!?", "東", "🙂", "<|endoftext|>", "\x1c", "\x85"]
    for _ in range(3000):
        t = "".join(g.choice(alphabet) for _ in range(g.randint(0, 25)))
        assert w.encode(t) == np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


# -- 5 ---------------------------------------------------------------------------------------------


def adpcm_by_hand(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(telephony._STEPS[index])
            d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
            out.append(value)
    return out


def test_telephony_decoders_by_hand():
    g = np.random.default_rng(0)
    blocks = g.integers(0, 256, (40, 192), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [adpcm_by_hand(bytes(b)) for b in blocks]
    mu = telephony.TABLES["mulaw"].astype(int)
    for c in range(256):
        u = ~c & 255
        t = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
        assert mu[c] == (-t if u & 128 else t)
    a = telephony.TABLES["alaw"].astype(int)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A], a[0x80], a[0x00]) == (8, -8, 32256, -32256, 5504, -5504)
    wave = (9000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    back = telephony.expand([telephony.encode_adpcm(wave)], "adpcm")[0][:3000]
    assert np.abs(back.astype(int) - wave).mean() < 150
    assert telephony.resample(np.array([0, 100, 200], np.int16), 8000, 16000).tolist() == [0, 50, 100, 150, 200, 200]


def test_telephony_rows(odd, none):
    import hashlib

    rows = telephony.telephony_digests(odd).collect()
    assert len(rows) == len(ODD)
    for text in {t for _, t, *_ in ODD}:
        payload = telephony.pad((text or "").encode())
        same = {tuple(r)[1:] for r in rows if r.payload_sha256 == hashlib.sha256(payload).hexdigest()}
        if (text or "").strip() or text in (None, ""):
            assert len({r[1:] for r in same}) >= 1
        one = next(iter(same))
        assert one[2] == len(payload) and len(payload) % 192 == 0 and payload
    full = telephony.telephony_columns(odd).collect()
    for r in full:
        codec, rate, block, payload = telephony.load(r.media)
        assert codec == r.codec and payload.rstrip(b" ") == (dict((i, t) for i, t, *_ in ODD)[r.doc_id] or "").encode().rstrip(b" ")
    assert telephony.telephony_digests(none).count() == 0
    decoded = telephony.decode_recordings(telephony.telephony_columns(odd, "mulaw")).collect()
    assert {r.doc_id: r.pcm for r in decoded} == {r.doc_id: r.pcm for r in telephony.telephony_columns(odd, "mulaw").collect()}


# -- 7 ---------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows} == {True, False} and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all((r.score >= 0.7) == bool(r.predicted) for r in rows)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 1), (None, 1), (5, None), (99, 0)], "doc_id long, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {1.0}
    assert quality.keep_good(odd, labels.limit(0)).count() == len(ODD) and quality.keep_good(odd, labels).columns == odd.columns


def test_attention_gradients():
    """The fitted loss falls, and an odd passage alone can reject a document."""
    g = np.random.default_rng(0)
    bags = [g.normal(0, 1, (g.integers(1, 6), quality.FEATURES)) for _ in range(200)]
    y = np.array([k % 2 for k in range(200)], float)
    for b, label in zip(bags, y):
        b[g.integers(len(b)), 0] += 0 if label else 8
    first = np.cumsum([0, *map(len, bags[:-1])])
    x = np.concatenate(bags)
    m = quality.GatedAttention.fresh(x.mean(0), x.std(0) + 0.02).fit(x, first, y)
    assert ((m.scores(x, first) > 0.5) == y).mean() > 0.95


# -- 8 ---------------------------------------------------------------------------------------------


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            s = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(d)))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and s % 10 == 0 or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_pii_against_patterns(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    import hashlib

    text = {r.doc_id: r.text for r in d.collect()}
    found = 0
    for r in pii.find_pii(d).collect():
        base = brute_base(text[r.doc_id])
        found += len(base)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in base) for k in pii.KINDS)
    assert found > 20


def test_pii_base_on_random_strings():
    g = random.Random(3)
    for _ in range(4000):
        t = "".join(g.choice(["a", "@", ".", "1", "25", "4111111111111111", " ", "-", "+", "(", ")", "é", "x.y", "@@", "0"]) for _ in range(g.randint(1, 25)))
        assert pii.base_spans(t) == brute_base(t), t


@pytest.mark.parametrize(
    "text, span, kind",
    [
        ("mail joe dot smith at mail3 dot example dot com now", "joe dot smith at mail3 dot example dot com", "email"), ("write joe [at] mail.example.com, ok", "joe [at] mail.example.com", "email"),
        ("joe(at)mail(dot)example(dot)com", "joe(at)mail(dot)example(dot)com", "email"), ("ｊｏｅ@ｍａｉｌ.example.com", "ｊｏｅ@ｍａｉｌ.example.com", "email"), ("é jоe@exаmple.com", "jоe@exаmple.com", "email"),
        ("jane.doe AT example DOT com", "jane.doe AT example DOT com", "email"), ("jane_doe {at} example {dot} org", "jane_doe {at} example {dot} org", "email"), ("jane.doe@example dot com", "jane.doe@example dot com", "email"),
        ("in und.34 at mail7.example.com geiever", "und.34 at mail7.example.com", "email"), ("jane.doe＠example．com hi", "jane.doe＠example．com", "email"), ("jane&#64;example.com hi", "jane&#64;example.com", "email"), ("a jane%40example.com hi", "jane%40example.com", "email"),
        ("a joe_at_mail_dot_example_dot_com hi", "joe_at_mail_dot_example_dot_com", "email"), ("joe arroba mail punto example punto com x", "joe arroba mail punto example punto com", "email"),
        ("to jоe.34@mail.com x", "jоe.34@mail.com", "email"), ("to joe.34@mail.exаmple.com x", "joe.34@mail.exаmple.com", "email"), ("to joe.34@mail\u200b7.exam\u200bple.com x", "joe.34@mail\u200b7.exam\u200bple.com", "email"),
        ("+one two one two five five five one two three four", "+one two one two five five five one two three four", "phone"), ("call plus one two one two five five five one two three four", "plus one two one two five five five one two three four", "phone"),
        ("+l (O17) 555-77l3 x", "+l (O17) 555-77l3", "phone"), ("+1 (017) 555‑7713 x", "+1 (017) 555‑7713", "phone"), ("+1 (zero one seven) five five five-seven seven one three x", "+1 (zero one seven) five five five-seven seven one three", "phone"),
        ("at 10 dot 20 dot 30 dot 40 here", "10 dot 20 dot 30 dot 40", "ip"), ("ip 97.51[.]17[.]173 z", "97.51[.]17[.]173", "ip"), ("at one two seven dot zero dot zero dot one here", "one two seven dot zero dot zero dot one", "ip"),
        ("card four one one one 1111 1111 1111", "four one one one 1111 1111 1111", "card"), ("card 4III I1l1 1111 1111 x", "4III I1l1 1111 1111", "card"), ("n vier acht vier fünf eins sechs acht eins eins vier vier null sieben drei zwei neun", "vier acht vier fünf eins sechs acht eins eins vier vier null sieben drei zwei neun", "card"),
    ],
)
def test_pii_disguises(text, span, kind):
    base, every = pii.all_spans(text)
    assert not [s for s in base if text[s[1] : s[2]] == span] and (kind, text.index(span), text.index(span) + len(span)) in every
    assert f"[{kind.upper()}]" in pii.mask(text, every) and span not in pii.mask(text, every)


@pytest.mark.parametrize("text", ["meet me at noon. Then go", "one two three", "he is at home. dot", "a (at) b", "The seven and the nine", "ein at an der dot", "Visit us at example.com now", "un deux trois quatre cinq six sept", "10l of oil and 20l", "[at] the end (dot)", "snow-at-sea"])
def test_pii_leaves_prose(text):
    assert pii.all_spans(text)[1] == []


@pytest.mark.parametrize("text", ["a_dot_" * 20_000, "1 " * 50_000 + "one", "one" + " ," * 50_000, "one " * 20_000, "a at " * 20_000, "(" * 50_000 + "at", "x" * 200_000 + " (at) y", "7" * 200_000 + " one two three", "a dot " * 20_000, "l1" * 50_000, "a%40" * 20_000])
def test_pii_of_long_runs_is_quick(text):
    import time

    began = time.perf_counter()
    assert pii.all_spans(text)[1] == [] and time.perf_counter() - began < 5


def test_pii_words_after_a_number_are_prose():
    text = "ouvi. +1 (848) 555-1373 Un an. Un deux trois"
    base, every = pii.all_spans(text)
    assert base == every == [("phone", 6, 23)]


def test_pii_odd(odd, none):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)
    assert pii.find_pii(none).count() == 0
    masked = pii.mask_pii(odd)
    assert masked.columns == odd.columns and sorted(map(str, masked.collect())) == sorted(map(str, odd.collect()))


# -- 10 --------------------------------------------------------------------------------------------


def brute_scores(rows, priors=ngrams.PRIORS):
    """rows: [(doc, text)] → {doc: (n_tokens, n_known, N, base, score)}, by counters over whole texts."""
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    uni, pair, triple = Counter(), Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            w = words(t)
            uni.update(w)
            w = [b"<begin>", *w]
            pair.update(zip(w, w[1:]))
            triple.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)
    visits = {**uni, b"<begin>": uni[None]}
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda g, w: (pair[g, w] + priors[0] * p1(w)) / (visits.get(g, 0) + priors[0])
    p3 = lambda f, g, w: (triple[f, g, w] + priors[1] * p2(g, w)) / (pair[f, g] + priors[1])
    out = {}
    for i, t in rows:
        w = words(t)
        full = [b"<begin>", *w]
        score = math.log10(p2(b"<begin>", w[0])) + sum(math.log10(p3(*x)) for x in zip(full, full[1:], full[2:]))
        out[i] = (len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score)
    return out


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_scores_against_brute_force(docs, texts, block):
    want = brute_scores(list(texts.items()))
    rows = ngrams.score_texts(docs, block_tokens=block).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_scores_odd(odd, none):
    want = brute_scores([(i, t) for i, t, *_ in ODD])
    rows = ngrams.score_texts(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    assert ngrams.score_texts(none).count() == 0


def small_automaton(texts, held, priors):
    """The automaton of one block whose texts are the whole corpus, and the block."""
    b = ngrams._Block()
    for k, t in enumerate(texts):
        b.add(k, k in held, t)
    row = b.row(0).to_pylist()[0]
    block, words = ngrams.Tokens(row["tokens"]), ngrams._words(row["words"])
    counts = np.bincount(block.tokens[block.learnt], minlength=len(words) + 1)
    grams = ngrams.Grams(block, np.arange(2, len(words) + 2), 8)
    pairs = np.bincount(grams.pair, grams.counts, minlength=len(grams.u)).astype(np.int64)
    m = ngrams.Automaton(grams, counts[1:], pairs, grams.counts, int(counts[0]), int(counts.sum()), int((counts > 0).sum()), priors)
    return m, block, counts


def test_failure_arcs_go_through_shorter_contexts_and_states_sum_to_one():
    m, block, counts = small_automaton([b"a b a b c", b"", b"b a", b"c c c", b"a b c a b"], {3}, (2.0, 0.5))
    assert set(m.fail_to[1 : m.width + 1]) == {m.ROOT} and all(1 <= s <= m.width for s in m.fail_to[m.width + 1 :])
    unseen = 0.5 / (counts.sum() + 0.5 * ((counts > 0).sum() + 1))
    known = np.flatnonzero(counts > 0)
    reached = {m.begin, *m.to.tolist()} - {m.ROOT}
    for state in reached:
        at, fallen = state, 0.0
        while at != m.ROOT:
            fallen, at = fallen + m.fail[at], m.fail_to[at]
        _, weight = m.step(np.full(len(known), state), known)
        assert (10**weight).sum() + 10**fallen * unseen == pytest.approx(1.0), state


def test_texts_walked_together_equal_texts_walked_alone():
    g = random.Random(6)
    texts = [" ".join(g.choice("abcde") for _ in range(g.randint(0, 30))).encode() for _ in range(50)]
    m, block, _ = small_automaton(texts, {3, 4}, (2.0, 0.5))
    alone = []
    for f, n in zip(block.first, block.lengths):
        state, total = np.array([m.begin]), 0.0
        for w in block.tokens[f : f + n]:
            state, weight = m.step(state, np.array([w]))
            total += weight[0]
        alone.append(total)
    for stride in (2, 7, 256):
        assert m.walk(block, stride) == pytest.approx(alone)


def test_planes():
    x = np.array([0, 1, 300, 1 << 40], np.uint64)
    assert ngrams.unplanes(ngrams.planes(x), np.uint64).tolist() == x.tolist()


@pytest.mark.parametrize(
    "span",
    ["a dot b dot c dot d dot e dot f (at) example dot com", "x at a dot b dot c dot d dot e dot f dot g dot h dot org", " dot ".join("abcdefghij" * 30) + " at " + " dot ".join("abcdefghij" * 30), "a_dot_b_dot_c_dot_d_dot_e_dot_f_dot_g_at_a_dot_b_dot_c_dot_d_dot_e_dot_f_dot_g_dot_h", "x%40y%40example.com"],
)
def test_pii_disguises_of_any_length(span):
    """However many spoken dots an address has, it is found from its first part to its last."""
    text = f"write {span}, ok"
    assert pii.mask(text, pii.all_spans(text)[1]) in ("write [EMAIL], ok", "write x%40[EMAIL], ok")


def test_near_copies_go_by_row(spark):
    """A row is judged by its own text, not by what else has its identifier."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words), (3, "a text of its own that nothing else is like at all"), (3, words), (None, words), (None, "quite another one without any identifier"), (4, words + " w"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS same")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    near = bin(brute_fingerprint(words) ^ brute_fingerprint(words + " w")).count("1") <= 4
    assert got == {(1, words), (3, rows[1][1]), (None, rows[4][1]), (5, None)} | (set() if near else {(4, words + " w")})


def test_good_rows_are_kept_by_their_own_text(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    one = docs.withColumn("doc_id", F.lit(1).cast("long"))
    want = Counter(r.text for r in docs.join(quality.score_quality(docs, labels).filter("predicted = 1"), "doc_id").collect())
    model = quality.fit_quality(docs, labels)
    score = quality._scoring(model)
    assert Counter(r.text for r in one.filter(score(quality.utf8("text")) >= 0.7).collect()) == want and sum(want.values()) < docs.count()


def brute_quality(model, raw):
    """One text's score by loops over passages, from the model's numbers."""
    p, h, e = model.p, [], []
    for at in range(0, max(len(raw), 1), 1024):
        part = raw[at : at + 1024]
        x = np.zeros(quality.FEATURES)
        words = part.lower().split()
        if part:
            for b in range(256):
                x[b] = math.sqrt(part.count(bytes([b])) / len(part))
            x[256] = len(zlib.compress(part, 1)) / (len(part) + 24)
            x[257] = 8 * len(words) / len(part)
            x[258] = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
            x[259] = len(part) / 1024
        x = (x - model.mean) / model.scale
        v = np.tanh(x @ p["W"] + p["b"])
        h.append(v)
        e.append(float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]))
    a = [math.exp(x - max(e)) for x in e]
    z = sum(x * v for x, v in zip(a, h)) / sum(a)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0])))


def test_quality_against_brute_force(spark, docs, texts, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    long = "lorem ipsum " * 30_000
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, long), (-6, None), (-7, "")], "doc_id long, text string"))
    want = {i: brute_quality(model, (t or "").encode()) for i, t in {**texts, -5: long, -6: None, -7: ""}.items()}
    score = quality._scoring(model)
    for r in more.select("doc_id", score(quality.utf8("text")).alias("score")).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-3)


def test_every_passage_is_learnt_from(spark):
    """One odd passage among two hundred decides the label; a sample of passages would miss it."""
    g = random.Random(0)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(128))[:1024] for _ in range(200)]
        if k % 2:
            parts[g.randrange(200)] = "#@!" * 341 + " "
        rows.append((k, "".join(parts), 1 - k % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.score_quality(df.drop("quality"), df.select("doc_id", "quality")).join(df.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([(r.score > 0.5) == (r.quality == 1) for r in got if not r.held_out]) > 0.95
