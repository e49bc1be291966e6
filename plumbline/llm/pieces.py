"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, white-space marker, unigram scores or merge
order, and byte fallback are rebuilt as tokenizers components. Where no piece has the marker after
another character, a text's ids are those of its words (a run of markers and what follows), so a
worker encodes each distinct word once, in multithreaded batches, and holds it against the
sentencepiece library the first time it is seen.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import raw_texts, short_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
CACHE_WORDS = 600_000
THREADS = 2
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _varint(data, at):
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes):
    """(field number, value) of one protobuf message; nested messages and strings as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a protobuf message")
        yield key >> 3, value


class PieceModel:
    """What a sentencepiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.unk = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models can be rebuilt")
        if any(p[2] == USER_DEFINED for p in self.pieces) or trainer.get(24, 0):
            raise ValueError("user-defined pieces and markers as suffixes are not supported")

    @cached_property
    def by_words(self) -> bool:
        """Whether no piece joins the marker to a character before it."""
        return self.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which the byte-pair model would join them: by the joined piece's
        score, then by the parts' ids."""
        ids = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED)}
        score = {p: s for p, s, _ in self.pieces}
        found = [(-score[p], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p in ids for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(a, b) for *_, a, b in sorted(found)]

    def model(self):
        from tokenizers import models

        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        vocab = {p: k for k, (p, _, _) in enumerate(self.pieces)}
        return models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)

    def normalizer(self):
        from tokenizers import Regex, normalizers as n

        steps = [n.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [n.Replace(Regex(" {2,}"), " "), n.Strip()]
        if self.escape:
            steps += [n.Prepend(MARK)] * self.prefix + [n.Replace(" ", MARK)]
        elif self.prefix:
            steps += [n.Prepend(" ")]
        return n.Sequence(steps)

    def tokenizer(self):
        """The whole model as a tokenizers pipeline."""
        from tokenizers import Regex, Tokenizer, decoders as d, pre_tokenizers as p

        out = Tokenizer(self.model())
        out.normalizer = self.normalizer()
        if self.by_words:
            out.pre_tokenizer = p.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        out.decoder = d.Sequence([d.Replace(MARK, " "), d.ByteFallback(), d.Fuse(), *([d.Strip(" ", 1, 0)] if self.prefix else [])])
        return out


class PieceCoder:
    """Encoder and decoder of one worker, with a bounded dictionary of words."""

    def __init__(self, path: str, verify: bool = True, threads: int = THREADS):
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            data = f.read()
        self.spec, self.threads, self.native = PieceModel(data), threads, None
        self.whole, self.bare = self.spec.tokenizer(), Tokenizer(self.spec.model())
        self.bare.decoder = self.whole.decoder
        self.words: dict[str, bytes] = {}
        #: Of those words: ids that the library has otherwise, unknown pieces, no way back.
        self.unequal: dict[str, int] = {}
        self.unknown: dict[str, int] = {}
        self.lossy: dict[str, int] = {}
        if verify:
            import sentencepiece

            self.native = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalize(self, text: str) -> str:
        if not self.spec.charsmap and not self.spec.squeeze and self.spec.escape:
            return (MARK if self.spec.prefix and text else "") + text.replace(" ", MARK)
        return self.whole.normalizer.normalize_str(text)

    def _split(self, text: str) -> list[str]:
        if not self.spec.by_words:
            return [text] if text else []
        if text[:1] == MARK and MARK + MARK not in text:
            return [MARK + w for w in text[1:].split(MARK)]
        return _WORDS.findall(text)

    def _add(self, new: list[str]) -> None:
        """Encode new words by the rebuilt model, hold them against the library, and decode them again."""
        ids = [e.ids for e in self.bare.encode_batch_fast(new, add_special_tokens=False)]
        if self.native is not None:
            cut = int(self.spec.prefix)
            # A marker alone can't be asked for: the library puts no marker before an empty text.
            which = [k for k, w in enumerate(new) if (w[0] == MARK and len(w) > cut) or not cut]
            told = self.native.encode([new[k][cut:].replace(MARK, " ") for k in which], num_threads=self.threads)
            if told != [ids[k] for k in which]:
                self.unequal.update((new[k], 1) for k, truth in zip(which, told) if truth != ids[k])
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat = np.fromiter(chain.from_iterable(ids), np.dtype("<u4"), int(ends[-1]))
        raw, cuts = flat.tobytes(), (4 * ends).tolist()
        self.words.update(zip(new, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        if (flat == self.spec.unk).any():
            self.unknown.update((w, i.count(self.spec.unk)) for w, i in zip(new, ids) if self.spec.unk in i)
        back = self.bare.decode_batch(ids, skip_special_tokens=False)
        want = [w.replace(MARK, " ") for w in new]
        if self.spec.prefix:
            want = [w[1:] if w[:1] == " " else w for w in want]
        if back != want:
            self.lossy.update((w, 1) for w, x, y in zip(new, back, want) if x != y)

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, bool, int]]:
        """(ids as little-endian unsigned 32-bit, unknown ids, whether decoding gives the normalised
        text back, words that differed from the library) by text. Pieces never reach over words, so
        all of this is known by word."""
        split = [self._split(self.normalize(t)) for t in texts]
        every = set().union(*split)
        new = every - self.words.keys()
        if len(self.words) + len(new) > CACHE_WORDS:
            for held in (self.words, self.unequal, self.unknown, self.lossy):
                held.clear()
            new = every
        if new:
            self._add(list(new))
        look = self.words.__getitem__
        total = lambda odd, words: sum(map(odd.get, filter(odd.__contains__, words))) if odd else 0
        return [(b"".join(map(look, words)), total(self.unknown, words), not total(self.lossy, words), total(self.unequal, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, by the rebuilt decoder: markers are spaces, bytes are read as UTF-8, the leading
        marker goes."""
        return self.bare.decode(ids.tolist(), skip_special_tokens=False)


_LOADED: dict[tuple, PieceCoder] = {}


def loaded(path: str, verify: bool = True) -> PieceCoder:
    if (path, verify) not in _LOADED:
        _LOADED[path, verify] = PieceCoder(path, verify)
    return _LOADED[path, verify]


#: Bytes of text encoded in one multithreaded batch at most (or one text, if it is longer).
_TOGETHER = 4 << 20


def _encoder(path, verify, with_ids):
    def rows(ids, raws):
        coder = loaded(path, verify)
        texts = [r.decode("utf-8", "replace") for r in raws]
        out = [ids, [], [], [], [], [], []]
        for coded, unknown, same, unequal in coder.encode(texts):
            for c, x in zip(out[1:], (len(coded) // 4, unknown, zlib.crc32(coded), same, unequal, np.frombuffer(coded, "<u4").astype(np.int32) if with_ids else None)):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()))
        names = ["doc_id", "n_tokens", "n_unknown", "ids_crc32", "round_trip", "n_unequal", "ids"]
        keep = len(names) if with_ids else len(names) - 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)][:keep], names[:keep])

    def run(batches):
        for batch in batches:
            ids, raws, held = [], [], 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                raws.append(raw.as_py())
                held += len(raws[-1])
                if held >= _TOGETHER:
                    yield rows(ids, raws)
                    ids, raws, held = [], [], 0
            if ids:
                yield rows(ids, raws)

    return run


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_unknown, ids_crc32, round_trip, n_unequal[, ids]) of every row's whole text.

    ``round_trip``: decoding gives the normalised text back (not so where unknown pieces are).
    ``n_unequal``: words whose ids the sentencepiece library has otherwise; the ids are the rebuilt
    model's all the same.
    A null or empty text has no ids. Repeated rows and null identifiers are kept.
    """
    short_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, n_unknown long, ids_crc32 long, round_trip boolean, n_unequal long" + (", ids array<int>" if with_ids else "")
    return raw_texts(docs, id_col, text_col).mapInArrow(_encoder(model, verify, with_ids), schema)


def decode_pieces(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""

    def run(batches):
        for batch in batches:
            coder = loaded(model, False)
            texts = [None if v.as_py() is None else coder.decode(np.array(v.as_py(), np.int64)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    short_batches(coded.sparkSession)
    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")
