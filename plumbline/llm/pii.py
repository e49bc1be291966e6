"""Personal data in whole texts, with offset-preserving deobfuscation.

Plain identifiers are found by patterns on the source text. Disguised ones are found by a chain of
transducers: each rewrites the text (look-alike letters, spelled-out digits, at/dot disguises)
and carries, for every output character, the span of source characters it stands for. Identifiers
found in the rewritten text are mapped back through that chain, so every span, plain or
disguised, is in code points of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import short_batches

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No leftmost match begins within a run of digits, so long runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: No card, address or number without one of these; whole texts that have none are passed over.
_ANY = re.compile(r"[@0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """The matches of the address pattern, tried only around each "@": its start is the earliest
    character of the run of local characters before it, which is where a leftmost match begins."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers by start, then kind as listed; end is exclusive."""
    if not _ANY.search(text):
        return []
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    found += [(a, 1, b) for a, b in _ips(text)]
    found += [(a, 2, b) for a, b in _cards(text)]
    if "+" in text:
        found += [(a, 3, b) for a, b in _phones(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


# -- transducers ---------------------------------------------------------------------------------

_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
    "。": ".", "․": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-",
    " ": " ", " ": " ", " ": " ", " ": " ",
}
_ZERO_WIDTH = "​‌‍⁠﻿­"
#: Spelled digits in the four languages of the corpus.
_NUMBER = {
    word: str(digit)
    for digit, words in enumerate(
        ("zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
    )
    for word in words.split()
}
#: Ranges whose compatibility form is an ASCII letter, digit or sign: full width, enclosed and
#: mathematical letters, superscript and subscript digits, other scripts' digits.
_ODD = re.compile(
    "[" + "".join(map(re.escape, _LOOKS)) + _ZERO_WIDTH
    + "！-～①-⑳Ⓐ-ⓩ⁰-₉²³¹٠-٩۰-۹०-९﹒﹫\U0001d400-\U0001d7ff]"
)
_WORDS = "|".join(sorted(_NUMBER, key=len, reverse=True))
_AT_WORD, _DOT_WORD = "at|arroba|arobase", "dot|punkt|point|punto"
_GAP = rf"(?:[ ,.()\-]+|\s+(?:{_DOT_WORD})\s+)"
#: At least four digits, one of them spelled, a spoken "plus" before them counting as the sign.
_SPELLED = re.compile(rf"(?<![A-Za-zÀ-ÿ])(?:plus\s+(?={_WORDS}|[0-9]))?(?:{_WORDS}|[0-9])(?:{_GAP}?[0-9]|{_GAP}(?:{_WORDS})(?![A-Za-zÀ-ÿ])){{3,}}(?![A-Za-zÀ-ÿ])", re.I)
_ONE_WORD = re.compile(rf"(?<![A-Za-zÀ-ÿ])(plus\s+)?({_WORDS})?(?(2)([ ,\-]+(?=(?:{_WORDS})(?![A-Za-zÀ-ÿ])))?)", re.I)
_AT = rf"(?:\s*[\[({{<]\s*(?:{_AT_WORD}|@)\s*[\])}}>]\s*|\s+(?:{_AT_WORD})\s+|\s+@\s*|\s*@\s+)"
_DOT = rf"(?:\s*[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]\s*|\s+(?:{_DOT_WORD})\s+)"
_PART = r"[A-Za-z0-9-]+"
_LOCALS = r"(?:(?!%40)[A-Za-z0-9_%+-])+(?:\.(?:(?!%40)[A-Za-z0-9_%+-])+)*"
_BEFORE = r"(?<![A-Za-z0-9._%+-])"
#: A local part: parts between plain or spoken dots, however many, taken whole and never tried again
#: from within, so that a chain of any length is read once.
_CHAIN = re.compile(rf"(?:{_BEFORE}|(?<=%40)){_LOCALS}(?:{_DOT}{_LOCALS})*+", re.I)
_HOST = rf"{_PART}(?:\.{_PART})*(?:{_DOT}{_PART}(?:\.{_PART})*)++"
#: What makes a local part a disguised address. Its "at" is bracketed or spaced. A spoken "at" needs a
#: disguised dot after it, or a local part that no word has, since "at" followed by a full stop or a
#: site's name is prose.
_AT_HOST = re.compile(
    rf"(?P<at>{_AT})(?P<host>{_HOST})"
    rf"|(?P<at2>\s*[\[({{<]\s*(?:{_AT_WORD}|@)\s*[\])}}>]\s*)(?P<host2>{_PART}(?:\.{_PART})+)"
    rf"|(?P<at3>@)(?P<host3>{_HOST})"
    rf"|(?<=[A-Za-z0-9])(?P<at4>%40|&#0*64;|&#x0*40;|&commat;)(?P<host4>{_PART}(?:\.{_PART})+)",
    re.I,
)
_PLAIN_HOST = re.compile(rf"{_BEFORE}(?P<local>(?=[A-Za-z]+[._+0-9])[A-Za-z0-9._%+-]*[A-Za-z0-9])(?P<at>\s+(?:{_AT_WORD})\s+)(?P<host>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?-i:[a-z]{{2,}}))", re.I)
_DOTS = re.compile(_DOT, re.I)
#: An address whose signs are words between underscores or hyphens.
_JOINED_CHAIN = re.compile(r"(?<![A-Za-z0-9.+])[A-Za-z0-9.+]++(?:([_-])dot\1[A-Za-z0-9.+]+)*+", re.I)
_JOINED_HOST = re.compile(r"([_-])at\1[A-Za-z0-9]+(?:([_-])dot\2[A-Za-z0-9]+)++", re.I)
_JOINT = re.compile(r"([_-])(?:(at)|dot)\1", re.I)
_AT_HINT = re.compile(rf"[\[({{<]\s*(?:{_AT_WORD}|@|{_DOT_WORD}|\.)\s*[\])}}>]|\s(?:{_DOT_WORD})\s|[_-](?:at|dot)[_-]|(?:[0-9]|[._+][a-z0-9]+)\s+(?:{_AT_WORD})\s")
_IP_DISGUISED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: Letters that stand for digits, in tokens of digits.
_LETTER_DIGITS = str.maketrans("OoIl|", "00111")
_NEAR_DIGITS = re.compile(r"(?<![A-Za-z0-9|])(?=[OoIl|]*[0-9])[0-9OoIl|]*[OoIl|][0-9OoIl|]*(?![A-Za-z0-9|])|(?<=\+)[OoIl|](?=[ (])")


class Tape:
    """A rewritten text; ``start[k]``..``end[k]`` is the source span of its character k."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ascending, disjoint spans of this tape; every character of a replacement stands
        for the whole span it replaces."""
        out, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[last:a], new]
            starts += [self.start[last:a], np.full(len(new), self.start[a])]
            ends += [self.end[last:a], np.full(len(new), self.end[b - 1])]
            last = b
        out.append(self.text[last:])
        starts.append(self.start[last:])
        ends.append(self.end[last:])
        return Tape("".join(out), np.concatenate(starts), np.concatenate(ends))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _look_alikes(tape: Tape) -> Tape:
    edits = []
    for m in _ODD.finditer(tape.text):
        c = m.group()
        new = "" if c in _ZERO_WIDTH else _LOOKS.get(c)
        if new is None:
            digit = unicodedata.digit(c, None)
            new = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if new.isascii():
            edits.append((m.start(), m.end(), new))
    return tape.rewrite(edits) if edits else tape


def _near_digits(tape: Tape) -> Tape:
    edits = [(m.start(), m.end(), m.group().translate(_LETTER_DIGITS)) for m in _NEAR_DIGITS.finditer(tape.text)]
    return tape.rewrite([(a + k, a + k + 1, c) for a, b, new in edits for k, c in enumerate(new) if tape.text[a + k] != c]) if edits else tape


def _spelled_digits(tape: Tape, within=lambda a, b: False) -> Tape:
    """Spelled digits become digits; what stands between two of them goes, so that they join. A run
    has two spelled digits at least and doesn't go on from a plain identifier (``within``)."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        words = [w for w in _ONE_WORD.finditer(tape.text, m.start(), m.end()) if w.group(1) or w.group(2)]
        if sum(w.group(2) is not None for w in words) < 2 or within(*tape.source(m.start(), m.start() + 1)):
            continue
        for w in words:
            if w.group(1):
                edits.append((*w.span(1), "+"))
            if w.group(2):
                edits.append((*w.span(2), _NUMBER[w.group(2).lower()]))
                if w.group(3):
                    edits.append((*w.span(3), ""))
    return tape.rewrite(edits) if edits else tape


def _chained(text: str, chain: re.Pattern, rest: re.Pattern):
    """(start of the chain, match of ``rest`` right after it), one after another. A chain that nothing
    follows is left behind whole."""
    at = 0
    while m := chain.search(text, at):
        r = rest.match(text, m.end())
        if r:
            yield m.start(), r
        at = (r or m).end()


def _addresses(tape: Tape) -> Tape:
    edits = []
    for start, m in _chained(tape.text, _CHAIN, _AT_HOST):
        k = next(k for k in ("", "2", "3", "4") if m.group("at" + k) is not None)
        for a, b in ((start, m.start()), m.span("host" + k)):
            edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(tape.text, a, b)]
        edits.append((*m.span("at" + k), "@"))
    edits += [(*m.span("at"), "@") for m in _PLAIN_HOST.finditer(tape.text)]
    edits += [(*j.span(), "@" if j.group(2) else ".") for start, m in _chained(tape.text, _JOINED_CHAIN, _JOINED_HOST) for j in _JOINT.finditer(tape.text, start, m.end())]
    for m in _IP_DISGUISED.finditer(tape.text):
        edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(tape.text, *m.span())]
    kept, last = [], 0
    for a, b, new in sorted(set(edits)):
        if a >= last:
            kept.append((a, b, new))
            last = b
    return tape.rewrite(kept) if kept else tape


#: Two spelled digits in a row, in lower case: cheap, and in every run of four.
_SPOKEN = re.compile(rf"(?:[ ,.+(\-]|^)(?:{_WORDS})[ ,.\-]+(?:{_WORDS}|[0-9]|dot |punkt |point |punto )|[0-9][ ,.\-]+(?:{_WORDS})[ ,.\-]", re.M)
_AT_SIGNS = ("(", "[", "{", "<", "_at", "-at", " dot ", "\tdot", "\ndot", " at ", " punkt ", " point ", " punto ", " arroba ", " arobase ", "%40", "&#", "&commat")
_LETTER_HINT = re.compile(r"[0-9][OoIl|]|[OoIl|][0-9]|\+[OoIl|][ (]")
_CODED = ("%40", "&#", "&commat")


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers seen only after rewriting, in source code points: none within a plain one, but
    they may hold one (a plain match can be a piece of a disguised identifier)."""
    odd = not text.isascii() and _ODD.search(text)
    small = text.lower()
    letters = _LETTER_HINT.search(text)
    spoken = _SPOKEN.search(small)
    signs = any(x in small for x in _AT_SIGNS) and (_AT_HINT.search(small) or any(x in small for x in _CODED))
    if not (odd or letters or spoken or signs):
        return []
    tape = Tape(text)
    if odd:
        tape = _look_alikes(tape)
    if letters or odd:
        tape = _near_digits(tape)
    starts, reach = [a for _, a, _ in base], list(accumulate((b for *_, b in base), max))

    def within(a: int, b: int) -> bool:
        k = bisect_right(starts, a)
        return k > 0 and reach[k - 1] >= b

    tape = _addresses(_spelled_digits(tape, within))
    found = ((kind, *tape.source(a, b)) for kind, a, b in base_spans(tape.text))
    return [(kind, a, b) for kind, a, b in found if not within(a, b)]


def all_spans(text: str) -> tuple[list, list]:
    """(plain spans, plain and disguised spans), each by start, then kind."""
    base = base_spans(text)
    more = disguised_spans(text, base)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _spans(batches):
    for batch in batches:
        cols = [[] for _ in range(8)]
        for value in batch.column(1):
            base, every = all_spans(value.as_py() or "")
            for k, kind in enumerate(KINDS):
                cols[k].append(sum(s[0] == kind for s in base))
            cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols[5].append(_joined(every))
            cols[6].append(len(every) - len(base))
            cols[7].append([{"kind": s[0], "start": s[1], "end": s[2]} for s in every])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64()), pa.array(cols[7], _FOUND)],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised", "found"],
        )


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_disguised long, found array<struct<kind:string,start:long,end:long>>"
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every row: counts and digest of the plain spans, all spans as text and as
    an array. A null or empty text has no spans. Rows, repeats and null identifiers are kept."""
    short_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_spans, _SCHEMA)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, every plain or disguised span in ``text_col`` replaced by its
    kind in brackets. Null texts stay null."""
    short_batches(docs.sparkSession)
    fields, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for v in batch.column(at):
                text = v.as_py()
                texts.append(text if text is None else mask(text, all_spans(text)[1]))
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, fields)
