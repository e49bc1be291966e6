"""Main text of web pages by union-free wrappers inferred for each host.

A page is a stream of tags and texts; inline tags belong to the text around them. Its stream is
first a wrapper of its own: adjacent repeats are folded into repeated groups and texts become
slots. Wrappers of one host are then aligned with one another again and again; what only one side
has becomes an optional group, what repeats a repeated group, so the result is a regular
expression without unions. Only distinct wrappers are aligned, in groups of bounded size that are
merged in rounds, so a host's page count doesn't matter. Slot statistics over all pages (text,
link text, whether a slot's text ever changes) then tell the article's slots from menus, notices and
other template parts, and every page is read through its host's wrapper. What an element is called
is weak evidence: an element named like a side part stands all the same if it holds at least as much
plain text as what lies beside it, or four times as much where the name is its main word. A host may have several layouts: a page takes the best of the host's article regions that
it has.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import short_batches
from plumbline.plans.shared import materialize

#: Distinct wrappers of a host that one task aligns at most (about).
FAN_IN = 128
_DEPTH = 120
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|noscript|template|iframe|svg|textarea|select|title|object)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_BLOCKS = frozenset(
    "html body head main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend blockquote pre figure figcaption address details summary dialog hr center menu button label option video audio picture canvas".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
_NO_P = frozenset("main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol dl table form fieldset blockquote pre figure address details hr center menu".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_NAME = re.compile(r"[a-z]+")
_OFF_TAGS = frozenset("footer aside form address".split())
#: Whatever their size, no article.
_NEVER_TAGS = frozenset("head nav menu fieldset legend button label option dialog".split())
_NEVER_WORDS = frozenset("comments commentlist respond replies disqus cookie cookies consent gdpr newsletter advertisement advertising adverts".split())
_OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner menu nav navbar navigation sidebar side rail footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login social share sharing related recommended recommendations more teaser comment comments commentlist respond replies disqus breadcrumb breadcrumbs pagination pager pages widget search copyright legal disclaimer toolbar tags skip hidden contentinfo complementary dialog author byline meta paywall".split()
)
_MAIN_WORDS = frozenset("article main post entry content story articlebody body text".split())


class Node:
    __slots__ = ("key", "children")

    def __init__(self, key: str):
        self.key, self.children = key, []


def _key(tag: str, attributes: str) -> str:
    """Tag and the letters of class, id, role and itemprop: what a template, not a page, chose. Of
    more than eight words, later ones stay if they tell what an element is."""
    if not attributes or "=" not in attributes:
        return tag
    words = []
    for name, value in _ATTR.findall(attributes):
        words += ["hidden"] if name.lower() == "hidden" else _NAME.findall(value.lower())
    words = list(dict.fromkeys(words))
    return ".".join([tag, *words[:8], *(w for w in words[8:] if w in _OFF_WORDS or w in _MAIN_WORDS)])


def parse(page: str) -> Node:
    """The tree of block elements; a text is a child (text, length of its link text). Elements below
    the greatest depth that have text lie beside each other there, and what is in one that isn't the
    article's lies in it."""
    root = Node("html")
    stack, texts, link, linked, at = [("html", root)], [], 0, 0, 0
    opened: dict[str, int] = {}

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            tag, node = stack[-1]
            if len(stack) > _DEPTH:
                beside = stack[_DEPTH - 1][1].children
                if not beside or beside[-1] is not node:
                    if node.children:
                        node = Node(node.key)
                        stack[-1] = tag, node
                    beside.append(node)
            node.children.append((text, min(linked, len(text))))
        texts.clear()
        linked = 0

    def cut(k):
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            texts.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag not in _BLOCKS:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br":
                texts.append(" ")
            continue
        flush()
        link = 0
        if tag == "html" or tag == "body":
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k][0] == tag:
                    cut(k)
                    break
            continue
        if tag in _NO_P and stack[-1][0] == "p":
            cut(-1)
        if tag in _ENDS and any(opened.get(t) for t in _ENDS[tag][0]):
            closes, stops = _ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    cut(k)
                    break
                if stack[k][0] in stops:
                    break
        if tag == "main" or tag == "article" or (tag == "div" and stack[-1][0] == "head"):
            while len(stack) > 1 and stack[-1][0] == "head":
                cut(-1)
        if tag not in _VOID:
            node = Node(_key(tag, m.group(4)))
            if len(stack) < _DEPTH:
                stack[-1][1].children.append(node)
            elif len(stack) > _DEPTH and _off((stack[-1][1].key,)):
                node = Node(stack[-1][1].key)
            stack.append((tag, node))
            opened[tag] = opened.get(tag, 0) + 1
    texts.append(page[at:])
    flush()
    return root


# -- wrappers ------------------------------------------------------------------------------------
# A wrapper is nested lists: [key, quantifier, children] for an element, ["#", quantifier] for a
# text slot, ["()", quantifier, members] for a repeated group of several members.


def _of(node) -> list:
    if isinstance(node, tuple):
        return ["#", "1"]
    return [node.key, "1", fold([_of(c) for c in node.children])]


def _name(item) -> str:
    return item[0] if item[0] != "()" else "(" + " ".join(map(_name, item[2])) + ")"


def _wider(a: str, b: str) -> str:
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return "*" if many and none else "+" if many else "?" if none else "1"


def _merge(a: list, b: list) -> list:
    """One item that stands for both; they have the same name."""
    q = _wider(a[1], b[1])
    if a[0] == "#":
        return ["#", q]
    if a[0] == "()":
        return ["()", q, [_merge(x, y) for x, y in zip(a[2], b[2])]]
    return [a[0], q, align(a[2], b[2])]


def fold(items: list) -> list:
    """Adjacent repeats, of one item or of two or three in turn, become repeated groups."""
    items = list(items)
    for width in (1, 2, 3):
        k = 0
        while k + 2 * width <= len(items):
            one, two = items[k : k + width], items[k + width : k + 2 * width]
            if [_name(x) for x in one] != [_name(x) for x in two] or (width == 1 and one[0][0] == "#"):
                k += 1
                continue
            both = [_merge(x, y) for x, y in zip(one, two)]
            if width == 1:
                both[0][1] = "*" if both[0][1] in "?*" else "+"
                items[k : k + 2] = both
                continue
            items[k : k + 2 * width] = [["()", "+", both]]
            group = _name(items[k])
            while k + 1 + width <= len(items) and "(" + " ".join(_name(x) for x in items[k + 1 : k + 1 + width]) + ")" == group:
                items[k][2] = [_merge(x, y) for x, y in zip(items[k][2], items[k + 1 : k + 1 + width])]
                del items[k + 1 : k + 1 + width]
    return items


def _optional(item: list) -> list:
    return [item[0], "*" if item[1] in "+*" else "?", *item[2:]]


def _common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. A row of the table is one whole number, a bit for
    each entry of ``right`` (zero: the entry adds to the length so far), so long streams cost little."""
    where: dict[str, int] = {}
    for k, name in enumerate(right):
        where[name] = where.get(name, 0) | 1 << k
    full = (1 << len(right)) - 1
    row, rows = full, []
    for name in left:
        hit = row & where.get(name, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    out, i, j = [], len(left), len(right)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def align(a: list, b: list) -> list:
    """The wrapper of both streams: the longest common run of names is kept in order, and what only
    one has between two of them becomes optional."""
    left, right = [_name(x) for x in a], [_name(x) for x in b]
    if left == right:
        return [_merge(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in [*_common(left, right), (len(a), len(b))]:
        out += map(_optional, a[i:p])
        out += map(_optional, b[j:q])
        if p < len(a):
            out.append(_merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def infer(page: str) -> list:
    """The wrapper of one page."""
    return _of(parse(page))


def merge_all(wrappers: list[list]) -> list:
    """The wrapper of them all, aligned one after another in a fixed order."""
    out, *rest = sorted(wrappers, key=lambda w: (len(json.dumps(w)), json.dumps(w)))
    for w in rest:
        out = _merge(out, w)
    return out


def expression(item: list) -> str:
    """The wrapper as a regular expression over tags, for people to read."""
    q = "" if item[1] == "1" else item[1]
    if item[0] == "#":
        return "#" + q
    inner = " ".join(map(expression, item[2]))
    return f"({inner}){q}" if item[0] == "()" else f"<{item[0]}>{'(' + inner + ')' if inner else ''}{q}"


def read(node: Node, wrapper: list):
    """(slot, text, link length) of every text in page order, a slot being its path through the
    wrapper. A text that the wrapper has no slot for has a path that ends in -1."""
    out = []

    def flat(items, path):
        for k, item in enumerate(items):
            if item[0] == "()":
                yield from flat(item[2], (*path, k))
            else:
                yield (*path, k), item

    def visit(node, items, path, known):
        slots = list(flat(items, path))
        of_name: dict[str, list[int]] = {}
        for k, (_, item) in enumerate(slots):
            of_name.setdefault(item[0], []).append(k)
        at = 0
        for child in node.children:
            name = "#" if isinstance(child, tuple) else child.key
            ks = of_name.get(name)
            # The next slot of that name, or else the first.
            k = ks[bisect_left(ks, at) % len(ks)] if ks else None
            if k is not None:
                at = k
            here, inner = (slots[k][0], slots[k][1][2] if name != "#" else []) if k is not None else ((*path, -1), [])
            if name == "#":
                out.append((here, child, known))
            else:
                visit(child, inner, here, (*known, child.key))

    visit(node, wrapper[2], (), ())
    return out


# -- which slots are the article -----------------------------------------------------------------


_WEAK, _STRONG, _NEVER = 1, 2, 3
#: Plain text of an element with a strong mark, by that of all around it, and characters a page, from
#: which on it stands; text in an article element around it counts four times.
_OUTVOTES, _ARTICLE_CHARS = 4, 140


def _mark(key: str, inside: bool) -> int:
    """What an element's tag and words say against it: 0 nothing, a weak mark where words of a side part
    are the lesser part of its words, a strong one where they are half or more, or its tag is one."""
    tag, *words = key.split(".")
    if tag in _NEVER_TAGS:
        return _NEVER
    if tag in _OFF_TAGS or (tag == "header" and not inside):
        return _STRONG
    if tag in ("article", "main"):
        return 0
    off = sum(w in _OFF_WORDS for w in words)
    if not off or 2 * off < len(words):
        return _WEAK if off else 0
    return _NEVER if any(w in _NEVER_WORDS for w in words) else _STRONG


def _marks(known: tuple[str, ...]):
    """(mark, depth) of every element around a slot that has a mark."""
    inside = False
    for depth, key in enumerate(known, 1):
        mark = _mark(key, inside)
        if mark:
            yield mark, depth
        inside = inside or key.split(".")[0] in ("article", "main")


def _off(known: tuple[str, ...], standing: frozenset | set = frozenset()) -> bool:
    """Whether an element around a slot has a mark, and doesn't stand in spite of it."""
    return any(mark == _NEVER or known[:depth] not in standing for mark, depth in _marks(known))


def _shares(texts) -> dict[tuple, tuple[int, int]]:
    """For every marked path of a page that may stand: its own plain text, and the plain text that
    speaks against it. ``texts``: (tags around a text, plain characters)."""
    held: dict[tuple, int] = {}
    weak: dict[tuple, tuple] = {}
    named = 0
    for known, plain in texts:
        strong, last = (), None
        for mark, depth in _marks(known):
            if mark == _WEAK:
                last = known[:depth]
            else:
                strong, last = (known[:depth] if mark == _STRONG else None), None
                if strong is None:
                    break
        if strong is None:
            continue
        held[strong] = held.get(strong, 0) + plain
        if last:
            own, _ = weak.get(last, (0, ()))
            weak[last] = own + plain, strong
        if not strong and any(k.split(".")[0] in ("article", "main") for k in known):
            named += plain
    out = {p: (own, held[strong] - own) for p, (own, strong) in weak.items()}
    for p, own in held.items():
        if p:
            out[p] = own, 3 * named + sum(n for q, n in held.items() if len(q) < len(p) and p[: len(q)] == q)
    return out


def _stands(path: tuple[str, ...], pages: int, own: int, against: int) -> bool:
    """Whether a marked path holds text like an article's, on all pages that have it together."""
    mark = next(m for m, depth in _marks(path) if depth == len(path))
    return own >= max(against, 1) if mark == _WEAK else own > _OUTVOTES * against and own >= _ARTICLE_CHARS * pages


def _within(known: tuple, region: tuple) -> bool:
    return known[: len(region)] == region


def _totals(weights) -> tuple[dict, dict]:
    """Characters under every path of (tags around a slot, characters), and the paths whose tag or
    words name an article: 2 for an article element, 1 for others."""
    total: dict[tuple, int] = {}
    marks: dict[tuple, int] = {}
    for known, chars in weights:
        for depth in range(len(known) + 1):
            total[known[:depth]] = total.get(known[:depth], 0) + chars
        for depth, key in enumerate(known, 1):
            tag, *words = key.split(".")
            if tag in ("article", "main") or any(w in _MAIN_WORDS for w in words):
                marks[known[:depth]] = 2 if tag == "article" else 1
    return total, marks


def _regions(weights) -> tuple[list, dict]:
    """(path, mark) of the regions that may be the article, best first: all sure marked ones, or the
    smallest unmarked one (mark 0) that holds nearly all of the text; and the marked paths that are
    beside every sure one, which an article of a rarer layout may have."""
    total, marks = _totals(weights)
    top = max(total.values())
    sure = [r for r in marks if total[r] >= 0.25 * top]
    if sure:
        best = sorted(sure, key=lambda r: (marks[r] == 2, total[r], -len(r)), reverse=True)
        return [(r, marks[r]) for r in best], {r: m for r, m in marks.items() if not any(_within(r, x) or _within(x, r) for x in sure)}
    region = ()
    while True:
        below = max((r for r in total if len(r) == len(region) + 1 and r[: len(region)] == region), key=lambda r: total[r], default=None)
        if below is None or total[below] < 0.8 * total[region] or below[-1].split(".")[0] in ("p", "li", "td", "h1"):
            return [(region, 0)], {}
        region = below


def choose(stats: dict[tuple, tuple], standing: frozenset | set = frozenset()) -> tuple[dict, list, dict]:
    """Slots that may be the article's, with the tags around them, and the host's regions, best
    first, and those of rarer layouts. ``stats``: by slot (tags around it, distinct pages as far as
    three, characters, link characters, whether its text is the same on every page). ``standing``: the
    marked paths that hold an article's text. Text that several pages have alike is the template's,
    unless it is four times the text that changes: then pages are near copies of each other."""
    good = {s: v for s, v in stats.items() if not _off(v[0], standing)}
    alike = {s for s, v in good.items() if v[4] and v[1] > 1 and not any(k.split(".")[0] in ("article", "main") for k in v[0])}
    plain = lambda found: sum(good[s][2] - good[s][3] for s in found)
    if plain(alike) > _OUTVOTES * plain(s for s, v in good.items() if not v[4]):
        alike = set()
    good = {s: v for s, v in good.items() if s not in alike and not (v[3] > 0.6 * v[2] and v[0][-1:] != ("p",))}
    if not good:
        return {}, [], {}
    return {s: v[0] for s, v in good.items()}, *_regions([(v[0], v[2]) for v in good.values()])


def _holds(node: Node, region: tuple) -> bool:
    """Whether a page has an element at this path."""
    if not region:
        return True
    return any(_holds(c, region[1:]) for c in node.children if isinstance(c, Node) and c.key == region[0])


def article(tree: Node, found: list, good: dict, regions: list, rarer: dict) -> list[str]:
    """The article's texts of one page. ``found``: (slot, text, tags around it). The page takes the
    best of its host's regions that it has, if that has a quarter of the text of any region beside
    it with the same mark; a page that has none of them is judged by its own text."""
    texts = [(good[slot], words) for slot, words, _ in found if slot in good]
    if not texts:
        return []
    size, _ = _totals([(known, len(words)) for known, words in texts])
    here = [r for r in regions if _holds(tree, r[0])]
    if not here:
        here, rarer = _regions([(known, len(words)) for known, words in texts])
    here = [*here, *((r, mark) for r, mark in rarer.items() if r in size)]
    for region, mark in here:
        n = size.get(region, 0)
        if n and all(n >= 0.25 * size.get(r, 0) for r, m in here if m == mark and not _within(region, r)):
            return [words for known, words in texts if _within(known, region)]
    return []


# -- on the cluster ------------------------------------------------------------------------------


def _prepared(pages: DataFrame, id_col, url_col, html_col) -> DataFrame:
    url = F.col(url_col).cast("string")
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )


def _digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


_SUMS = "pages long, chars long, links long, low long, high long, least long, most long, marks decimal(38,0), squares decimal(38,0)"
_SEEN = f"host string, form string, slot string, known string, {_SUMS}"
_COLUMNS = [c.split()[0] for c in _SUMS.split(", ")]
_OF_HOST = f"host string, slot string, known string, {_SUMS}"
#: In the place of a slot: a row that says a wrapper, and one that weighs a marked path.
_SAYS, _WEIGHS = "says", "weighs"


def _observe(batches):
    """Statistics of each distinct single-page wrapper, summed within a batch; rows name it by a
    128-bit hash, and one row says it. A page's mark is the digest of its texts that may be an
    article's: copies have the same. A row that weighs a marked path has its own text as chars and the
    text that speaks against it as links."""
    for batch in batches:
        sums: dict[tuple, list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            tree = parse(page.as_py())
            pattern = _of(tree)
            text, own = json.dumps(pattern, separators=(",", ":")), {}
            form = xxhash.xxh3_128_hexdigest(text)
            for slot, (words, links), known in read(tree, pattern):
                own.setdefault((slot, known), []).append((words, links))
            mark = _digest("\n".join(w for (_, known), found in own.items() if all(m == _WEAK for m, _ in _marks(known)) for w, _ in found))
            sums.setdefault((host, form, _SAYS, text), [0] * 9)[0] += 1
            for path, (inside, against) in _shares((known, sum(len(w) - n for w, n in found)) for (_, known), found in own.items()).items():
                s = sums.setdefault((host, form, _WEIGHS, "/".join(path)), [0] * 9)
                s[0], s[1], s[2] = s[0] + 1, s[1] + inside, s[2] + against
            for (slot, known), found in own.items():
                digest = _digest("\n".join(w for w, _ in found))
                s = sums.setdefault((host, form, json.dumps(slot), "/".join(known)), [0, 0, 0, digest, digest, mark, mark, 0, 0])
                s[0] += 1
                s[1] += sum(len(w) for w, _ in found)
                s[2] += sum(n for _, n in found)
                s[3], s[4] = min(s[3], digest), max(s[4], digest)
                s[5], s[6] = min(s[5], mark), max(s[6], mark)
                s[7] += mark
                s[8] += mark * mark
        yield _batch([(*k, *v) for k, v in sums.items()], _SEEN)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "decimal(38,0)": pa.decimal128(38, 0)}


def _batch(rows, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([Decimal(r[k]) if "(" in t else r[k] for r in rows], _TYPES[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _merge_group(table: pa.Table) -> pa.Table:
    whole = merge_all([json.loads(w) for w in set(table.column("pattern").to_pylist())])
    return pa.table({"host": table.column("host")[:1].combine_chunks(), "pattern": pa.array([json.dumps(whole, separators=(",", ":"))])})


def infer_wrappers(patterns: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, pattern): one wrapper for each host, from distinct (host, pattern). A round merges
    groups of about ``fan_in`` wrappers, so no task ever holds all of a large host's."""
    while True:
        sizes = patterns.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= fan_in:
            return materialize(patterns.groupBy("host").applyInArrow(_merge_group, "host string, pattern string"), "wrappers")
        dealt = patterns.join(materialize(sizes, "wrapper-sizes"), "host")
        group = F.pmod(F.xxhash64("pattern"), F.ceil(F.col("n") / F.lit(fan_in)))
        patterns = materialize(dealt.groupBy("host", group.alias("part")).applyInArrow(_merge_group, "host string, pattern string").distinct(), "wrappers-round")


def _as_tree(item: list) -> Node:
    """A wrapper as a page that has every part of it once."""
    node = Node(item[0])

    def add(items):
        for x in items:
            if x[0] == "()":
                add(x[2])
            else:
                node.children.append(("x", 0) if x[0] == "#" else _as_tree(x))

    add(item[2])
    return node


@lru_cache(512)
def _slots_between(pattern: str, wrapper: str) -> dict:
    """Slots of a single page's wrapper to slots of its host's, in the order of both."""
    own, whole = json.loads(pattern), json.loads(wrapper)
    tree = _as_tree(own)
    return {json.dumps(a): json.dumps(b) for (a, _, _), (b, _, _) in zip(read(tree, own), read(tree, whole))}


def _translate(batches):
    """Slots of one page's wrapper, with their sums, as slots of its host's."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            to = _slots_between(r["pattern"], r["wrapper"])
            rows += [(r["host"], x["slot"] if x["slot"] == _WEIGHS else to.get(x["slot"], "[-1]"), x["known"], *(x[c] for c in _COLUMNS)) for x in r["slots"]]
        yield _batch(rows, _OF_HOST)


def _up_to_three(pages: int, least: int, most: int, marks: int, squares: int) -> int:
    """How many different marks there are, three standing for more. The sum of (mark - least) x
    (most - mark) is zero unless a mark lies between the two."""
    if least == most:
        return 1
    return 3 if (least + most) * marks - squares - pages * least * most else 2


@lru_cache(256)
def _rules(stats: str) -> tuple[dict, list, dict]:
    found, standing = {}, set()
    for slot, known, pages, chars, links, same, least, most, marks, squares in json.loads(stats):
        path = tuple(known.split("/")) if known else ()
        if slot == _WEIGHS:
            if _stands(path, pages, chars, links):
                standing.add(path)
            continue
        distinct = _up_to_three(pages, least, most, marks, squares)
        found[(tuple(json.loads(slot)), known)] = (path, distinct, chars, links, bool(same))
    return choose(found, standing)


@lru_cache(256)
def _loaded(wrapper: str) -> list:
    return json.loads(wrapper)


def _extract(batches):
    for batch in batches:
        texts = []
        for page, wrapper, stats in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if wrapper is None or stats is None:
                texts.append("")
                continue
            tree = parse(page.as_py())
            found = [((slot, "/".join(known)), words, known) for slot, (words, _), known in read(tree, _loaded(wrapper))]
            texts.append(" ".join(article(tree, found, *_rules(stats))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _summed() -> list:
    """Aggregates of all columns of ``_SUMS``."""
    how = {"low": F.min, "least": F.min, "high": F.max, "most": F.max}
    return [how.get(c, F.sum)(c).alias(c) for c in _COLUMNS]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's blocks in page order, joined by one
    space. A null or empty page, or one without an article, has an empty text. Pages without a
    readable host share the empty host's wrapper. Repeated rows and null identifiers are kept."""
    short_batches(pages.sparkSession)
    chosen = _prepared(pages, id_col, url_col, html_col)
    seen = chosen.select("host", "html").mapInArrow(_observe, _SEEN).groupBy("host", "form", "slot", "known")
    seen = materialize(seen.agg(*_summed()), "wrapper-stats")
    forms = seen.filter(F.col("slot") == _SAYS).select("host", "form", F.col("known").alias("pattern"))
    wrappers = infer_wrappers(forms.select("host", "pattern").distinct()).withColumnRenamed("pattern", "wrapper")
    # A row for each distinct page wrapper, with the sums of its slots: as long as one page's template.
    of_form = seen.filter(F.col("slot") != _SAYS).groupBy("host", "form").agg(F.collect_list(F.struct("slot", "known", *_COLUMNS)).alias("slots"))
    met = of_form.join(forms, ["host", "form"]).join(wrappers, "host").select("host", "pattern", "wrapper", "slots")
    summed = met.mapInArrow(_translate, _OF_HOST).groupBy("host", "slot", "known").agg(*_summed())
    # A host's row holds its wrapper's slots: bounded by the template, not by the pages.
    same = (F.col("low") == F.col("high")).cast("int")
    numbers = ["pages", "chars", "links", same, "least", "most", "marks", "squares"]
    row = F.concat(F.lit("["), F.concat_ws(",", *(F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("slot", "known")), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in numbers)), F.lit("]"))
    stats = summed.groupBy("host").agg(F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list(row))), F.lit("]")).alias("stats"))
    rules = materialize(wrappers.join(stats, "host"), "wrapper-rules")
    return chosen.join(rules, "host", "left").select("page_id", "url", "html", "wrapper", "stats").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
