"""Wrappers, nearest neighbours, tool calls and the pipeline, by brute force and on odd rows."""

import html
import json
import random
import re
import time

import numpy as np
import pytest

from plumbline.llm import additive, registry, toolcalls, wrappers
from tests.helpers import check, duck

# -- 3 ---------------------------------------------------------------------------------------------


def test_main_text_of_the_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in wrappers.extract_main_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", p.html).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def site(k, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style></head><body><header class="site-header"><a href=/>Home {k}</a></header>
    <nav><ul><li><a href=a>News</a><li><a href=b>Sport</a></ul></nav>{extra}<div class="cookie-notice">We use cookies {k}</div>
    <div class="post-{k} content"><h2>Head {k}</h2>{body}</div><aside class=sidebar><p>Popular {k}</aside>
    <form><label>Mail</label><input><button>Go</button></form><section id="comments"><p>First! {k}</p></section>
    <script>var x = "<p>no</p>";</script><footer><p>&copy; Site {k}</footer></body></html>"""


def test_pages_without_article_tags(spark):
    bodies = {1: "<p>One &amp; <a href=x>two</a></p><p>three", 2: "<p>Uno<ul><li>dos<li>tres</ul>", 3: "<p>Eins</p><blockquote>zwei<br>drei</blockquote>", 4: "<p>Only</p>"}
    want = {1: "Head 1 One & two three", 2: "Head 2 Uno dos tres", 3: "Head 3 Eins zwei drei", 4: "Head 4 Only"}
    rows = [(k, "http://h.example/p", site(k, b, "<div class=ad>Buy</div>" if k % 2 else "")) for k, b in bodies.items()]
    got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


LAYOUTS = {
    "classes": ("<article class='post news'>{}</article>", "<article class='post sports'>{}</article>"),
    "nested": ("<main><article>{}</article></main>", "<article>{}</article>"),
    "marked and not": ("<div class=content>{}</div>", "<article>{}</article>"),
    "unmarked": ("<div class=a><div class=b>{}</div></div>", "<div class=z>{}</div>"),
    "with the other's teaser": ("<article class=news>{}</article>", "<article class=sports>{}</article><article class=news><p>Tease</article>"),
}


@pytest.mark.parametrize("layouts", LAYOUTS.values(), ids=LAYOUTS)
@pytest.mark.parametrize("minority", [1, 5, 10])
def test_pages_of_two_layouts_on_one_host(spark, layouts, minority):
    rows, want = [], {}
    for k in range(20):
        words = f"Head {k}", f"{k} one two three four five six seven eight nine ten"
        body = layouts[k < minority].format(f"<h2>{words[0]}</h2><p>{words[1]}</p>")
        rows.append((k, "http://h.example/p", f"<body><nav><a href=x>N {k}</a></nav>{body}<footer>F {k}</footer></body>"))
        want[k] = " ".join(words)
    got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


@pytest.mark.parametrize("copies", [1, 3, 50])
def test_copies_of_a_page_are_no_template(spark, copies):
    bodies = {1: "<p>One</p>", 2: "<p>Uno</p>", 3: "<p>Eins</p><blockquote>zwei</blockquote><h3>drei</h3>", 4: "<p>Only</p>"}
    want = {1: "Head 1 One", 2: "Head 2 Uno", 3: "Head 3 Eins zwei drei", 4: "Head 4 Only"}
    rows = [(k, "http://h.example/p", site(k, b + "<h4>Thanks for reading</h4>")) for k, b in bodies.items()]
    rows += [rows[2]] * (copies - 1)
    got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows) and {(r.page_id, r.text) for r in got} == set(want.items())


NAMES = ["content with-sidebar", "layout-has-footer", "more-stories-body", "main-content notice-free", "share-price-report", "story", "x7", ""]
WORDS = "river stone window letter garden market winter bridge copper lantern harbour meadow".split()


def prose(g, words):
    return " ".join(g.choice(WORDS) for _ in range(words)).capitalize() + "."


def named_page(g, name, k, words=40):
    """(html, its article): an article in an element of that name among parts that are none."""
    head, paragraphs = f"Report {k}: " + prose(g, 4), [prose(g, g.randint(words // 2, words)) for _ in range(3)]
    tag = f'<div class="{name}">' if name else "<div>"
    return (
        f"""<html><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>News</a><li><a href=/b>{prose(g, 1)}</a></ul></nav><div class="cookie-notice">We use cookies to improve</div>
        {tag}<h1>{head}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class="sidebar"><p>{prose(g, 6)}</p></div></div>
        <div id="comments"><p>{prose(g, 12)}</p><p>{prose(g, 9)}</p></div><div class="newsletter-signup">Join {prose(g, 3)}</div><footer>Imprint {k}</footer></body></html>""",
        " ".join([head, *paragraphs]),
    )


@pytest.mark.parametrize("pages", [1, 2, 3, 100])
def test_no_article_is_lost_to_its_name(spark, pages):
    """Every name on a host of its own, and all of them as layouts of one host."""
    g, rows, want = random.Random(pages), [], {}
    for h, name in enumerate(NAMES):
        for k in range(pages):
            for host in (f"h{h}", "all"):
                html_, want[len(rows)] = named_page(g, name, len(rows))
                rows.append((len(rows), f"http://{host}.example/{k}", html_))
    got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


def brute_choice(pages):
    """What stands, over pages as lists of (tags around a text, text): every marked path is weighed anew
    over every text of every page that has it."""
    words = lambda key: key.split(".")[1:]
    share = lambda key: sum(w in wrappers._OFF_WORDS for w in words(key)) / max(1, len(words(key)))
    strong = lambda key: key.split(".")[0] in ("aside", "footer", "form") or share(key) >= 0.5
    weak = lambda key: not strong(key) and share(key) > 0
    paths = {known[:d] for page in pages for known, _ in page for d in range(1, len(known) + 1) if strong(known[d - 1]) or weak(known[d - 1])}
    out = set()
    for p in paths:
        own = against = have = 0
        for page in pages:
            here = [(known, len(t)) for known, t in page if known[: len(p)] == p]
            at = lambda known: max((d for d in range(1, len(known) + 1) if strong(known[d - 1])), default=0)
            last = lambda known: max((d for d in range(1, len(known) + 1) if strong(known[d - 1]) or weak(known[d - 1])), default=0)
            if strong(p[-1]):
                mine = [n for known, n in here if at(known) == len(p)]
                against += sum(len(t) for known, t in page if at(known) < len(p) and known[: at(known)] == p[: at(known)]) if mine else 0
            else:
                mine = [n for known, n in here if last(known) == len(p)]
                against += sum(len(t) for known, t in page if known[: at(known)] == p[: at(p)] and at(known) == at(p)) - sum(mine) if mine else 0
            own, have = own + sum(mine), have + bool(mine)
        if have and (own > 4 * against and own >= 140 * have if strong(p[-1]) else own >= max(against, 1)):
            out.add(p)
    return out


def test_what_stands_by_brute_force():
    g = random.Random(8)
    keys = ["div", "div.content.with.sidebar", "div.sidebar", "aside", "form", "div.promo.box.text", "section", "p", "div.footer.bar.of.page"]
    for _ in range(300):
        pages = [[(tuple(g.choice(keys) for _ in range(g.randint(0, 4))), "x" * g.choice([5, 60, 300, 2000])) for _ in range(g.randint(1, 7))] for _ in range(g.randint(1, 4))]
        sums = {}
        for page in pages:
            for p, (own, against) in wrappers._shares((known, len(t)) for known, t in page).items():
                a, b, n = sums.get(p, (0, 0, 0))
                sums[p] = a + own, b + against, n + 1
        assert {p for p, (own, against, n) in sums.items() if wrappers._stands(p, n, own, against)} == brute_choice(pages)


def test_many_differently_named_siblings(spark):
    """Ten thousand siblings of different names beside ten thousand others."""
    rows = [(k, "http://h.example/", "<body><article>" + "".join(f"<div class=x{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}{'yz'[k]}><p>t{j}</p></div>" for j in range(10_000)) + "</article>") for k in range(2)]
    began = time.perf_counter()
    got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == " ".join(f"t{j}" for j in range(10_000)) for r in got) and time.perf_counter() - began < 120


def test_distinct_marks_up_to_three():
    for marks in ([5], [5, 5, 5], [0, 9], [9, 0, 0, 9], [0, 1, 9], [4, 4, 3, 2, 1], [2**32 - 1] * 4 + [2**32 - 2, 0]):
        got = wrappers._up_to_three(len(marks), min(marks), max(marks), sum(marks), sum(m * m for m in marks))
        assert got == min(3, len(set(marks)))


def test_late_words_of_a_class_count():
    many = "flex grow shrink wide tall round dark light bold"
    assert wrappers._off((wrappers._key("div", f" class='{many} sidebar'"),))
    assert wrappers._key("div", f" class='{many} other content'") == "div.flex.grow.shrink.wide.tall.round.dark.light.content"


def test_what_is_nested_too_deep_keeps_its_tags():
    deep = "<div>" * 150
    page = f"<article>{deep}<nav>Menu</nav><p>text</p><aside><p>Advert</aside>{'</div>' * 150}<h2>after</h2></article><p>outside"
    found = wrappers.read(wrappers.parse(page), wrappers.infer(page))
    got = {words: known for _, (words, _), known in found}
    assert got["after"] == ("article", "h2") and got["outside"] == ("p",)
    assert wrappers._off(got["Menu"]) and wrappers._off(got["Advert"]) and not wrappers._off(got["text"])


def test_alignment():
    a = wrappers.infer("<body><nav><ul><li>1<li>2</ul></nav><div class=c><p>x<p>y</div></body>")
    b = wrappers.infer("<body><div class=ad>z</div><div class=c><p>x<table><tr><td>1</table></div></body>")
    both = wrappers.expression(wrappers.merge_all([a, b]))
    assert both == "<html>(<nav>(<ul>(<li>(#)+))? <div.ad>(#)? <div.c>(<p>(#)+ <table>(<tr>(<td>(#)))?))"
    assert wrappers.expression(wrappers.infer("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")) == "<html>(<dl>((<dt>(#) <dd>(#))+))"


def test_merging_in_rounds_gives_one_wrapper(spark):
    rows = [("h", json.dumps(wrappers.infer("<div>" + "<p>x</p>" * (k % 3) + f"<h{k % 6 + 1}>y</h{k % 6 + 1}></div>" + "<ul><li>a</ul>" * (k // 18)))) for k in range(36)]
    found = wrappers.infer_wrappers(spark.createDataFrame(rows, "host string, pattern string").distinct(), fan_in=4).collect()
    assert len(found) == 1
    whole = json.loads(found[0].pattern)
    for _, p in rows:
        own = json.loads(p)
        assert all(slot[-1] != -1 for slot, *_ in wrappers.read(wrappers._as_tree(own), whole))


def test_pages_odd(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a.example/", None, 1), (2, None, "", 1), (None, "no host", "plain text &amp more", 1), (3, "http://a.example/x", "<p>" + "w " * 50_000, 1), (3, "http://a.example/x", "<p>" + "w " * 50_000, 1), (4, "http://b.example/", deep, None), (5, "http://c.example", "<script>only", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").selectExpr("*", "1 AS text", "2 AS pattern", "3 AS n")
    got = wrappers.extract_main_text(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == text[5] == "" and text[None] == "plain text & more" and text[4] == "deep" and text[3] == ("w " * 50_000).strip()
    assert wrappers.extract_main_text(df.limit(0)).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------


def brute_nearest(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    size = np.sqrt((x * x).sum(1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = (x * x[q]).sum(1) / (size * size[q])
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), score[j]) for j in order]
    return out


def moved_vectors(spark, path, copies=4):
    """A larger table: every vector of the test table, and ``copies`` of each moved at random."""
    g = np.random.default_rng(3)
    rows = [(r.vec_id, np.array(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows += [(i + 100_000 * k, v + g.normal(0, 0.6 * v.std(), len(v))) for k in range(1, copies + 1) for i, v in rows]
    spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>").write.parquet(path)


@pytest.mark.parametrize("table", ["/root/testdata/sf0.1", "moved"])
def test_recall(spark, table, tmp_path):
    if table == "moved":
        table = str(tmp_path)
        moved_vectors(spark, f"{table}/embeddings.parquet")
    v = spark.read.parquet(f"{table}/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in v.collect()])
    got = {}
    for r in additive.nearest(v).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = [len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.95
    for q, found in got.items():
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and sorted(found, key=lambda x: (-x[2], x[1])) == found
        true = dict(want[q])
        assert all(abs(true[i] - s) < 1e-12 for _, i, s in found if i in true)


@pytest.mark.parametrize("kind", ["near copies", "wide", "badly fitted", "copies and near copies"])
def test_nearest_is_true_where_codes_do_not_tell(spark, kind, tmp_path):
    """Rows closer than the codes' error, rows that codes of a bounded length can't say, rows unlike the
    fitting sample, groups larger than a shortlist: the answer is brute force's."""
    g = np.random.default_rng(11)
    copies = lambda n, spread: g.normal(size=(3, 48))[g.integers(0, 3, n)] + spread * g.normal(size=(n, 48))
    x = {
        "near copies": lambda: copies(2400, 1e-5),
        "wide": lambda: g.normal(size=(2000, 512)),
        "badly fitted": lambda: np.concatenate([copies(9000, 0.02), g.normal(size=(300, 48))]),
        "copies and near copies": lambda: np.repeat(copies(1200, 1e-5), g.integers(1, 4, 1200), axis=0),
    }[kind]().astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "e"))
    got = {}
    for r in additive.nearest(spark.read.parquet(str(tmp_path / "e"))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5]
        assert [i for _, i, _ in found] == [i for i, _ in want[q]]
        assert all(abs(a - b) < 1e-12 for (*_, a), (_, b) in zip(found, want[q]))


def test_bounds_hold_and_leave_rows_out():
    """No row's cosine is above its bound; where codes fit, most bounds are below the nearest."""
    g = np.random.default_rng(4)
    x = additive.unit(g.normal(size=(40, 32))[g.integers(0, 40, 3000)] + 0.1 * g.normal(size=(3000, 32)))
    books = additive.train(x)
    codes, norms, cos, sin = additive.encode(x, books)
    made = books[np.arange(len(books)), codes].sum(1)
    true, rough = x[:60] @ x.T, x[:60] @ made.T / norms
    most = additive.bounds(rough, cos, sin)
    assert (most >= true).all()
    assert (most < np.sort(true, axis=1)[:, -6:-5]).mean() > 0.9


def test_nearest_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1e30, 1e30]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [0.0, -1.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS block", "3 AS rank", "4 AS score")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in additive.nearest(df).orderBy("query_id", "rank").collect()]
    r = round(0.5**0.5, 6)
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, r), (0, 4, 10, 0.0), (50, 1, 0, r), (50, 2, 1, r), (50, 3, 2, r), (50, 4, 10, -r)]
    assert additive.nearest(df.limit(0)).count() == 0


def test_copies_of_one_vector_go_by_identifier(spark):
    g = np.random.default_rng(0)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(400)] + [(k, g.normal(size=4).tolist()) for k in range(400, 600)]
    got = additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shortlist=8).filter("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_lengths_precision_and_repeated_identifiers(spark):
    """Each length is searched by itself, other vectors of an identifier are rows, doubles stay doubles."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-9]), (1, [0.0, 1.0]), (2, [1.0, 1e-9 * (1 + 1e-6)]), (50, [1.0, 2.0, 3.0]), (3, [3.0, 2.0, 1.0]), (100, [7.0]), (50, [0.5, 1.0])]
    got = [tuple(r) for r in additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = []
    for q, v in rows:
        near = [(i, float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)))) for i, w in rows if len(w) == len(v) and (i, w) != (q, v)]
        if q % 50 == 0:
            want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(near, key=lambda x: (-x[1], x[0])))]
    assert len(got) == len(want) == 9
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-15


# -- 9 ---------------------------------------------------------------------------------------------


def test_tool_calls_oracle(spark, sf):
    check(registry.QUERIES["op9_toolcalls"](spark, sf), duck(sf), registry.ORACLES["op9_toolcalls"])


TOOLS = {"add": {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}, "maxItems": 2}}}}


def test_links_order_and_validation(spark):
    calls = [
        (1, 0, 0, "c1", "add", '{"b": 2.0, "a": 1}', ["c3"]), (1, 0, 1, "c2", "add", '{"a": -1, "b": "x", "z": 0}', None), (1, 2, 0, "c3", "add", '{"a": 1, "b": 1.5, "tags": ["abcd"]}', ["c2", "gone"]),
        (1, 4, 0, "c1", "add", "{}", []), (1, 6, 0, "x", "add", "not json", ["y"]), (1, 6, 1, "y", "sub", "{}", ["x"]), (2, 0, 0, "c1", "add", '{"a":1,"b":1}', []), (None, None, None, None, None, None, None),
    ]
    results = [(1, 1, "c1", "3"), (1, 1, "c1", "3"), (1, 9, "nobody", None), (None, None, None, None)]
    c = spark.createDataFrame(calls, "conv_id long, turn long, part int, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    rows = toolcalls.link_calls(c, r, TOOLS).collect()
    assert len(rows) == len(calls) + len(results)
    got = {(x.conv_id, x.turn, x.part): x for x in rows if x.kind == "call"}
    assert [(got[k].status, got[k].level) for k in ((1, 0, 0), (1, 0, 1), (1, 2, 0), (1, 4, 0), (1, 6, 0), (1, 6, 1), (2, 0, 0), (None, None, None))] == [
        ("linked", 2), ("unanswered", 0), ("unanswered", 1), ("repeated", 2), ("cyclic", None), ("cyclic", None), ("unanswered", 0), ("unanswered", 0)
    ]
    assert got[1, 0, 0].valid and got[1, 0, 0].canonical == '{"arguments":{"a":1,"b":2},"id":"c1","kind":"call","name":"add","status":"linked"}'
    assert got[1, 0, 1].problems == "$.a minimum; $.b type; $.z additionalProperties" and got[1, 2, 0].problems == "$.tags[0] maxLength"
    assert got[1, 4, 0].problems == "$.a required; $.b required" and got[1, 6, 0].problems == "$ not JSON" and got[1, 6, 1].problems == "$ unknown tool"
    assert sorted(x.status for x in rows if x.kind == "result") == ["linked", "linked", "orphan", "orphan"]
    assert toolcalls.link_calls(c.limit(0), r.limit(0), TOOLS).count() == 0


def test_levels_against_brute_force(spark):
    """A long chain, chains that branch and meet, and what hangs on cycles."""
    import random

    g = random.Random(5)
    after = {f"l{k}": [f"l{k - 1}"] if k else [] for k in range(130)}
    after |= {f"d{k}": [f"d{j}" for j in g.sample(range(k), min(k, g.choice([0, 1, 1, 1, 2])))] for k in range(60)}
    after |= {"x0": ["x2"], "x1": ["x0"], "x2": ["x1"], "x3": ["x2"], "x4": ["x3", "l3"], "x5": ["x5"], "m": ["l129", "d59", "gone"]}
    level, rest = {}, dict(after)
    while ready := [k for k, v in rest.items() if all(p in level or p not in after for p in v)]:
        level |= {k: max((level[p] + 1 for p in rest[k] if p in level), default=0) for k in ready}
        rest = {k: v for k, v in rest.items() if k not in level}
    df = spark.createDataFrame([(c, k, v) for c in (1, 2) for k, v in after.items()], "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls._levels(df).collect()}
    assert got == {(c, k): n for c in (1, 2) for k, n in level.items()} and not any(k[1].startswith("x") for k in got)


def test_calls_written_into_messages(spark):
    m = [
        (1, 0, "user", "add, please"), (1, 1, "assistant", 'ok <tool_call>{"id": "k", "name": "add", "arguments": {"a": 1, "b": 2}}</tool_call><tool_call>{"id": "l", "name": "add", "arguments": {"a": 2, "b": 2}, "after": ["k"]}</tool_call>'),
        (1, 2, "tool", '{"tool_call_id": "k", "content": "3"}'), (None, 3, "tool", None), (1, 4, None, None), (1, None, "assistant", None),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS call_id", "'y' AS level", "'z' AS name")
    rows = {(x.kind, x.call_id, x.turn): x for x in toolcalls.link_conversations(df, TOOLS).collect()}
    assert rows["call", "k", 1].status == "linked" and rows["call", "l", 1].level == 1 and rows["call", "l", 1].valid
    assert rows["result", "k", 2].status == "linked" and rows["result", "t0", 1].status == "linked" and rows["call", "t0", 0].valid
    assert toolcalls.link_conversations(df.limit(0)).count() == 0


# -- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages_and_result(spark, tmp_path):
    import corpus_pipeline
    from plumbline.llm import pii, quality
    from tests.llm.test_text_operators import brute_base, brute_groups, brute_quality, check_packing

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    now, kept = docs, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, now, d).write.parquet(out)
        now = spark.read.parquet(out)
        rows = now.collect()
        if k < 3:
            assert now.columns == docs.columns
        if name == "quality":
            model = quality.fit_quality(docs, spark.read.parquet(f"{d}/labels.parquet"))
            scores = {i: brute_quality(model, (r.text or "").encode()) for i, r in kept.items()}
            assert all(abs(x - 0.7) > 1e-3 for x in scores.values())
            good = {i for i, x in scores.items() if x >= 0.7}
            assert {r.doc_id for r in rows} == good and len(good) < len(kept)
        elif name == "near_duplicates":
            # Five words and a similarity of 0.8, by whole shingle sets over all pairs.
            assert {r.doc_id for r in rows} == set(brute_groups([(i, r.text) for i, r in kept.items()])) and len(rows) < len(kept)
        elif name == "personal_data":
            for r in rows:
                assert r.text == pii.mask(kept[r.doc_id].text, pii.all_spans(kept[r.doc_id].text)[1]) and not [s for s in brute_base(r.text)]
        else:
            used, least = check_packing(rows, [(i, r.text) for i, r in kept.items()])
            assert used <= least + 1
        if k < 3:
            kept = {r.doc_id: r for r in rows}
    assert corpus_pipeline.run(spark, d).count() == now.count()


def test_pipeline_on_empty_documents(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
