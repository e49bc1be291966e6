"""Scans, sinks, gates, streams, watermarks, the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import providers, receipts, tables
from plumbline.sources.tables import Refusal


def put(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_labelled_corpus(spark, tmp_path):
    p = put(tmp_path / "c.jsonl", {"text": "a", "label": "human"}, "", {"id": "x", "text": "b", "label": "ai", "meta": {"k": "v"}})
    rows = tables.read_labelled(spark, p).orderBy("line").collect()
    assert [r.id for r in rows] == ["c-0", "x"] and rows[1].meta == {"k": "v"}
    bad = put(tmp_path / "d.jsonl", {"text": "a", "label": "human"}, {"text": "b", "label": "robot"})
    with pytest.raises(Refusal, match="line 1"):
        tables.read_labelled(spark, bad)


def test_candidates(spark, tmp_path):
    rows, labels = tables.read_candidates(spark, put(tmp_path / "c.jsonl", {"text": "a", "label": "ai"}))
    assert labels and rows.columns == ["id", "text", "meta", "line"]
    with pytest.raises(Refusal):
        tables.read_candidates(spark, put(tmp_path / "e.jsonl", ""))


def test_scores(spark, tmp_path):
    p = put(tmp_path / "s.csv", "label,score,n_words,meta", 'human,0.5,12.0,"{""a"": ""b""}"', "ai,1.5,,not json")
    rows = tables.read_scores(spark, p).orderBy("row_ix").collect()
    assert [r.id for r in rows] == ["row0", "row1"] and rows[0].n_words == 12 and rows[0].meta == {"a": "b"} and rows[1].n_words is None
    with pytest.raises(Refusal, match="missing columns: label"):
        tables.read_scores(spark, put(tmp_path / "t.csv", "score", "1"))
    assert tables.read_scores(spark, put(tmp_path / "u.csv", "score", "1"), labelled=False).count() == 1
    with pytest.raises(Refusal):
        tables.read_scores(spark, put(tmp_path / "v.csv", "label,score", "robot,1"))
    cut = tmp_path / "w.csv"
    cut.write_text("id,label,score\na,human,1.0\nb,ai,")
    assert [r.id for r in tables.read_scores(spark, str(cut), partial=True).collect()] == ["a"]


def test_lines_and_rows_are_numbered_across_splits(spark, tmp_path):
    """Files of many splits and of several files: every line has its physical number, every row its place."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    g = np.random.default_rng(2)
    many = [{"text": "x" * int(n), "label": "ai"} for n in g.integers(1, 200, 400)]
    p = put(tmp_path / "c.jsonl", *("" if k % 7 == 3 else r for k, r in enumerate(many)))
    for name, n in (("s1.csv", 300), ("s2.csv", 50)):
        put(tmp_path / "rows" / name, "label,score", *(f"human,{k}.5" for k in range(n))) if (tmp_path / "rows").mkdir(exist_ok=True) is None else None
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        rows = tables.read_labelled(spark, p)
        assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(p).rdd.getNumPartitions() > 5
        assert {(r.line, r.id, len(r.text)) for r in rows.collect()} == {(k, f"c-{k}", len(r["text"])) for k, r in enumerate(many) if k % 7 != 3}
        got = tables.read_scores(spark, str(tmp_path / "rows")).orderBy("row_ix").collect()
        assert [r.row_ix for r in got] == list(range(350)) and [r.score for r in got] == [k + 0.5 for k in [*range(300), *range(50)]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    broken = put(tmp_path / "m.csv", "id,label,score", '"a', 'b",human,1')
    assert tables.read_scores(spark, broken, multi_line=True).first().id == "a\nb"
    with pytest.raises(Refusal):
        tables.read_scores(spark, broken)


def test_reports_that_a_user_has(spark, tmp_path):
    out = tmp_path / "r"
    out.mkdir()
    with pytest.raises(Refusal, match="not a report"):
        receipts.load_report(spark, f"file://{out}")
    put(out / "scores.csv", "id,label,score", *(f"r{k},{'ai' if k % 2 else 'human'},{k}" for k in range(6)))
    scores, env = receipts.load_report(spark, f"file://{out}")
    assert sorted((r.score, r.y) for r in scores.collect()) == [(float(k), k % 2) for k in range(6)] and env["detector"] == "unknown"
    with pytest.raises(Refusal, match="lacks"):
        receipts.load_instrument(spark, f"file://{out}")
    (out / "env.json").write_text('{"detector": {"name": "d"}}')
    (out / "results.json").write_text('{"auroc": 0.5}')
    assert receipts.load_report(spark, f"file://{out}")[1] == {"detector": {"name": "d"}, "corpus": "unknown", "version": "unknown"}
    put(out / "scores.csv", "id,label,score", "a,human,1", "b,robot,2")
    scores, env, results = receipts.load_instrument(spark, f"file://{out}")
    assert sorted(map(tuple, scores.collect())) == [(1.0, 0), (2.0, 1)] and results == {"auroc": 0.5}


def test_run_state(spark, tmp_path):
    out, corpus = f"file://{tmp_path}/run", {"name": "c", "sha256": "0", "counts": {"ai": 1}}
    with pytest.raises(Refusal, match="no run"):
        receipts.read_run(spark, out)
    assert not receipts.begin_run(spark, out, corpus, {"detector": "d", "device": "cpu"}, "again")["complete"]
    assert receipts.begin_run(spark, out, corpus, {"detector": "d", "device": "cpu"})["reproduce"] == "again"
    for other in ((corpus | {"sha256": "1"}, {"detector": "d", "device": "cpu"}, "corpus.sha256"), (corpus, {"detector": "d", "device": "gpu"}, "device")):
        with pytest.raises(Refusal, match=other[2]):
            receipts.begin_run(spark, out, *other[:2])
    assert receipts.complete_run(spark, out)["complete"] and receipts.read_run(spark, out)["complete"]


def test_content_hashes(spark, tmp_path):
    import hashlib

    from plumbline.operators import probes

    rows = [probe(id=f"p{k}", vintage=f"t{k % 2}", answer="Straße 東") | {"_note": k} for k in range(9)]
    want = {}
    for r in rows:
        want.setdefault(r["vintage"], []).append(json.dumps({k: v for k, v in r.items() if k != "_note"}, sort_keys=True))
    for order in (rows, rows[::-1]):
        got = probes.content_hashes(tables.probe_rows(spark, put(tmp_path / "p.jsonl", *order))).collect()
        assert {r.vintage: (r.n, r.content_hash) for r in got} == {v: (len(x), hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest()) for v, x in want.items()}
    assert probes.content_hashes(spark.createDataFrame([(None, "{}"), ("t", None)], "vintage string, json string")).count() == 0
    one = probes.template_fingerprint("Is {answer} right?", {"t": " yes", "f": " no"}, "1")
    assert one != probes.template_fingerprint("Is {answer} right!", {"t": " yes", "f": " no"}, "1") and len(one["template_sha256"]) == 64


def test_remote_revision_and_cached_download(tmp_path):
    from plumbline.sources.paged import TooMany, cached, retrying, revision

    assert revision(lambda: {"sha": "abc"}) == "abc" and revision(lambda: {}) == "unknown"
    waits, left = [], [TooMany(), TooMany(after=9.0), OSError("reset")]

    def busy():
        if left:
            raise left.pop(0)
        return "ok"

    assert retrying(busy, sleep=waits.append) == "ok" and waits == [2.0, 9.0, 3.0]
    at, calls = str(tmp_path / "f"), []

    def chunks():
        calls.append(1)
        yield b"one"
        yield b"two"

    assert cached(cached(at, chunks), chunks) == at and (tmp_path / "f").read_bytes() == b"onetwo" and len(calls) == 1 and not (tmp_path / "f.part").exists()


def probe(**over):
    return {"id": "p1", "prompt": "q", "answer": "a", "vintage": "t0", "source": "s", "source_date": "2024-02-01", "authored": "2024-02-02", "aliases": ["b"]} | over


def test_probes_and_manifest(spark, tmp_path):
    p = put(tmp_path / "p.jsonl", probe(), probe(id="p2"))
    assert tables.read_probes(spark, p).count() == 2
    for bad, why in ((probe(id="p1"), "repeats"), (probe(id="p3", answer=None), "required"), (probe(id="p3", source_date="2024-2-1"), "ISO")):
        with pytest.raises(Refusal, match=why):
            tables.read_probes(spark, put(tmp_path / "b.jsonl", probe(), bad))
    assert tables.read_manifest(spark, p) is None and tables.may_run(None, "p.jsonl") == "unenforced"
    new = str(tmp_path / "n.jsonl")
    receipts.new_probe_set(spark, new, "t1", "2024-01-31")
    made = tables.read_probes(spark, new).collect()
    assert len(made) == 2 and str(made[0].source_date) == "2024-02-01"
    with pytest.raises(Refusal):
        receipts.new_probe_set(spark, new, "t1", "2024-01-31")
    assert {r.rule for r in tables.lint_manifest(tables.read_manifest(spark, new), "n.jsonl").collect()} == {"control hash is not sha256"}
    with pytest.raises(Refusal, match="sha256"):
        tables.may_run(tables.read_manifest(spark, new), "n.jsonl")


def test_paged_source(spark):
    from plumbline.sources.paged import PagedReader, Pages, retrying
    from pyspark.sql.datasource import EqualTo, GreaterThan

    data = [{"a": k, "model": "m" if k % 2 else "n"} for k in range(250)]
    chosen = lambda f: [r for r in data if all(r[k] == v for k, v in f.items())]
    schema = spark.createDataFrame([], "a long, model string").schema
    r = PagedReader(schema, lambda f, o, n: chosen(f)[o : o + n], lambda f: len(chosen(f)), 20)
    rest = list(r.pushFilters([EqualTo(("model",), "m"), GreaterThan(("a",), 3)]))
    assert len(rest) == 1 and r.filters == {"model": "m"}
    got = [x for p in r.partitions() for x in r.read(p)]
    assert [x[0] for x in got] == list(range(1, 250, 2)) and isinstance(r.partitions()[0], Pages)
    waits = []

    def fails():
        raise OSError("429")

    with pytest.raises(Refusal):
        retrying(fails, sleep=waits.append)
    assert waits == [1.0, 2.0, 3.0]


def test_report_export_and_registry(spark, tmp_path):
    s = spark.createDataFrame([("a", 1.0)], "id string, score double")
    out = f"file://{tmp_path}/r"
    receipts.write_report(out, s, {"t": s}, {"detector": "d"})
    scores, env = receipts.load_report(spark, out)
    assert scores.count() == 1 and env == {"detector": "d"} and "| a | 1 |" in (tmp_path / "r/report.md").read_text()
    doc = {"id": "x", "detector": "d"}
    assert receipts.export_document(spark, out, "x", doc) and not receipts.export_document(spark, out, "x", doc)
    with pytest.raises(Refusal):
        receipts.export_document(spark, out, "x", doc | {"auroc": 1.0})
    assert receipts.export_document(spark, out, "x", doc | {"auroc": 1.0}, force=True)
    assert [r.id for r in receipts.rebuild_index(spark, out).collect()] == ["x"]
    runs = spark.createDataFrame([("t0", 0, 0.5, True)], "vintage string, run int, accuracy double, replicate boolean")
    hashes = lambda h: spark.createDataFrame([("t0", h)], "vintage string, content_hash string")
    reg = f"file://{tmp_path}/reg"
    key = receipts.record_run(reg, runs, hashes("h"), {"a": 1})
    assert receipts.record_run(reg, runs, hashes("h"), {"a": 1}) == key != receipts.record_run(reg, runs, hashes("z"), {"a": 2})
    with pytest.raises(Refusal, match="t0"):
        receipts.record_run(reg, runs, hashes("other"), {"a": 1})
    assert spark.read.parquet(f"{reg}/runs").count() == 3


def test_append_is_idempotent(spark, tmp_path):
    p = f"file://{tmp_path}/partial"
    rows = lambda *ids: spark.createDataFrame([(i, 1.0) for i in ids], "id string, score double")
    receipts.append_scored(p, rows("a", "b"))
    receipts.append_scored(p, rows("b", "c"))
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == ["a", "b", "c"]


def test_probe_run_resumes(spark):
    p = spark.createDataFrame([("p1", "q1", "The Sun", "t0", ["Sol"]), ("p2", "q2", "Moon", "t0", [])], "id string, prompt string, answer string, vintage string, aliases array<string>")
    told = {"q1": "sol.", "q2": "Mars"}
    fake = providers.Provider("fake", lambda: lambda prompts: [told[x] for x in prompts])
    got = {r.id: r.correct for r in providers.run_probes(p, fake).collect()}
    assert got == {"p1": True, "p2": False}
    assert [r.id for r in providers.run_probes(p, fake, spark.createDataFrame([("p1",)], "id string")).collect()] == ["p2"]
    with pytest.raises(Refusal):
        fake.require("option_logprobs")
    with pytest.raises(Refusal):
        providers.Provider("remote", lambda: None, local=False).require_local()


def test_detectors(spark):
    from plumbline.operators.detectors import Detector, fast_discrepancy

    d = Detector("length", lambda: lambda texts: [float(len(t)) for t in texts])
    assert [r.score for r in d.score(spark.createDataFrame([("ab",), (None,)], "text string")).collect()] == [2.0, 0.0]
    with pytest.raises(RuntimeError, match="torch"):
        fast_discrepancy().check()


def test_stream_flags_what_is_out_of_order_and_guards_identity(spark, tmp_path):
    from plumbline.streaming import monitors

    base = f"file://{tmp_path}"
    centre = spark.createDataFrame([("s", -1.0)], "series string, centre double")

    def run(*ts):
        spark.createDataFrame([("s", t, 1.0) for t in ts], "series string, t int, value double").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("series string, t int, value double").parquet(f"{base}/in")
        monitors.run_once(monitors.stream_monitors(stream, centre), f"{base}/out", f"{base}/ck")

    run(1, 2)
    run(0, 3)
    got = {r.t: r for r in spark.read.parquet(f"{base}/out").collect()}
    assert [got[t].out_of_order for t in (0, 1, 2, 3)] == [True, False, False, False] and got[0].cusum is None
    monitors.guard_identity(spark, f"{base}/ck", {"a": 1})
    monitors.guard_identity(spark, f"{base}/ck", {"a": 1})
    with pytest.raises(Refusal):
        monitors.guard_identity(spark, f"{base}/ck", {"a": 2})


def test_watermark_round_trip(spark):
    from plumbline.operators import watermark as w

    g = np.random.default_rng(0)
    image = np.clip(128 + np.cumsum(g.normal(0, 2, (256, 256, 3)), axis=1), 0, 255).astype(np.uint8)
    marked = w.encode(image, b"abcd")
    assert w.decode(marked, 4) == b"abcd" and np.abs(marked.astype(int) - image).mean() < 12
    with pytest.raises(ValueError):
        w.encode(image[:100], b"abcd")
    df = spark.createDataFrame([("a", marked.tobytes(), 256, 256), ("b", b"", 0, 0)], "path string, content binary, rows int, columns int")
    got = {r.path: r for r in w.decode_images(df, 4).collect()}
    assert got["a"].payload == b"abcd" and got["b"].status == "INCONCLUSIVE"


def test_evidence_rows_are_checked(spark):
    from plumbline.operators import rules

    rows = lambda *r: spark.createDataFrame([r], "status string, explanation string, self_test boolean")
    assert rules.check_statuses(rows("ABSENT", "x", True)).count() == 1
    for bad in (("ABSENT", "x", False), ("MAYBE", "x", True), ("PRESENT", " ", True)):
        with pytest.raises(Exception, match="not a valid evidence row"):
            rules.check_statuses(rows(*bad)).collect()


def test_hash_chain(spark):
    from plumbline.operators import rules

    good = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    m = spark.createDataFrame([("a", good, 5), ("b", "0" * 64, 5), ("c", "1" * 64, 5)], "name string, layer_digest string, size int")
    b = spark.createDataFrame([(good, b"hello"), ("0" * 64, b"hello")], "digest string, content binary")
    assert {r.name: r.status for r in rules.hash_chain(m, b).collect()} == {"a": "verified", "b": "altered", "c": "missing"}


def test_command_line(spark, tmp_path, capsys):
    from plumbline.cli import main

    p = put(tmp_path / "s.csv", "label,score", *(f"{'ai' if k % 2 else 'human'},{k}" for k in range(120)))
    assert main(["analyze", p, f"file://{tmp_path}/out"]) == 0 and (tmp_path / "out/report.md").exists()
    assert main(["analyze", put(tmp_path / "x.csv", "score", "1"), f"file://{tmp_path}/o2"]) == 2 and "refused" in capsys.readouterr().err


def test_command_line_from_corpus_to_index(spark, tmp_path, capsys):
    from plumbline.cli import main

    rows = [json.dumps({"id": f"d{k}", "text": "word " * (20 + k) if k % 2 else "longer words " * (20 + k), "label": "ai" if k % 2 else "human", "meta": {"part": "x" if k % 3 else "y"}}) for k in range(120)]
    corpus, out = put(tmp_path / "c.jsonl", *rows), f"file://{tmp_path}/rep"
    assert main(["run", corpus, out]) == 0 and main(["run", corpus, out]) == 0
    assert spark.read.parquet(f"{out}/partial").count() == 120
    assert {r.axis for r in spark.read.json(f"{out}/subgroups").collect()} == {"length", "part"} and (tmp_path / "rep/auroc_ci").exists()
    assert main(["run", corpus, out, "--scorer", "token-discrepancy"]) == 2 and main(["run", corpus, out, "--scorer", "none"]) == 2
    assert main(["score", out, "some words here"]) == 0
    assert main(["export", out, f"file://{tmp_path}/pub", "one"]) == 0 and main(["index", f"file://{tmp_path}/pub"]) == 0
    assert "characters-per-word" in capsys.readouterr().out
    assert main(["export", out, f"file://{tmp_path}/pub", "http://elsewhere.example/x"]) == 2
    assert main(["corpora", str(tmp_path)]) == 0 and main(["providers"]) == 0 and "ready" in capsys.readouterr().out


def test_command_line_slice_and_series(spark, tmp_path, capsys):
    from plumbline.cli import main

    table = put(tmp_path / "b.csv", "id,model,domain,attack,generation", *(f'{k},{"human" if k % 2 else "m1"},news,{"none" if k % 4 else ""},{"w " * (60 if k % 5 else 3)}' for k in range(80)))
    assert main(["prepare", table, f"file://{tmp_path}/slice", "--models", "human,m1", "--domains", "news", "--per-cell", "7"]) == 0
    got = spark.read.json(f"file://{tmp_path}/slice").collect()
    assert len(got) == 14 and {r.label for r in got} == {"human", "ai"}
    assert main(["prepare", put(tmp_path / "bad.csv", "id", "1"), f"file://{tmp_path}/s2"]) == 2
    probes = put(tmp_path / "p.jsonl", *(json.dumps({"id": f"p{k}", "prompt": f"q{k}", "answer": "sun", "vintage": "t0", "source": "s", "source_date": "2024-02-01"}) for k in range(4)))
    answers, reg = put(tmp_path / "a.csv", "id,response", "p0,Sun", "p1,the sun", "p2,moon", "p3,sun."), f"file://{tmp_path}/reg"
    for n in ("1", "2", "3"):
        assert main(["probe-run", probes, answers, "--registry", reg, "--run-number", n, "--replicate", "no" if n == "3" else "yes"]) == 0
    key = spark.read.parquet(f"{reg}/runs").first().series_id
    assert main(["series-list", reg]) == 0 and main(["series-show", reg, key]) == 0 and main(["series-watch", reg, "--id", key]) == 0
    assert "within" in capsys.readouterr().out
    assert main(["plan", put(tmp_path / "k.csv", "name,kind,explicit_gb", "small,ram,0.5", "large,gpu,24")]) == 0 and "needs 24.0 GB" in capsys.readouterr().out
    assert main(["verify", str(tmp_path / "p.jsonl")]) == 0


def test_public_names():
    import plumbline

    assert all(getattr(plumbline, n) is not None for n in plumbline.__all__) and set(plumbline.__all__) <= set(dir(plumbline))
    with pytest.raises(AttributeError):
        plumbline.nothing


def test_sampling_is_order_free(spark, sf):
    from plumbline.operators.sampling import first_of_each

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    a = {r.id for r in first_of_each(docs, ["lang"], 7).collect()}
    assert a == {r.id for r in first_of_each(docs.orderBy(F.rand()).repartition(13), ["lang"], 7).collect()} and len(a) == 28
