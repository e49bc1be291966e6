"""Command line over the library. A refusal is printed and exits with 2."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F


def _spark() -> SparkSession:
    s = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _scorer(name: str):
    from plumbline.operators.detectors import SCORERS
    from plumbline.sources.tables import Refusal

    if name not in SCORERS:
        raise Refusal(f"no scorer {name}; there are {', '.join(sorted(SCORERS))}")
    scorer = SCORERS[name]()
    try:
        getattr(scorer, "check", lambda: None)()
    except RuntimeError as missing:
        raise Refusal(str(missing)) from missing
    return scorer


def _calibrate(scores, out, environment, key):
    from plumbline.plans.calibrate import calibration_tables, meta_axes
    from plumbline.sources.receipts import write_report

    tables = calibration_tables(scores, meta_axes(scores), key=key)
    write_report(out, scores.withColumn("meta", F.to_json("meta")) if "meta" in scores.columns else scores, tables, environment, "Calibration")


def run(a):
    """Score a labelled corpus, going on from what an interrupted run has scored, and calibrate."""
    from plumbline.functions.text import word_count
    from plumbline.operators.sampling import still_to_do
    from plumbline.sources.receipts import append_scored, begin_run, complete_run, path_exists
    from plumbline.sources.tables import as_binary, file_hashes, read_labelled

    spark, scorer = _spark(), _scorer(a.scorer)
    corpus, done = read_labelled(spark, a.corpus), f"{a.out}/partial"
    counts = {r.label: r["count"] for r in corpus.groupBy("label").count().collect()}
    begin_run(spark, a.out, {"name": a.corpus, "sha256": [r.sha256 for r in file_hashes(spark, a.corpus).orderBy("path").collect()], "counts": counts}, {"detector": a.scorer}, f"run {a.corpus} {a.out} --scorer {a.scorer}")
    todo = still_to_do(corpus, spark.read.parquet(done)) if path_exists(spark, done) else corpus
    append_scored(done, scorer.score(todo).select("id", "score"))
    rows = spark.read.parquet(done).join(corpus, "id").withColumn("n_words", word_count("text")).drop("text")
    _calibrate(as_binary(rows.filter("score IS NOT NULL")), a.out, {"detector": a.scorer, "corpus": a.corpus, "version": "1"}, "id")
    complete_run(spark, a.out)


def analyze(a):
    from plumbline.sources.tables import as_binary, read_scores

    _calibrate(as_binary(read_scores(_spark(), a.scores)), a.out, {"detector": a.detector, "corpus": a.scores, "version": "1"}, "row_ix")


def score(a):
    """One text against a report's thresholds; nothing of the text is written anywhere."""
    from plumbline.operators import bounds, curves
    from plumbline.sources.receipts import load_report

    spark = _spark()
    scores, environment = load_report(spark, a.report)
    name = environment["detector"]
    one = _scorer(name).score(spark.createDataFrame([(a.text,)], "text string")).select("score")
    cut = curves.threshold_at_fpr(scores).select(F.lit("empirical").alias("rule"), F.col("target_fpr").alias("rate"), F.col("threshold").alias("at"), "refusal")
    cut = cut.unionByName(bounds.conformal_table(scores).select(F.lit("conformal").alias("rule"), F.col("alpha").alias("rate"), F.col("bound").alias("at"), "refusal"))
    hit = F.when(F.col("rule") == "conformal", F.col("score") > F.col("at")).otherwise(F.col("score") >= F.col("at"))
    one.crossJoin(cut).select("score", "rule", "rate", "at", hit.alias("flagged"), "refusal").orderBy("rule", "rate").show(100, False)


def export(a):
    """The public document of a report, refused where a string in it names a host, a path or an address."""
    from plumbline.operators.rules import as_rows, redaction_hits
    from plumbline.sources.receipts import canonical_json, export_document, load_report
    from plumbline.sources.tables import Refusal

    spark = _spark()
    scores, environment = load_report(spark, a.report)
    from plumbline.operators.curves import auroc

    document = {"id": a.id, "detector": environment["detector"], "corpus": str(environment["corpus"]).rsplit("/", 1)[-1], "auroc": auroc(scores).first()["auroc"], "version": environment["version"], "generated_utc": a.at}
    leaves = spark.createDataFrame([(a.id, r.field, r.value) for r in as_rows(document)], "id string, path string, value string")
    hits = redaction_hits(leaves).limit(8).collect()
    if hits:
        raise Refusal("not public: " + ", ".join(f"{h.path} ({h.rule})" for h in hits))
    print("written" if export_document(spark, a.root, a.id, document, a.force == "yes") else "unchanged", canonical_json(document), end="")


def index(a):
    from plumbline.sources.receipts import rebuild_index

    rebuild_index(_spark(), a.root).show(1000, False)


def corpora(a):
    """The corpora in a folder: rows by label."""
    from plumbline.sources.tables import read_labelled

    spark = _spark()
    spark.read.text(f"{a.root}/*.jsonl", wholetext=True).select("_metadata.file_path").distinct().show(1000, False)
    read_labelled(spark, f"{a.root}/*.jsonl").groupBy(F.regexp_extract("id", "^(.*?)-?[0-9]*$", 1).alias("corpus"), "label").count().orderBy("corpus", "label").show(1000, False)


def prepare(a):
    """A slice of a benchmark table (id, model, domain, attack, generation): a sample of each cell."""
    from plumbline.operators.sampling import cell_grid, map_rows, prepare_slice
    from plumbline.sources.tables import require_columns

    spark = _spark()
    raw = spark.read.csv(a.csv, header=True, multiLine=True, escape='"')
    require_columns(raw, ("id", "model", "domain", "attack", "generation"))
    cells = spark.createDataFrame(cell_grid(model=a.models.split(","), domain=a.domains.split(","), attack=a.attacks.split(",")))
    rows = map_rows(raw).withColumns({k: F.col("meta")[k] for k in ("model", "domain", "attack")})
    kept = prepare_slice(rows, cells, a.per_cell, (a.least, a.most), seed=a.seed)
    kept.select("id", "text", "label", "meta").write.mode("errorifexists").json(a.out)


def admit(a):
    from plumbline.operators import shift
    from plumbline.plans.calibrate import admission_tables
    from plumbline.sources.receipts import write_report
    from plumbline.sources.tables import read_scores

    spark = _spark()
    r, c = read_scores(spark, a.reference), read_scores(spark, a.candidate, labelled=False)
    r = shift.reference_rows(r, a.mode)
    write_report(a.out, shift.placements(r, c).drop("meta"), admission_tables(r, c, key="row_ix"), {"reference": a.reference, "candidate": a.candidate}, "Admission")


def probe_run(a):
    """Grade answers from a table of recorded responses (id, response), and register the run."""
    from plumbline.operators.probes import grade_free_text, vintage_accuracy, vintage_hashes
    from plumbline.sources.providers import Decoding
    from plumbline.sources.receipts import record_run
    from plumbline.sources.tables import may_run, read_manifest, read_probes

    spark = _spark()
    probes = read_probes(spark, a.probes)
    may_run(read_manifest(spark, a.probes), a.probes.rsplit("/", 1)[-1])
    graded = grade_free_text(probes.join(spark.read.csv(a.responses, header=True, multiLine=True, escape='"').select("id", "response"), "id"), aliases="aliases")
    by = vintage_accuracy(graded)
    by.show(100, False)
    if a.registry:
        runs = by.select("vintage", F.lit(a.run_number).alias("run"), "accuracy", F.lit(a.replicate == "yes").alias("replicate"))
        identity = {"provider": a.provider, "decoding": Decoding().fingerprint(), "cutoff": a.cutoff}
        print(record_run(a.registry, runs, vintage_hashes(probes, "vintage", ["id", "prompt", "answer"]), identity))


def probe_lint(a):
    from plumbline.operators.probes import lint
    from plumbline.sources.tables import Refusal, read_probes

    found = lint(read_probes(_spark(), a.probes), a.cutoff)
    found.show(100, False)
    if found.filter("severity = 'error'").count():
        raise Refusal("the probe set has errors")


def probe_new(a):
    from plumbline.sources.receipts import new_probe_set

    new_probe_set(_spark(), a.out, a.vintage, a.cutoff)


def _runs(a):
    runs = _spark().read.parquet(f"{a.registry}/runs")
    return runs.filter(F.col("series_id") == a.id) if getattr(a, "id", "") else runs


def series_watch(a):
    from plumbline.operators import drift, series

    drift.panel(series.sequences(_runs(a)), a.direction).orderBy("monitor", "series", "t").show(1000, False)


def series_show(a):
    from plumbline.operators import series

    series.variance_bound(_runs(a)).orderBy("vintage").show(1000, False)
    series.movement(_runs(a)).orderBy("vintage", "run").show(1000, False)


def series_list(a):
    from plumbline.operators import series

    series.list_series(_runs(a)).show(1000, False)


def plan(a):
    """Which scorers fit this machine's memory (floors in GB, of a table name,kind,explicit_gb)."""
    import os

    from plumbline.operators.rules import effective_floor, feasibility

    spark = _spark()
    ram = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 1e9
    configs = spark.read.csv(a.configs, header=True, schema="name string, kind string, explicit_gb double")
    measured = spark.createDataFrame([], "name string, kind string, gb double")
    feasibility(effective_floor(configs, measured), spark.createDataFrame([(a.gpu_gb, ram)], "gpu_gb double, ram_gb double")).orderBy("name", "kind").show(1000, False)


def providers(a):
    """Scorers and whether what they need is installed."""
    from plumbline.operators.detectors import SCORERS

    for name, make in sorted(SCORERS.items()):
        try:
            getattr(make(), "check", lambda: None)()
            print(name, "ready", sep="\t")
        except RuntimeError as missing:
            print(name, str(missing), sep="\t")


def test_connection(a):
    """Stored blobs against a manifest (name,layer_digest,size): verified, altered or missing."""
    from plumbline.operators.rules import hash_chain

    spark = _spark()
    manifest = spark.read.csv(a.manifest, header=True, schema="name string, layer_digest string, size long")
    blobs = spark.read.format("binaryFile").load(a.blobs).select(F.regexp_extract("path", "([^/]+)$", 1).alias("digest"), "content")
    hash_chain(manifest, blobs).orderBy("name").show(1000, False)


def verify(a):
    """What a sweep of files can say: digest, kind and which carriers apply."""
    from plumbline.operators.rules import media_kind
    from plumbline.sources.tables import file_hashes

    file_hashes(_spark(), a.path).withColumn("kind", media_kind(F.col("path"))).show(1000, False)


def query(a):
    from plumbline import catalogue

    catalogue.QUERIES[a.name](_spark(), a.tables).show(a.rows, False)


def main(argv=None) -> int:
    from plumbline import __version__
    from plumbline.operators.sampling import CELL_WORDS, PER_CELL, SEED
    from plumbline.sources.tables import Refusal

    p = argparse.ArgumentParser("plumbline")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(required=True)

    def verb(name, does, *args, **options):
        q = sub.add_parser(name, help=(does.__doc__ or name).splitlines()[0])
        for x in args:
            q.add_argument(x)
        for k, v in options.items():
            q.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v))
        q.set_defaults(does=does)

    verb("run", run, "corpus", "out", scorer="characters-per-word")
    verb("analyze", analyze, "scores", "out", detector="unknown")
    verb("score", score, "report", "text")
    verb("export", export, "report", "root", "id", at="1970-01-01T00:00:00Z", force="no")
    verb("index", index, "root")
    verb("corpora", corpora, "root")
    verb("prepare", prepare, "csv", "out", models="human", domains="unknown", attacks="none", per_cell=PER_CELL, least=CELL_WORDS[0], most=CELL_WORDS[1], seed=SEED)
    verb("admit", admit, "reference", "candidate", "out", mode="all")
    verb("probe-run", probe_run, "probes", "responses", registry="", provider="recorded", cutoff="", run_number=1, replicate="no")
    verb("probe-lint", probe_lint, "probes", "cutoff")
    verb("probe-new", probe_new, "out", "vintage", "cutoff")
    verb("series-watch", series_watch, "registry", id="", direction="down")
    verb("series-show", series_show, "registry", "id")
    verb("series-list", series_list, "registry")
    verb("plan", plan, "configs", gpu_gb=0.0)
    verb("providers", providers)
    verb("test-connection", test_connection, "manifest", "blobs")
    verb("verify", verify, "path")
    verb("query", query, "name", "tables", rows=20)
    a = p.parse_args(argv)
    try:
        a.does(a)
    except Refusal as why:
        print(f"refused: {why}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
