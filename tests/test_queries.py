"""Every registered query against its DuckDB counterpart."""

import duckdb
import pytest

from plumbline import catalogue
from plumbline.operators import rules
from tests.helpers import check, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, con, name):
    check(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["auroc", "conformal_band", "placements", "monitor_panel", "vintage_hashes"])
def test_partition_count_is_irrelevant(spark, sf, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            check(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLES[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_redaction_hits_on_odd_texts(spark, tmp_path):
    """Addresses that one character parts, white space that engines read otherwise, ends of texts: as in the
    SQL. The operator itself finds every address."""
    import random

    g = random.Random(3)
    bits = ["1.2.3.4", "10.20.30.40", "999.1.2.3", "1.2.3", "5", ".", " ", ",", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "é", "😀", "x", "~", ":", "/", "//", "-", "\"", "'", ")", "]", "<", "http://a.b/c", "https://arxiv.org", "http://arxiv.org:8", "http://", "/home/me", "/tmp/", "/var/log/x", "HTTP://a"]
    texts = [None, "", "1.2.3.4 5.6.7.8", "1.2.3.4  5.6.7.8", "1.2.3.4,5.6.7.8,9.10.11.12\n", "1.2.3.4\r\n", "see http://arxiv.org\x0bhttp://a.b", "http://a.b\x0b/tmp/x"]
    texts += ["".join(g.choices(bits, k=g.randint(1, 30))) for _ in range(4000)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows[:500], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    check(catalogue.QUERIES["redaction_hits"](spark, str(tmp_path)), con, catalogue.ORACLES["redaction_hits"])
    leaves = spark.createDataFrame([("a", "$", texts[2])], "id string, path string, value string")
    assert [r.hit for r in rules.redaction_hits(leaves).collect()] == ["1.2.3.4", "5.6.7.8"]


def test_import_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['plumbline.llm'] = None; import builtins; import __spark_entry__ as e; assert 'auroc' in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert done.returncode == 0, done.stderr
