"""Evidence sweeps, images, samples of streams, texts for people."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evidence, watermark


def png(image, kind, filters):
    """A PNG of (rows, columns, channels) samples, row k filtered by filters[k % len]."""
    rows, columns, wide = image.shape
    lines, above = b"", np.zeros((columns, wide), int)
    for k in range(rows):
        line = image[k].astype(int)
        left, corner = np.zeros_like(line), np.zeros_like(line)
        left[1:], corner[1:] = line[:-1], above[:-1]
        f = filters[k % len(filters)]
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * line, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][f]
        lines += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    head = columns.to_bytes(4, "big") + rows.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
    packed = zlib.compress(lines)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:50]) + chunk(b"IDAT", packed[50:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind, wide", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(kind, wide):
    image = np.random.default_rng(kind).integers(0, 256, (11, 7, wide), dtype=np.uint8)
    want = image[:, :, :3] if wide > 2 else np.repeat(image[:, :, :1], 3, axis=2)
    assert (watermark.read_png(png(image, kind, [0, 1, 2, 3, 4])) == want).all()


@pytest.mark.parametrize("bad", [b"", b"\x89PNG\r\n\x1a\n", b"GIF89a" + b"x" * 40, png(np.zeros((2, 2, 3), np.uint8), 2, [0])[:-20] + b"\0" * 20])
def test_what_is_no_png(bad):
    with pytest.raises(Exception):
        watermark.read_png(bad)


def test_sweep_of_files(spark):
    g = np.random.default_rng(0)
    image = np.clip(128 + np.cumsum(g.normal(0, 2, (256, 256, 3)), axis=1), 0, 255).astype(np.uint8)
    marked, plain, small = png(watermark.encode(image, b"mark!"), 2, [0]), png(image, 2, [0]), png(image[:64, :64], 2, [0])

    def none(content):
        raise evidence.NotFound("no manifest")

    def missing(content):
        raise ModuleNotFoundError("reader")

    files = spark.createDataFrame([("/a.png", marked), ("/b.png", plain), ("/c.png", small), ("/d.png", b"broken"), ("/e.txt", b"words"), ("/f", None)], "path string, content binary").filter("content IS NOT NULL")
    schemes = [evidence.Scheme("typed", read=none), evidence.Scheme("missing", read=missing), evidence.Scheme("any", read=lambda c: {"bytes": len(c)}), evidence.image_watermark(b"mark!"), evidence.PORTAL, evidence.signed_manifest()]
    got = {(r.path, r.scheme): r for r in evidence.sweep_files(files, schemes).collect()}
    assert {s: got["/a.png", s].status for s in ("typed", "missing", "any", "signed-manifest", "portal-only")} == {"typed": "ABSENT", "missing": "UNAVAILABLE", "any": "PRESENT", "signed-manifest": "UNAVAILABLE", "portal-only": "UNAVAILABLE"}
    marks = {p: (got[p, "image-watermark"].status, got[p, "image-watermark"].self_test) for p in ("/a.png", "/b.png", "/c.png", "/d.png")}
    assert marks == {"/a.png": ("PRESENT", None), "/b.png": ("ABSENT", True), "/c.png": ("INCONCLUSIVE", False), "/d.png": ("INCONCLUSIVE", None)}
    assert ("/e.txt", "image-watermark") not in got and ("/e.txt", "portal-only") not in got and all(r.negative_meaning for r in got.values())
    assert evidence.sweep_files(files.limit(0), schemes).count() == 0


def test_sweep_of_texts_and_environment(spark):
    t = spark.createDataFrame([(1, "añb"), (2, None)], "k long, t string")
    rows = evidence.sweep_texts(t, evidence.TEXT_SCHEMES, "k", "t").collect()
    assert {(r.id, r.chars) for r in rows} == {(1, 3), (2, 0)} and len(rows) == 4 and {r.status for r in rows} == {"UNAVAILABLE"}
    env = evidence.environment(("numpy", "no_such_thing"))
    assert env["numpy"] == np.__version__ and env["no_such_thing"] == "not installed" and env["python"]


def test_reservoir_of_a_stream(spark, tmp_path):
    """Whatever the batches, it is what the whole table gives; a replayed batch changes nothing."""
    from plumbline.operators.sampling import first_of_each
    from plumbline.streaming.monitors import Reservoir

    rows = [(k, "ab"[k % 2]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, cell string")
    want = {tuple(r) for r in first_of_each(df, ["cell"], 7).collect()}
    for name, cuts in (("one", [300]), ("many", [10, 11, 100, 250, 300])):
        keep, start = Reservoir(f"file://{tmp_path}/{name}", ["cell"], 7), 0
        assert keep.read(spark, df.schema).count() == 0
        for epoch, end in enumerate(cuts):
            batch = df.filter(F.col("id").between(start, end - 1))
            keep(batch, epoch)
            keep(batch.unionByName(batch), epoch)
            start = end
        assert {tuple(r) for r in keep.read(spark, df.schema).collect()} == want


def test_texts_for_people_and_addresses(spark):
    from plumbline.functions import text

    df = spark.createDataFrame([(0.125, "http://u:p@Host.example:80/a?b#c"), (None, "no address"), (-0.5, "a b*c~d+é/ü&=")], "x double, u string")
    got = df.select(text.percent("x").alias("p"), text.signed("x", 2).alias("s"), text.url_host("u").alias("h"), text.url_quoted("u").alias("q")).collect()
    assert [r.p for r in got] == ["12.5 %", "withheld", "-50.0 %"] and [r.s for r in got] == ["+0.12", None, "-0.50"]
    assert [r.p for r in spark.createDataFrame([(0.0625,), (0.0015,), (0.00075,)], "x double").select(text.percent("x").alias("p")).collect()] == [f"{100 * x:.1f} %" for x in (0.0625, 0.0015, 0.00075)]
    assert [r.h for r in got] == ["host.example", None, None] and got[2].q == "a%20b%2Ac~d%2B%C3%A9%2F%C3%BC%26%3D"


def test_reference_of_one_class(spark):
    from plumbline.operators.shift import reference_rows

    s = spark.createDataFrame([("human", 1.0), ("ai", 2.0), ("ai", 3.0)], "label string, score double")
    assert [reference_rows(s, m).count() for m in ("all", "human", "ai")] == [3, 1, 2]
    with pytest.raises(ValueError):
        reference_rows(s, "robots")
