"""Provenance evidence of files and texts: one row for each scheme that could apply, never a verdict.

A scheme's reader is injected: a function from a file's bytes to what it found, or None for nothing.
What nothing means depends on the scheme: absence only where the reader has just found a probe of its
own in the same carrier."""

from __future__ import annotations

import importlib
import platform
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.operators import watermark
from plumbline.operators.rules import media_kind


class NotFound(LookupError):
    """A reader's typed answer that there is nothing to read: the only error that means absence."""


@dataclass(frozen=True)
class Scheme:
    """A way in which origin can be marked. ``kinds``: media it can be in (none: any file). ``read`` is
    None where there is no reader here, and ``why`` then says so."""

    name: str
    kinds: tuple[str, ...] = ()
    read: Callable[[bytes], dict | None] | None = None
    #: Whether a probe put into this very carrier is found again.
    survives: Callable[[bytes], bool] | None = None
    why: str = ""
    negative: str = "a missing mark says nothing about who made it"


def _outcome(scheme: Scheme, content: bytes) -> tuple[str, str, bool | None]:
    """(status, explanation, whether the self-test passed)."""
    if scheme.read is None:
        return "UNAVAILABLE", scheme.why or "there is no reader here", None
    try:
        found = scheme.read(content)
    except NotFound as none:
        return "ABSENT", f"the reader found none: {none}", True
    except ImportError as missing:
        return "UNAVAILABLE", f"not installed: {missing}", None
    except Exception as error:  # noqa: BLE001 - whatever a reader raises is an answer that decides nothing
        return "INCONCLUSIVE", f"the reader failed: {type(error).__name__}", None
    if found is not None:
        return "PRESENT", "; ".join(f"{k}: {v}" for k, v in sorted(found.items())) or "found", None
    passed = bool(scheme.survives(content)) if scheme.survives else False
    return ("ABSENT" if passed else "INCONCLUSIVE"), ("nothing found, and a probe was" if passed else "nothing found, nor would a probe have been"), passed


_ROWS = "path string, sha256 string, scheme string, status string, explanation string, self_test boolean, negative_meaning string"


def sweep_files(files: DataFrame, schemes: list[Scheme]) -> DataFrame:
    """(path, sha256, scheme, status, explanation, self_test, negative_meaning) of files (path, content):
    a row for each scheme that its suffix admits."""
    known = files.select("path", "content", F.sha2("content", 256).alias("sha256"), media_kind(F.col("path")).alias("kind"))

    def run(parts):
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                for s in schemes:
                    if not s.kinds or r.kind in s.kinds:
                        status, why, passed = _outcome(s, r.content)
                        rows.append((r.path, r.sha256, s.name, status, why, passed, s.negative))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")])

    return known.mapInPandas(run, _ROWS)


def sweep_texts(texts: DataFrame, schemes: list[Scheme], id_col: str, text_col: str) -> DataFrame:
    """(id, chars, sha256, scheme, status, explanation): marks in texts are read with keys that only the
    provider has, so each scheme says so, for every text."""
    told = F.explode(F.array(*(F.struct(F.lit(s.name).alias("scheme"), F.lit(s.why or "the key is the provider's").alias("explanation")) for s in schemes)))
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = texts.select(F.col(id_col).alias("id"), F.char_length(t).alias("chars"), F.sha2(t.cast("binary"), 256).alias("sha256"), told.alias("s"))
    return rows.select("id", "chars", "sha256", "s.scheme", F.lit("UNAVAILABLE").alias("status"), "s.explanation")


def _pixels(content: bytes):
    return watermark.read_png(content)


def _read_mark(content: bytes, payload: bytes) -> dict | None:
    image = _pixels(content)
    if watermark.too_small(*image.shape[:2]):
        return None
    return {"payload": payload.decode("latin-1")} if watermark.decode(image, len(payload)) == payload else None


def _mark_survives(content: bytes, probe: bytes) -> bool:
    image = _pixels(content)
    return not watermark.too_small(*image.shape[:2]) and watermark.decode(watermark.encode(image, probe), len(probe)) == probe


def image_watermark(payload: bytes, probe: bytes = b"plumb") -> Scheme:
    """A mark in the pixels, with the self-test in the image at hand."""
    return Scheme("image-watermark", ("image",), lambda c: _read_mark(c, payload), lambda c: _mark_survives(c, probe), negative="another mark, a resized or recompressed image, or none")


def signed_manifest(read: Callable[[bytes], dict | None] | None = None) -> Scheme:
    """A signed manifest in the file; its reader is a library that isn't here."""
    return Scheme("signed-manifest", (), read, None, "no library for signed manifests is installed", "manifests are lost whenever a file is saved by a program that doesn't keep them")


PORTAL = Scheme("portal-only", ("image", "video", "audio"), why="its detector is a service of the provider, nothing that runs here")
TEXT_SCHEMES = [Scheme("keyed-sampling", ("text",), why="the key is the provider's"), Scheme("keyed-partition", ("text",), why="the key is the provider's")]


def environment(packages: tuple[str, ...] = ("numpy", "pyarrow", "pyspark", "c2pa", "cv2")) -> dict[str, str]:
    """What a sweep ran on: versions of what is installed, and what isn't."""
    found = {"python": platform.python_version()}
    for name in packages:
        try:
            found[name] = str(getattr(importlib.import_module(name), "__version__", "installed"))
        except ImportError:
            found[name] = "not installed"
    return found
