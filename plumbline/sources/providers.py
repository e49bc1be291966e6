"""Answer providers for probe runs: a protocol, its gates, and the run itself."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.operators.probes import grade_free_text
from plumbline.operators.sampling import still_to_do
from plumbline.sources.tables import Refusal


@dataclass(frozen=True)
class Decoding:
    """How answers are decoded; greedy by default."""

    temperature: float = 0.0
    top_p: float = 1.0
    top_k: int = 0
    seed: int | None = None
    max_tokens: int = 64

    def fingerprint(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class Provider:
    """Completes prompts. ``load`` runs once in each worker and returns a function from prompts to
    responses; ``local`` providers send nothing off the machine."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list[str]]], capabilities=("complete",), local: bool = True, attestation: str = "opaque"):
        if attestation not in ("verified", "self-reported", "opaque"):
            raise ValueError("attestation is verified, self-reported or opaque")
        self.name, self.load, self.capabilities, self.local, self.attestation = name, load, frozenset(capabilities), local, attestation

    def metadata(self) -> dict:
        return {"provider": self.name, "attestation": self.attestation}

    def require(self, *capabilities: str) -> None:
        missing = sorted(set(capabilities) - self.capabilities)
        if missing:
            raise Refusal(f"{self.name} lacks {', '.join(missing)}")

    def require_local(self, opted_in: bool = False) -> None:
        if not self.local and not opted_in:
            raise Refusal(f"{self.name} sends prompts off this machine; opt in to use it")

    def complete(self, rows: DataFrame, prompt: str = "prompt", out: str = "response") -> DataFrame:
        load = self.load

        @F.pandas_udf("string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            answer = load()
            for part in parts:
                yield pd.Series(answer(part.tolist()), dtype=object)

        return rows.withColumn(out, run(F.col(prompt)))


def instrument(provider: Provider, decoding: Decoding, probe_hash: str, cutoff: str) -> dict:
    """What identifies a probe run."""
    return {**provider.metadata(), "decoding": decoding.fingerprint(), "probes": probe_hash, "cutoff": cutoff}


def run_probes(probes: DataFrame, provider: Provider, done: DataFrame | None = None, opted_in: bool = False) -> DataFrame:
    """Graded answers to the probes that ``done`` doesn't have yet."""
    provider.require("complete")
    provider.require_local(opted_in)
    todo = probes if done is None else still_to_do(probes, done)
    return grade_free_text(provider.complete(todo), aliases="aliases").select("id", "vintage", "response", "normalized", "correct")
