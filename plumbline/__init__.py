"""Plumbline: Spark-native calibration of scoring instruments and drift watching."""

import importlib

__version__ = "0.1.0"
#: Public names by module. They are imported on first use, so that a Python worker that needs one
#: operator doesn't load them all.
_HOMES = {
    "operators.bounds": ("conformal_band", "conformal_table", "least_sample"),
    "operators.curves": ("auroc", "equal_error_rate", "roc_curve", "threshold_at_fpr"),
    "operators.detectors": ("SCORERS", "ColumnScorer", "Detector"),
    "operators.resample": ("exact_ci", "poisson_auroc_ci", "poisson_rate_ci", "proportion_ci"),
    "operators.strata": ("base_rate_table", "max_disparity", "ppv", "subgroup_rates"),
    "plans.calibrate": ("admission_tables", "calibration_tables"),
    "sources.receipts": ("export_document", "load_report", "write_report"),
    "sources.tables": ("Refusal", "read_candidates", "read_labelled", "read_probes", "read_scores"),
}
_WHERE = {name: home for home, names in _HOMES.items() for name in names}
__all__ = ["__version__", *sorted(_WHERE)]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)


def __dir__():
    return sorted([*globals(), *_WHERE])
