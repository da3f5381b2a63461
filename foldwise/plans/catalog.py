"""Loads every module that registers queries."""

from foldwise.plans import (  # noqa: F401
    bins_and_neighbours,
    blends,
    keys_and_groups,
    label_encodings,
    model_runs,
    ordered_and_metrics,
    reference_sample,
    scans_and_rows,
    selection,
    series_and_records,
)
from foldwise.plans.cases import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
