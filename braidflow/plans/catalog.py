"""Registered queries of the river-analytics operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from . import along_curves, ensembles, fields, graphs, rasters, relations, trunks  # noqa: F401 - they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
