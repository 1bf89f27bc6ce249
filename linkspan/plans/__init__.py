"""Queries over the driver tables, each beside the SQL it is checked against."""

from __future__ import annotations

from . import crypto, files, history, linkage, markup, search, series, sets, text  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
