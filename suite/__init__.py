"""Registered queries: every operator run on the test tables, beside the SQL it must agree with."""

from __future__ import annotations

import importlib

from suite.registry import ORACLES, QUERIES

for _part in ("exact", "sampled", "sketched", "analysis", "files", "runs", "text", "live"):
    importlib.import_module(f"suite.{_part}")

__all__ = ["ORACLES", "QUERIES"]
