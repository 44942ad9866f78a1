"""All queries of the library by name, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("observe", "describe", "sequences", "evaluation", "ingest", "forecasts", "perturbed", "scores", "audits", "fields", "streams", "flows", "exports", "pairs", "series", "serial", "calibrate")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"tessera.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
