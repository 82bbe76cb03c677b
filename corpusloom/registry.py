"""Every query of the library by name, with the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

import importlib

FAMILIES: list[str] = ["retrieval", "hybrid", "evaluation", "cleaning", "ingest", "state", "text", "sources", "streams", "composites", "judging", "star"]


def _modules():
    return [importlib.import_module(f"corpusloom.plans.{name}") for name in FAMILIES]


def queries() -> dict:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
