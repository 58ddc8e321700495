"""Registered queries: name -> (job, SQL check or None)."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("panel", "ingest", "metrics", "monitor", "reporting", "models")


def registry() -> dict:
    found: dict = {}
    for family in _FAMILIES:
        found.update(import_module(f"{__name__}.{family}").QUERIES)
    return found
