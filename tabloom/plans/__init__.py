"""Registered queries, one module per part of the operator inventory."""

from __future__ import annotations

from importlib import import_module

from tabloom.plans.registry import ENTRIES, Entry

MODULES = ["flagship", "scans", "quality", "profiles", "derived", "encodings", "targets", "scoring", "stacks", "models", "facts"]


def all_entries() -> dict[str, Entry]:
    for module in MODULES:
        import_module(f"tabloom.plans.{module}")
    return ENTRIES
