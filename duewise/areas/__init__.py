"""Registration of the queries by area."""

from __future__ import annotations

import importlib

AREAS = ["layers", "daily", "findings", "drivers", "modelling", "messages", "lookups", "reporting", "soundness"]


def register_all() -> None:
    for name in AREAS:
        importlib.import_module(f"duewise.areas.{name}").register()
