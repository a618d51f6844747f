"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("record", "rules", "texts", "checks", "streams", "published", "landed", "extensions", "stored")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tallyframe.plans.{name}")
