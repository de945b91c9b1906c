"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = [f"factline.plans.{m}" for m in ("facts", "observations", "relational", "sequences", "cascades", "pipelines", "more", "audits")]


def load() -> None:
    for name in MODULES:
        importlib.import_module(name)


load()
