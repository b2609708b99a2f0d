"""The registered training-data queries and their oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil

MODULES = ("q_mixing", "q_chat", "q_urls", "q_quality", "q_lengths", "q_decontaminate", "q_html", "q_lattice", "q_dedup", "q_toxicity")


def _modules():
    here = importlib.import_module(__package__)
    there = {m.name for m in pkgutil.iter_modules(here.__path__)}
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES if m in there]


def queries():
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracles():
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
