"""Registered queries; :func:`load` imports every plan module once."""

import importlib

MODULES = ["text_plans", "gate_plans", "dedup_plans", "resolve_plans", "score_plans", "report_plans", "extract_plans", "stream_plans"]


def load():
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.registry")
