"""A Spark engine for time series of sensors, with operators for text corpora.

Subpackages and names are imported when they are first used.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Names that the package itself offers, and where they live.
_NAMES = {
    "Axis": "core.axis", "Pipeline": "core.step", "make_pipeline": "core.step", "Step": "core.step", "load_table": "sources.tables", "save_table": "sources.tables",
    "enable_logging": "core.logging", "get_logger": "core.logging",
}
_SUBPACKAGES = ("core", "evaluation", "functions", "models", "operators", "plans", "sources", "streaming")


def __getattr__(name: str):
    if name in _SUBPACKAGES:
        return importlib.import_module(f"tidewater.{name}")
    if name in _NAMES:
        return getattr(importlib.import_module(f"tidewater.{_NAMES[name]}"), name)
    raise AttributeError(f"module 'tidewater' has no attribute {name!r}")


def __dir__() -> list[str]:
    return sorted([*globals(), *_SUBPACKAGES, *_NAMES])
