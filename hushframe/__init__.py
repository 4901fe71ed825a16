"""Detects, replaces, rewrites and audits sensitive entities in text columns of DataFrames."""

from __future__ import annotations

import importlib
import logging

#: Public names and where they are; they are imported when first used, so that Python workers load only what they need.
_WHERE = {
    "Engine": "plans.engine", "Result": "plans.engine", "Config": "plans.config", "Detect": "plans.config", "Evaluate": "plans.config", "Input": "plans.config", "Models": "plans.models", "show": "plans.display",
    "Annotate": "operators.replace", "Hash": "operators.replace", "Redact": "operators.replace", "Substitute": "operators.replace",
    "PrivacyGoal": "operators.rewrite", "Rewrite": "operators.rewrite", "InputError": "sources.tables", "TableError": "sources.tables", "column_step": "plans.columns",
}
__all__ = [*_WHERE, "log_to"]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)


def log_to(level: int | str = logging.INFO) -> None:
    """Shows what runs do, a line a step, on the standard error stream."""
    logger = logging.getLogger(__name__)
    logger.setLevel(level)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(message)s", "%H:%M:%S"))
        logger.addHandler(handler)
