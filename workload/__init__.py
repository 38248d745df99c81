"""Check queries over the driver tables, one module per operator family."""

from __future__ import annotations

import importlib

MODULES = ("ranking", "genome", "cells", "resampling", "scores", "reports", "files")


def load():
    """All registered queries by name."""
    from workload.registry import QUERIES

    for m in MODULES:
        importlib.import_module(f"workload.{m}")
    return QUERIES
