"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import importlib.util

from .base import QUERIES, SQL

FAMILIES = ("sources", "clean", "joins", "encode", "split", "metrics", "boards", "reshape",
            "steps", "embed", "bars", "ensemble", "predict", "history", "stream", "flagship")


def load():
    for family in FAMILIES:
        if importlib.util.find_spec(f"{__name__}.{family}"):
            importlib.import_module(f"{__name__}.{family}")
    return QUERIES, SQL
