"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pieces", "neighbours", "encoding", "scans", "setjoin", "sitelines", "packing", "leaks", "stuffing")


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"lexicrux.llm.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
