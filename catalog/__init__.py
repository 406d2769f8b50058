"""Registered queries over the driver tables and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

_PARTS = ["etl", "builds", "advice", "groups", "texts", "answers"]


def _merged(attribute: str) -> dict:
    out = {}
    for part in _PARTS:
        out.update(getattr(import_module(f"catalog.{part}"), attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
