"""Training-data operators over text: one module each, with its registered query and SQL."""

from __future__ import annotations

from importlib import import_module

_PARTS = [
    "toxicity", "bpe", "chat", "sharding", "language", "quality", "repeats", "mixing", "order_minhash", "simhash", "spelling",
    "token_files", "periods",
]


def _merged(attribute: str) -> dict:
    out = {}
    for part in _PARTS:
        out.update(getattr(import_module(f"gradus.llm.{part}"), attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
