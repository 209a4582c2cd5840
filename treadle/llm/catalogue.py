"""All queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from treadle.llm import credentials, documentation, handwritten, near_dup, packing, repetition, tokenizing, truncation

MODULES = (handwritten, credentials, documentation, near_dup, tokenizing, packing, repetition, truncation)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
