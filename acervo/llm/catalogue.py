"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["vectors_q", "records_q", "split_q", "near_copies_q", "lookalikes_q", "leaks_q", "languages_q", "mixing_q", "parties_q"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"acervo.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"acervo.llm.{m}").SQL.items()}
