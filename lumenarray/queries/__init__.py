"""Registered queries and their SQL: name -> callable, name -> text."""

from __future__ import annotations

from lumenarray.queries import arrays, kernels, ledger, problems

MODULES = [problems, arrays, kernels, ledger]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
