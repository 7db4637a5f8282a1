"""Every registered reconciliation query, with its ANSI SQL twin where SQL can express it."""

from __future__ import annotations

from tallyloom.plans import cards, casework, intake, ledgers, matching, reports, sessions, streams

_MODULES = (matching, ledgers, sessions, reports, intake, streams, casework, cards)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.O.items()}
