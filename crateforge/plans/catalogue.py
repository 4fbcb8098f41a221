"""All queries of the core and their SQL, collected from the operator modules."""

from __future__ import annotations


def _modules():
    from crateforge.operators import identity, ledger, library, search, state, text_queries

    return (text_queries, identity, library, ledger, search, state)


def queries():
    """Name and callable of every core query."""
    out = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql():
    """DuckDB SQL by query name."""
    out = {}
    for m in _modules():
        out |= m.SQL
    return out
