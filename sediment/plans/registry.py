"""Registers plans by name."""

from __future__ import annotations


def registry():
    """(plans, SQL of those that SQL can express, decorator that adds a plan under its function's name)."""
    plans: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def register(f):
            plans[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return register

    return plans, oracles, query
