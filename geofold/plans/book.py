"""A module's queries by name, each with its SQL if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def q6(expression: str, name: str = "") -> str:
    """SQL of a rounded number, as geom.r6 rounds it."""
    return f"round({expression}, 6) + 0.0" + (f" AS {name}" if name else "")
