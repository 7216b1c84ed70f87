"""How a module of plans names its queries and their SQL."""

from __future__ import annotations


class Plans:
    """``queries`` and ``sql`` by name; called with a name (and SQL), it registers the function below."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
