"""A register of queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with its SQL if there is any."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                # the same hair breaks ties of rounding on both sides
                self.sql[f.__name__] = sql.replace(", 6) AS ", " + 1e-10, 6) AS ")
            return f

        return add


def r6(c: Column | str, name: str) -> Column:
    """A value to six places under a name; a hair is added so that no engine meets a tie."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, 6).alias(name)
