"""Registries: queries with their SQL, named transforms, and task handlers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import sql as expand

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **names: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql may hold {view} placeholders."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = expand(sql)
        return f

    return register


class Registry(dict):
    """Named callables, registered by decorator and built from configurations."""

    def register(self, name: str | None = None):
        def put(f):
            key = name or f.__name__
            if key in self:
                raise KeyError(f"{key} is registered already")
            self[key] = f
            return f

        return put

    def build(self, config: dict):
        """A callable DataFrame -> DataFrame from {"type": name, **arguments}."""
        f, how = self[config["type"]], {k: v for k, v in config.items() if k != "type"}
        return lambda df: f(df, **how)

    def compose(self, configs: list[dict]):
        steps = [self.build(c) for c in configs]

        def run(df: DataFrame) -> DataFrame:
            for step in steps:
                df = df.transform(step)
            return df

        return run


TRANSFORMS = Registry()
