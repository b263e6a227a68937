"""Named queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    oracle: str | None = None


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def register(fn: QueryFn) -> QueryFn:
            if name in self._queries:
                raise ValueError(f"query {name!r} is registered twice")
            self._queries[name] = Query(name, fn, oracle)
            return fn

        return register

    def functions(self) -> dict[str, QueryFn]:
        return {k: q.fn for k, q in self._queries.items()}

    def oracles(self) -> dict[str, str]:
        return {k: q.oracle for k, q in self._queries.items() if q.oracle}


#: The queries of the retrieval engine itself.
core = Registry()
