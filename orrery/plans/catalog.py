"""All queries of the core and their reference SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from ..operators import core_queries, core_sql
from . import answer_queries, data_queries, detail_queries, graph_queries, region_queries, registry, source_queries

__all__ = ["QUERIES", "SQL", "answer_queries", "data_queries", "detail_queries", "graph_queries", "region_queries", "source_queries"]


def presented(f: Callable) -> Callable:
    """A query with the types that every reader of results has: exact decimals
    as doubles, times without a zone."""
    @wraps(f)
    def run(spark, folder):
        df = f(spark, folder)
        to = {c: "double" for c, t in df.dtypes if t.startswith("decimal")} | {c: "timestamp_ntz" for c, t in df.dtypes if t == "timestamp"}
        return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in to.items()}) if to else df

    return run


QUERIES: dict[str, Callable] = {n: presented(f) for n, f in {**core_queries.QUERIES, **registry.QUERIES}.items()}
SQL: dict[str, str] = {**core_sql.SQL, **registry.SQL}
