"""Queries by name, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.functions import dialect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function under ``name``, with its oracle (in the shared query text) where there is one."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = dialect.render(oracle, duck=True)
        return f

    return put


def sql(name: str, text: str) -> None:
    """Register a query that is one SQL text in both engines."""
    query(name, text)(lambda spark, sf_dir: dialect.run(spark, sf_dir, text))


from docloom.plans import aggregates, evidence, geometry, headings, joins, kernels, lookup, pairing, sequences, sources, text, validation  # noqa: E402,F401
