"""Times in query results as numbers: engines name and print timestamp types differently, microseconds since 1970 are the same everywhere."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _as_numbers(f: Query, times: Sequence[str], dates: Sequence[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c: F.unix_micros(df[c].cast("timestamp")) for c in times} | {c: df[c].cast("string") for c in dates})

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def neutral_times(queries: dict[str, Query], sql: dict[str, str], columns: Mapping[str, str]) -> None:
    """For each query its time columns, a date marked by ``/date``: timestamps become microseconds and dates text, in Spark and in SQL."""
    for name, listed in columns.items():
        times = [c for c in listed.split() if not c.endswith("/date")]
        dates = [c[:-5] for c in listed.split() if c.endswith("/date")]
        queries[name] = _as_numbers(queries[name], times, dates)
        changed = ", ".join([f"epoch_us({c}) AS {c}" for c in times] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates])
        sql[name] = f"SELECT * REPLACE ({changed}) FROM ({sql[name]})"
