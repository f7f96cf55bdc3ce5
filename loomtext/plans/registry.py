"""The table of registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a function under its name with ``q_`` before it, and its SQL unless there is none."""

    def register(f: Callable) -> Callable:
        QUERIES[f"q_{f.__name__}"] = f
        if sql is not None:
            ORACLES[f"q_{f.__name__}"] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal. As the SQL does it, the scaled double is rounded, not its decimal form."""
    scale = 10.0**places
    return df.select(*[(F.round(F.col(c) * scale) / scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
