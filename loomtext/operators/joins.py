"""Joins that no frequent key can fill a task with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines, at most, of a table that are broadcast for keys with many rows; a key with fewer rows than LEAST_HOT is none of them.
HOT, LEAST_HOT = 1_000, 1_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The inner join on ``key``, of which ``table`` has each value once, with the number of its ``rows`` in ``count``.

    Keys that hold more than one in ``HOT`` of all ``total`` rows are joined by a broadcast of at most ``HOT`` lines of the table, the
    others by a shuffle, so no task gets all rows of one key."""
    least = max(total // HOT, LEAST_HOT)
    table = table.withColumn("__hot", F.col(count) > least)
    hot = table.where("__hot").select(F.col(key).alias("__k"), *[F.col(c).alias(f"__h_{c}") for c in table.columns if c not in (key, "__hot")])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left")
    names = [c for c in table.columns if c not in (key, "__hot")]
    done = marked.where("__k IS NOT NULL").select(*rows.columns, *[F.col(f"__h_{c}").alias(c) for c in names])
    rest = marked.where("__k IS NULL").select(*rows.columns).join(table.where("NOT __hot").drop("__hot"), key).select(*rows.columns, *names)
    return done.unionByName(rest)


def frequent_join(rows: DataFrame, table: DataFrame, key: str, frequent: DataFrame) -> DataFrame:
    """The inner join on ``key``, of which ``table`` has each value once. Lines of the ``frequent`` keys, a bounded number of them,
    are broadcast, the others meet in a shuffle."""
    names = [c for c in table.columns if c != key]
    few = table.join(F.broadcast(frequent.select(key)), key, "left_semi").select(F.col(key).alias("__k"), *[F.col(c).alias(f"__h_{c}") for c in names])
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("__k"), "left")
    done = marked.where("__k IS NOT NULL").select(*rows.columns, *[F.col(f"__h_{c}").alias(c) for c in names])
    rest = marked.where("__k IS NULL").select(*rows.columns).join(table.join(F.broadcast(frequent.select(key)), key, "left_anti"), key).select(*rows.columns, *names)
    return done.unionByName(rest)
