"""Selection by order, size and hash: budgets, splits, ranges, chunks, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators.scan import PART, in_ranges


def row_index(df: DataFrame, *order: Column, name: str = "row") -> DataFrame:
    """Adds the row's place, from 0, in a global order: a range sort, counts of its partitions and local numbers; no
    task sees all rows."""
    return running_sum(df, F.lit(1), *order, name=name, inclusive=False)


def running_sum(df: DataFrame, value: Column, *order: Column, name: str = "running", inclusive: bool = True) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in a global order.

    Two phases: rows are range-partitioned and summed by partition, a row a partition; the sums before each
    partition are joined back, and a window runs within each partition only. Both read the rows from the shared folder."""
    spark = df.sparkSession
    placed = in_ranges(df.withColumn("__v", value.cast("long")), *order)
    sums = sorted((r[PART], r["s"] or 0) for r in placed.groupBy(PART).agg(F.sum("__v").alias("s")).collect())
    before, offsets = 0, []
    for part, s in sums:
        offsets.append((part, before))
        before += s
    table = spark.createDataFrame(offsets or [(0, 0)], f"{PART} int, __before long")
    local = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return placed.join(F.broadcast(table), PART).withColumn(name, F.coalesce(F.sum("__v").over(local), F.lit(0)) + F.col("__before")).drop("__v", PART, "__before")


def token_budget(docs: DataFrame, size: str, budget: int, key: str = "doc_id") -> DataFrame:
    """The longest documents, ties by key, while their sizes add up to the budget at most; with the running total."""
    return running_sum(docs, F.col(size), F.col(size).desc(), F.col(key), name="running").where(F.col("running") <= budget)


def ordinal_split(df: DataFrame, key: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Adds ``split`` by place in the order of key."""
    n = df.count()
    first, second = int(train * n), int((train + valid) * n)
    return row_index(df, F.col(key)).withColumn("split", F.when(F.col("row") < first, "train").when(F.col("row") < second, "validation").otherwise("test")).drop("row")


def iteration_ranges(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds ``iteration``: n // k rows each, the last takes the remainder."""
    size = max(df.count() // k, 1)
    return row_index(df, F.col(key)).withColumn("iteration", F.least(F.floor(F.col("row") / size), F.lit(k - 1)).cast("long")).drop("row")


def hash_split(key: Column, share: float, seed: int = 42) -> Column:
    """Whether a row is in a share of all, the same at each run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def id_chunks(ids: Column, rounds: int) -> Column:
    """An id array in ``rounds`` equal chunks, the last with the remainder."""
    size = F.floor(F.size(ids) / rounds).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda k: F.slice(ids, k * size + 1, F.when(k == rounds - 1, F.size(ids) - k * size).otherwise(size)))


def datapoints(ids: Column, size: int, proportion: float) -> Column:
    """Whole pieces of ``size`` ids as (context, completion); the remainder goes."""
    n = F.floor(F.size(ids) / size).cast("int")
    cut = int(size * proportion)
    return F.when(n < 1, F.expr("CAST(array() AS array<struct<context:array<bigint>,completion:array<bigint>>>)")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.slice(ids, i * size + 1, cut).alias("context"), F.slice(ids, i * size + cut + 1, size - cut).alias("completion")))
    )


def longest_first(rows: DataFrame, batch: str, ids: str, key: str) -> DataFrame:
    """Adds ``place``, from 0: a row's place in its batch by the number of its ids, most first, ties by key."""
    order = Window.partitionBy(batch).orderBy(F.size(ids).desc(), key)
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def row_range(df: DataFrame, key: str, n: int, start: int = 0) -> DataFrame:
    """Rows ``start`` to ``start + n`` in the order of key, fewer where there are fewer."""
    return df.orderBy(key).offset(start).limit(n)


def seeded_take(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that a hash gives, with their place in it."""
    return row_index(hash_sample(df, key, n, seed), F.xxhash64(key, F.lit(seed)), F.col(key), name="place")
