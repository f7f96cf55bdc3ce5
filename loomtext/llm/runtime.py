"""What the operators share: the cluster's shared folder, cut lineage, document keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.joins import hot_join
from loomtext.shared import cut, fresh_dir, shared_dir

__all__ = ["KEY", "ROW", "bounded_batches", "carried", "cut", "drop_dir", "fresh_dir", "hot_join", "keyed", "released", "shared_dir", "unkeyed"]

KEY, ROW = "__key", "__row"
#: Bytes of rows, about, that go to a Python worker at once, and the setting that says so.
BATCH, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(stage: Callable) -> Callable:
    """The function of (spark, ...) with batches for Python workers of ``BATCH`` bytes at most in its session from then on, a smaller
    setting being kept: a batch stands in the JVM outside its heap, in a buffer of up to twice its size, and again in the
    worker. Batches are no smaller than one row."""

    @wraps(stage)
    def run(spark: SparkSession, *more, **named):
        if int(str(spark.conf.get(BATCH_CONF)).rstrip("b")) > BATCH:
            spark.conf.set(BATCH_CONF, str(BATCH))
        return stage(spark, *more, **named)

    return run


def released(rows: Callable) -> Callable:
    """The mapInArrow function, giving back to the system at its end what the allocators hold: Python workers wait for further
    tasks, beside the JVM in the same executor."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as the struct ``__row``, so that no column of the table can clash with an own one."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """``__key`` long, unique, in the order of doc_id (nulls last), ties in the order of the text, then of all else that
    ``docs`` has, so that reruns agree.

    Where every doc_id is set and unique, which one pass over that column tells, the key is the
    doc_id itself and the second value is true. Otherwise rows are numbered by a range sort and the sizes of its partitions.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    repeated = ids.groupBy("i").count().where("i IS NULL OR count > 1").limit(1).count()
    if not repeated:
        return docs.withColumn(KEY, F.col(id_col).cast("long")), True
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = [F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_last()]
    order += [F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])).asc_nulls_last()] if others else []
    ordered = cut(
        docs.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__n", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33))
    )
    before, shift = 0, []
    for part, n in sorted(map(tuple, ordered.groupBy("__part").count().collect())):  # a row a partition
        shift.append((part, before))
        before += n
    offsets = docs.sparkSession.createDataFrame(shift or [(0, 0)], "__part int, __before long")
    numbered = ordered.join(F.broadcast(offsets), "__part").withColumn(KEY, F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")
    return numbered, False


def unkeyed(out: DataFrame, source: DataFrame, same: bool) -> DataFrame:
    """``__key`` back to doc_id."""
    if same:
        return out.select(F.col(KEY).alias("doc_id"), *[c for c in out.columns if c != KEY])
    return source.select(KEY, "doc_id").join(out, KEY).drop(KEY)
