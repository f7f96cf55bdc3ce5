"""Documents that are annotated once and read by several families.

A table of portions: the keys of some documents in one row, beside their arrays (``indices.Flat``) as a Zstandard frame. The families of
``indices.py``, ``synonyms.py``, ``similarity.py`` and ``keywords.py`` take it in place of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from loomtext.operators import indices as I
from loomtext.shared import fresh_dir
from loomtext.sources import io


def hold(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(portion, key: the documents' keys, flat) of documents, saved in the shared folder; held ones as they are."""
    if "flat" in docs.columns:
        return docs
    source, field, pieces = I.pieces_of(docs, key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            for keys, flat in pieces(batch):
                lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), lists, pa.array([I.packed(flat)], pa.binary())], names=["portion", key, "flat"])
                part += 1

    made = source.mapInArrow(rows, StructType([StructField("portion", LongType()), StructField(key, ArrayType(field.dataType)), StructField("flat", BinaryType())]))
    return io.save_table(made, f"{fresh_dir(docs.sparkSession, 'held')}/portions")
