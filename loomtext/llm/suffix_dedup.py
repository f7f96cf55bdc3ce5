"""Byte-level deduplication by prefix-free parsing.

Rolling-hash triggers parse every text into phrases: a trigger is a byte gram whose hash is the
smallest in some window of ``window`` bytes, so each such window holds one, and a phrase is a run of
windows with one trigger, with the bytes they cover. The dictionary holds each distinct phrase once,
under its first place in the corpus; the parse is the list of phrases of each document. A phrase
that repeats is a copy as a whole, by comparing dictionary entries alone; this is what makes
highly repetitive text cheap. What remains are phrases with one trigger at the rims of repeats. For these two orders are
made and combined (``extend.py``): one of what stands before the trigger, the suffixes of the dictionary's phrases that
end there, and one of what follows it, the suffixes of the parse; neighbours' common lengths say which windows are
equal, and the first in corpus order is kept.
Departure from the textbook form: equal windows have equal triggers, so the orders are made trigger by trigger and to
``window`` bytes only; they are never merged into one order of the whole corpus.

Defined results: a null text is empty; texts shorter than ``window`` bytes are kept; doc_id null
sorts last, rows with one doc_id are judged in the order of their texts; repeated rows are copies
like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomtext.llm.extend import CROWD, byte_symbols, extended
from loomtext.llm.repeats import PACKED_ROW, STRETCH, alone_runs, first_runs, long_lists, removed_units, unzipped, zipped
from loomtext.llm.runtime import KEY, ROW, carried, keyed, released, unkeyed
from loomtext.llm.units import batch_bytes

GRAM = 20


def _units(texts: pa.Array) -> tuple[Callable, np.ndarray]:
    raw, bounds = batch_bytes(texts)
    return lambda a, b: raw[a:b], bounds


def _cuts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    return raw, np.arange(len(raw)), np.arange(1, len(raw) + 1)


def _kept(window: int, with_text: bool, carried: list[str]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digest, left = [], [], [], [], []
            for text, alone, more in zip(unzipped(batch.column("packed")), alone_runs(batch.column("runs")), long_lists(batch.column("more")), strict=True):
                gone = removed_units(len(text), window, alone, more)
                n_bytes.append(len(text))
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes() if n_removed[-1] else text
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    left.append(rest.decode("utf-8", "ignore"))
            out = [batch.column(KEY), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(left, pa.string())] * with_text + [batch.column(c) for c in carried], names=[KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text + carried)

    return rows


def _deduped(texts: DataFrame, window: int, gram: int, crowd: int, with_text: bool, stretch: int = STRETCH) -> DataFrame:
    """(``__key``, text) and, it may be, one more column, which comes out again -> the results by key. Both uses of the texts
    ask for all columns, so that one shuffle serves both."""
    more_fields = texts.schema.fields[2:]
    packed = texts.mapInArrow(released(zipped), StructType([*_parse(PACKED_ROW), *more_fields]))
    runs = first_runs(texts.select(KEY, "text"), _units, window, gram, stretch)
    more = extended(runs, packed, window, gram, crowd, _cuts, byte_symbols)
    joined = packed.join(runs, KEY, "left").join(more, KEY, "left")
    out = f"{KEY} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return joined.mapInArrow(released(_kept(window, with_text, [f.name for f in more_fields])), StructType([*_parse(out), *more_fields]))


def _parse(row: str) -> list[StructField]:
    return StructType.fromDDL(row).fields


def suffix_dedup(docs: DataFrame, window: int = 100, gram: int = GRAM, crowd: int = CROWD, with_text: bool = True, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, kept (the remaining bytes; what a cut leaves of a
    character goes)."""
    source, same = keyed(docs.select("doc_id", "text"))
    return unkeyed(_deduped(source.select(KEY, "text"), window, gram, crowd, with_text, stretch), source, same)


def deduped_documents(docs: DataFrame, window: int = 100, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """The documents with what remains of their texts, n_chars to match, all other columns as they are; a document of
    which nothing is left goes, one that was empty stays."""
    fields = docs.schema.fields
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"{ROW}.`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields) if f.name not in ("text", "n_chars")])
    source, _ = keyed(carried(docs))
    found = _deduped(source.select(KEY, "text", others.alias("__others")), window, gram, crowd, True)
    left = found.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[own.get(f.name, F.col(f"__others.c{i}")).alias(f.name) for i, f in enumerate(fields)])
