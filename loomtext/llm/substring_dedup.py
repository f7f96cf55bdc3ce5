"""Substring deduplication by seed and extension over winnowed word anchors.

Anchors are word grams that a winnowing rule selects, at least one in every window of
``window`` words. Documents meet at equal anchors. Places of an anchor that agree over its whole run of windows are
one, and the first stands for all; the others are joined on the anchor and extended word by word to the left and to
the right (``extend.py``), and what agrees over at least ``window`` words is a repeat. Maximal repeats are unions of
such windows; all but the first occurrence go.

Defined results: a null text has no words; a document with fewer than ``window`` words is kept;
doc_id null sorts last, rows with one doc_id are judged in the order of their texts; repeated rows
are copies like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm.extend import CROWD, extended, word_symbols
from loomtext.llm.repeats import PACKED_ROW, STRETCH, alone_runs, first_runs, long_lists, removed_units, unzipped, zipped
from loomtext.llm.runtime import KEY, keyed, released, unkeyed
from loomtext.llm.units import batch_bytes, word_units, words

GRAM = 6


def _units(texts: pa.Array) -> tuple[Callable, np.ndarray]:
    raw, bounds = batch_bytes(texts)
    starts, ends, of_docs = words(raw, bounds)

    def units(a: int, b: int) -> np.ndarray:
        if a == b:
            return np.zeros(0, np.uint64)
        low, high = starts[a], ends[b - 1]
        return word_units(raw[low:high], starts[a:b] - low, ends[a:b] - low)

    return units, of_docs


def _cuts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    return word_units(raw, starts, ends), starts, ends


def _kept(window: int, with_text: bool) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, left = [], [], [], []
            for text, alone, more in zip(unzipped(batch.column("packed")), alone_runs(batch.column("runs")), long_lists(batch.column("more")), strict=True):
                own = text.split()
                gone = removed_units(len(own), window, alone, more)
                n_words.append(len(own))
                n_removed.append(int(gone.sum()))
                rest = b" ".join([own[i] for i in np.flatnonzero(~gone)] if n_removed[-1] else own)
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    left.append(rest)
            out = [batch.column(KEY), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(left, pa.binary()).cast(pa.string())] * with_text, names=[KEY, "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return rows


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = GRAM, with_text: bool = True, crowd: int = CROWD, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on demand, kept (the remaining words, joined by a space)."""
    source, same = keyed(docs.select("doc_id", "text"))
    texts = source.select(KEY, "text")
    packed = texts.mapInArrow(released(zipped), PACKED_ROW)
    runs = first_runs(texts, _units, window, gram, stretch)
    more = extended(runs, packed, window, gram, crowd, _cuts, word_symbols)
    joined = packed.join(runs, KEY, "left").join(more, KEY, "left")
    out = joined.mapInArrow(released(_kept(window, with_text)), f"{KEY} long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return unkeyed(out, source, same)
