"""Matches extended to both sides of an anchor, for all places of the anchor at once.

Runs of windows that share an anchor (``seeds.py``) but not all of their units meet in one task. There the units after
each place of the anchor are sorted as suffixes, and the units before it, read backwards, likewise; neighbours' common
lengths tell, for every depth, which places agree so far. A window with ``o`` units before its anchor equals
another if both agree to depth ``o`` on the left and to the window's end on the right. Units are compared
themselves, no hash decides here, and no pairs are formed: a group of n places costs two sorts of n rows.

An anchor with more than ``crowd`` different runs is lengthened before the runs meet: each distinct window of
such a run is dealt out by the hash of the whole window, combined map-side, and compared by the same code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.repeats import SHIFT, compared_runs, first_of_each, unzipped
from loomtext.llm.runtime import KEY, released
from loomtext.llm.units import Spans, batch_bytes, mix, ranges, word_units, words

#: Different runs of one anchor beyond which windows, not runs, are dealt out.
CROWD = 1 << 14
#: Runs compared at once; a group of them is never cut.
CHUNK = 4096
DEALT = f"deal long, {KEY} long, at long, content binary"

#: texts of a batch -> (symbols, each text's bounds in these, hashed units to find anchors by)
SymbolsOf = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: a text -> (hashed units, first byte of each, end of each)
CutsOf = Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _dealt(window: int, crowd: int, cuts_of: CutsOf) -> Callable:
    """mapInArrow: documents with runs to compare -> their runs' bytes, dealt by anchor; of a crowded anchor each
    distinct window, dealt by its own hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << SHIFT) - 1
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = unzipped(batch.column(1))
            deal, key, place, content, crowded, held = [], [], [], [], [], {}
            for i, at, seed, n in compared_runs(batch.column(2)):
                units, first, end = cuts_of(texts[i])
                start, count = at >> SHIFT, at & low
                hot = n > crowd
                for k in np.flatnonzero(~hot).tolist():
                    deal.append(int(seed[k]))
                    key.append(int(keys[i]))
                    place.append(int(at[k]))
                    content.append(texts[i][first[start[k]] : end[start[k] + count[k] + window - 2]])
                for k in np.flatnonzero(hot).tolist():
                    whole = Spans(units[start[k] : start[k] + count[k] + window - 1]).rolling(window)
                    crowded.append((mix(whole ^ np.uint64(int(seed[k]) & (1 << 64) - 1)).view(np.int64), np.full(len(whole), keys[i], np.int64), start[k] + np.arange(len(whole)), np.full(len(whole), i)))
                    held[i] = first, end
            if crowded:
                hashes, k, start, doc = map(np.concatenate, zip(*crowded, strict=True))
                order = np.lexsort((start, k))
                hashes, k, start, doc = hashes[order], k[order], start[order], doc[order]
                for j in first_of_each(hashes).tolist():
                    first, end = held[int(doc[j])]
                    deal.append(int(hashes[j]))
                    key.append(int(k[j]))
                    place.append(int(start[j]) << SHIFT | 1)
                    content.append(texts[doc[j]][first[start[j]] : end[start[j] + window - 1]])
            if deal:
                yield pa.RecordBatch.from_arrays([pa.array(deal, pa.int64()), pa.array(key, pa.int64()), pa.array(place, pa.int64()), pa.array(content, pa.binary())], names=["deal", KEY, "at", "content"])

    return rows


def _sorted(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of symbols: each row's place in their order, and by depth and place the number of the class of rows
    that agree to that depth."""
    n, width = matrix.shape
    if not n or not width:
        return np.arange(n), np.zeros((width + 1, n), np.int32)
    whole = np.ascontiguousarray(matrix).view(f"S{width * matrix.itemsize}")[:, 0]
    order = np.argsort(whole, kind="stable")
    differ = matrix[order[1:]] != matrix[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)  # of neighbours
    classes = np.zeros((width + 1, n), np.int32)
    np.cumsum(common[None, :] < np.arange(width + 1)[:, None], axis=1, dtype=np.int32, out=classes[:, 1:])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, classes


def first_windows(symbols: np.ndarray, bounds: np.ndarray, units: np.ndarray, count: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window within the row) of the first of equal windows, rows standing in corpus order. A row is a run of
    ``count`` windows with one anchor. ``symbols`` are unsigned big-endian numbers from 1."""
    grams = Spans(units).rolling(gram)
    inner = np.diff(bounds) - gram + 1
    at = ranges(bounds[:-1], bounds[:-1] + inner)
    heads = np.cumsum(inner) - inner
    least = np.minimum.reduceat(grams[at], heads)
    anchors = at[grams[at] == np.repeat(least, inner)]
    of = np.searchsorted(bounds, anchors, side="right") - 1
    depth = window - gram

    def beside(offsets: np.ndarray) -> np.ndarray:
        place = anchors[:, None] + offsets[None, :]
        inside = (place >= bounds[of][:, None]) & (place < bounds[of + 1][:, None])
        return np.where(inside, symbols[np.clip(place, 0, len(symbols) - 1)], symbols.dtype.type(0)).astype(symbols.dtype)

    left, left_class = _sorted(beside(-1 - np.arange(depth)))
    right, right_class = _sorted(beside(np.arange(window)))
    places = ranges(bounds[:-1], bounds[:-1] + count)
    row = np.repeat(np.arange(len(count)), count)
    own = np.searchsorted(anchors, places)
    before = anchors[own] - places
    same = before << 56 | left_class[before, left[own]].astype(np.int64) << 28 | right_class[window - before, right[own]]
    order = np.argsort(same, kind="stable")
    new = np.append(True, same[order[1:]] != same[order[:-1]])
    kept = np.sort(order[new])
    return row[kept], (places - bounds[row])[kept]


def _compared(window: int, gram: int, symbols_of: SymbolsOf) -> Callable:
    """mapInArrow over runs sorted by their deal -> (key, at): intervals of windows that start first."""

    def first(table: pa.Table) -> pa.RecordBatch:
        keys, at = table.column(KEY).to_numpy(), table.column("at").to_numpy()
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        symbols, bounds, units = symbols_of(table.column("content").take(pa.array(order)))
        row, nth = first_windows(symbols, bounds, units, at & ((1 << SHIFT) - 1), window, gram)
        head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)))
        size = np.diff(np.append(head, len(row)))
        start = (at[row[head]] >> SHIFT) + nth[head]
        return pa.RecordBatch.from_arrays([pa.array(keys[row[head]]), pa.array(start << SHIFT | size)], names=[KEY, "at"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            deal = table.column("deal").to_numpy()
            cuts = np.flatnonzero(deal[1:] != deal[:-1]) + 1  # a group that may go on stays
            begin = 0
            while len(cuts) and (later := cuts[cuts > begin]).size and waiting - begin >= CHUNK:
                end = int(later[max(0, np.searchsorted(later, begin + CHUNK, side="right") - 1)])
                yield first(table.slice(begin, end - begin))
                begin = end
            held = table.slice(begin).to_batches()
            waiting -= begin
        if waiting:
            yield first(pa.Table.from_batches(held))

    return rows


def extended(runs: DataFrame, packed: DataFrame, window: int, gram: int, crowd: int, cuts_of: CutsOf, symbols_of: SymbolsOf) -> DataFrame:
    """(``__key``, more array<long>): of the runs that must be compared, the intervals of windows that start first."""
    met = runs.where("open").join(packed, KEY).select(KEY, "packed", "runs", *[c for c in packed.columns if c not in (KEY, "packed")])
    dealt = met.mapInArrow(released(_dealt(window, crowd, cuts_of)), DEALT)
    firsts = dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(released(_compared(window, gram, symbols_of)), f"{KEY} long, at long")
    return firsts.repartition(KEY).groupBy(KEY).agg(F.collect_list("at").alias("more"))


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, bounds = batch_bytes(texts)
    return raw + np.uint8(1), bounds, raw  # no byte of UTF-8 is 255


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words numbered by their bytes."""
    raw, bounds = batch_bytes(texts)
    starts, ends, of_rows = words(raw, bounds)
    at = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    letters = np.ascontiguousarray(raw[ranges(starts, ends)])
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    numbers = each.dictionary_encode().indices.to_numpy()
    return (numbers + 1).astype(">u4"), of_rows, word_units(raw, starts, ends)
