"""First occurrences of all fixed-length windows of a corpus, found through content-defined seeds.

Every window belongs to a run of windows with one seed (``seeds.py``). Three steps, none of which
forms pairs or collects a group in one task unless the group is small:

1. Runs are grouped by (seed, content); of each group the smallest document is kept. Groups are combined before the
   shuffle, so copies by the thousand shrink to a row a batch. Any other occurrence is a copy as a whole.
2. A first occurrence whose seed has one content only holds windows that occur nowhere earlier.
3. The rest, runs at the rims of repeats, are extended from their anchors to both sides (``extend.py``).

What a document keeps comes back as intervals of windows; every other window also starts earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.runtime import KEY, released
from loomtext.llm.seeds import seed_runs
from loomtext.llm.units import pieces

#: An interval of windows in one long: start << SHIFT | count. Runs hold fewer than 1 << SHIFT windows.
SHIFT = 8
#: Units of a text that are hashed at once, and runs that are combined before a batch of rows goes out.
STRETCH, ROWS = 1 << 18, 1 << 19
#: Declared not null, or filters for nulls would tell equal shuffles apart.
RUN_ROW = f"seed long not null, content long not null, {KEY} long not null, at long not null"
PACKED_ROW = f"{KEY} long not null, packed binary"


def first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Indices of the first row of each distinct combination of keys, ascending."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return np.sort(order[new])  # lexsort is stable: the first of equal keys has the least index


def run_rows(units_of: Callable, length: int, gram: int, stretch: int) -> Callable:
    """mapInArrow function: (key, text) -> a row for each distinct run of about ``ROWS`` runs, at its first place among them: copies
    are combined before the shuffle."""

    def made(parts: list[tuple], keys: np.ndarray) -> pa.RecordBatch:
        doc, start, count, seed, content, loops = map(np.concatenate, zip(*parts, strict=True))
        key = keys[doc].astype(np.int64)
        order = np.lexsort((start, key, content, seed))
        seed, content = seed[order], content[order]
        one = np.append(True, (seed[1:] != seed[:-1]) | (content[1:] != content[:-1]))
        first = order[one]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(seed[one].view(np.int64)),
                pa.array(content[one].view(np.int64)),
                pa.array(key[first]),
                pa.array((start[first] << SHIFT | count[first]) << 1 | loops[first]),
            ],
            names=["seed", "content", KEY, "at"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            units, bounds = units_of(batch.column(1))
            parts, waiting = [], 0
            for doc, start, end, inner in pieces(bounds, stretch, length - 1):
                runs, _ = seed_runs(units(start, end), inner, length, gram)
                at = runs.doc + doc
                parts.append((at, runs.start + start - bounds[at], runs.count, runs.seed, runs.content, runs.loops))
                waiting += len(at)
                if waiting > ROWS:
                    yield made(parts, keys)
                    parts, waiting = [], 0
            if parts:
                yield made(parts, keys)

    return rows


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as Zstandard frames, for the one shuffle that carries them; further columns go along."""
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        frames = pa.array([pack.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(1).cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), frames, *batch.columns[2:]], names=[KEY, "packed", *batch.schema.names[2:]])


def unzipped(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [b"" if x is None else unpack.decompress(x) for x in column.to_pylist()]


def first_runs(source: DataFrame, units_of: Callable, length: int, gram: int, stretch: int = STRETCH) -> DataFrame:
    """For each document the first occurrences among its runs: ``runs`` array<struct<at, seed, n>>, of which those
    with a seed must still be compared (n runs have it), and ``open``, whether there are any.

    Runs are shuffled once, by seed: the first place of each content, the number of a seed's contents and their join all
    follow from that partitioning. Every consumer asks for the same columns, so that shuffles are written once and reused."""
    runs = source.mapInArrow(released(run_rows(units_of, length, gram, stretch)), RUN_ROW).repartition("seed")
    in_docs = runs.groupBy("seed", "content", KEY).agg(F.min("at").alias("at"))  # a long document comes in several batches
    firsts = in_docs.groupBy("seed", "content").agg(F.min(KEY).alias(KEY), F.min_by("at", KEY).alias("at"))
    contents = firsts.groupBy("seed").agg(F.count(F.coalesce(KEY, "at")).alias("n"))
    several = (F.col("n") > 1) | (F.col("at").bitwiseAND(F.lit(1)) == 1)
    marked = firsts.join(contents, "seed").select(KEY, F.shiftright("at", 1).alias("at"), F.when(several, F.col("seed")).alias("seed"), F.when(several, F.col("n")).alias("n"))
    listed = marked.repartition(KEY).groupBy(KEY).agg(F.collect_list(F.struct("at", "seed", "n")).alias("runs"), F.max(F.col("seed").isNotNull()).alias("open"))
    return listed


def lists_of(column: pa.Array) -> tuple[list[slice], pa.Array]:
    """The slices of a list column's rows, and what they are slices of; a null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return [], column.values
    ends, valid = column.offsets.to_pylist(), column.is_valid().to_pylist()
    return [slice(a, b if ok else a) for a, b, ok in zip(ends[:-1], ends[1:], valid, strict=True)], column.values


def compared_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, at, seed, n) for each row's runs that have a seed, in the order of their starts."""
    rows, flat = lists_of(column)
    seed, at, n = flat.field("seed"), flat.field("at").to_numpy(), flat.field("n")
    some = seed.is_valid().to_numpy(zero_copy_only=False)
    seed, n = seed.fill_null(0).to_numpy(), n.fill_null(0).to_numpy()
    for i, row in enumerate(rows):
        mine = np.flatnonzero(some[row]) + row.start
        mine = mine[np.argsort(at[mine])]
        if len(mine):
            yield i, at[mine], seed[mine], n[mine]


def alone_runs(column: pa.Array) -> list[np.ndarray]:
    """For each row the intervals of runs that need no comparison."""
    rows, flat = lists_of(column)
    at, none = flat.field("at").to_numpy(zero_copy_only=False), flat.field("seed").is_null().to_numpy(zero_copy_only=False)
    return [at[row][none[row]] for row in rows]


def long_lists(column: pa.Array) -> list[np.ndarray]:
    rows, flat = lists_of(column)
    flat = flat.to_numpy(zero_copy_only=False)
    return [flat[row] for row in rows]


def removed_units(n_units: int, length: int, *kept: np.ndarray) -> np.ndarray:
    """True for each unit that a window outside all kept intervals covers."""
    n = n_units - length + 1
    if n <= 0:
        return np.zeros(n_units, bool)
    change = np.zeros(n + 1, np.int32)
    for at in kept:
        if len(at):
            start = at >> SHIFT
            np.add.at(change, start, 1)
            np.add.at(change, start + (at & ((1 << SHIFT) - 1)), -1)
    gone = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int32) == 0)
    cover = np.zeros(n_units + 1, np.int32)
    if len(gone):
        new = np.flatnonzero(np.diff(gone, prepend=-2) > 1)
        cover[gone[new]] += 1
        np.add.at(cover, gone[np.append(new[1:] - 1, len(gone) - 1)] + length, -1)
    return np.cumsum(cover[:-1], dtype=np.int32) > 0
