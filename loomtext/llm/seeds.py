"""Content-defined seeds of fixed-length windows.

Among the ``gram``-unit hashes inside a window of ``length`` units the smallest is the window's
seed. Consecutive windows with the same seed form a run; its content is the units that its windows
cover. Seed and content of a window depend on that window only, so equal windows always meet at
equal seeds, wherever their documents differ around them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from loomtext.llm.units import Spans, sliding


class Runs(NamedTuple):
    doc: np.ndarray  # index of the document in the batch
    start: np.ndarray  # first window of the run, as an offset into the batch's units
    count: np.ndarray  # windows in the run
    seed: np.ndarray
    content: np.ndarray  # 64-bit hash of all units of the run
    loops: np.ndarray  # the seed's gram occurs twice there, so windows of the run may be equal


def seed_runs(units: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[Runs, Spans]:
    """The runs of all windows of ``length`` units that lie within a document. ``bounds``: len(documents) + 1 offsets."""
    spans = Spans(units)
    width = length - gram + 1
    grams = spans.rolling(gram)
    seeds = sliding(grams, width, np.minimum)
    n = len(seeds)
    none = np.zeros(0, np.int64)
    if not n:
        return Runs(none, none, none, grams[:0], grams[:0], none.astype(bool)), spans
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, bounds[:-1][sizes > 0], 1)
    np.add.at(valid, (bounds[:-1] + sizes)[sizes > 0], -1)
    valid = np.cumsum(valid[:-1]) > 0
    change = np.ones(n, bool)
    change[1:] = (seeds[1:] != seeds[:-1]) | ~valid[:-1]
    change[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(change & valid)
    stops = np.flatnonzero((change | ~valid)[1:] & valid[:-1]) + 1
    if valid[-1]:
        stops = np.append(stops, n)
    # a run of more windows than a gram can have without ties is cut, which keeps contents short
    pieces = -(-(stops - starts) // width)
    long = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(long)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = starts[long] + nth * width
    count = np.minimum(stops[long] - start, width)
    chosen = np.zeros(len(grams), bool)
    chosen[width - 1 : width - 1 + n - width + 1] = sliding(seeds, width, np.maximum) == grams[width - 1 : n] if n >= width else False
    at = np.flatnonzero(chosen)
    tie = np.zeros(len(at) + 1, np.int64)
    if len(at) > 1:
        tie[1:-1] = np.cumsum((grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] <= width))
        tie[-1] = tie[-2]
    doc = np.searchsorted(bounds, start, side="right") - 1
    low, high = np.searchsorted(at, start), np.searchsorted(at, start + count + width - 1)
    # places near a document's ends, where whole neighbourhoods are missing, count as ties when in doubt
    edge = (start - bounds[doc] < 2 * width) | (bounds[doc + 1] - (start + count) < 2 * width + gram)
    loops = (tie[np.maximum(high - 1, 0)] > tie[low]) & (high - low > 1)
    if edge.any():
        loops[edge] |= _tied(grams, start[edge], count[edge] + width - 1, seeds[start[edge]])
    return Runs(doc, start, count, seeds[start], spans.hash(start, start + count + length - 1), loops), spans


def _tied(grams: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Whether the seed occurs twice among the ``size`` grams from ``start``."""
    hit = np.zeros(len(start), np.int64)
    for i in range(int(size.max(initial=0))):
        ok = i < size
        hit[ok] += grams[start[ok] + i] == seed[ok]
    return hit > 1
