"""Packing token sequences into fixed windows with non-negative least squares.

Documents are cut into whole windows and a rest of fewer than ``window`` ids. For the rests, all
pairs and a bounded number of triples of lengths that fill a window exactly are enumerated; how often
each is used is the non-negative least-squares solution against the histogram of lengths, found by
multiplicative updates, then rounded down to what is there. Rests that no combination takes are
packed greedily, longest first, and cut where a window ends. The last, unfinished window is cut into
sequences whose lengths are powers of two, which need no padding.

Tasks pack what they read, in stretches of a bounded number of ids, so nothing is shuffled and a
task holds one stretch. A sequence_id is made of the task's partition and a running number.

Defined results: a null text is empty, that is the single id 0; a null doc_id stays null; repeated rows
are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomtext.llm.runtime import released
from loomtext.llm.tokens import default_vocabulary, encoder

WINDOW = 1024
STRETCH = 1 << 22
TRIPLES = 16
ROUNDS = 100
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def combinations_of(counts: np.ndarray, window: int, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``window`` and occur; of the triples with one shortest
    length only the ``triples`` whose scarcest length is most frequent."""
    have = np.flatnonzero(counts[:window])
    have = have[have > 0]
    pairs = have[(have <= window // 2) & (counts[window - have] > 0)]
    rows = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    for a in have[have <= window // 3]:
        b = have[(have >= a) & (have <= (window - a) // 2)]
        b = b[counts[window - a - b] > 0]
        scarce = np.minimum(counts[b], counts[window - a - b])
        b = b[np.argsort(-scarce, kind="stable")[:triples]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(rows)


def repeat_counts(combos: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """How often to use each combination: argmin over x >= 0 of |A x - counts|, by multiplicative updates."""
    if not len(combos):
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0

    def lengths(x: np.ndarray) -> np.ndarray:
        made = sum(np.bincount(combos[:, k], x, len(counts)) for k in range(3))
        made[0] = 0
        return made

    wanted = target[combos].sum(axis=1)
    x = wanted / max(len(combos), 1)
    for _ in range(rounds):
        x *= wanted / np.maximum(lengths(x)[combos].sum(axis=1), 1e-12)
    return x


def pack(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces: every id in one piece, each sequence of ``window`` ids or
    of a power of two."""
    sequences: list[list[tuple[int, int, int]]] = []
    for i in np.flatnonzero(lengths >= window):
        sequences += [[(int(i), int(s), window)] for s in range(0, int(lengths[i]) - window + 1, window)]
    rest = lengths % window
    by_length: dict[int, list[int]] = {}
    for i in np.flatnonzero(rest):
        by_length.setdefault(int(rest[i]), []).append(int(i))
    counts = np.bincount(rest, minlength=window + 1)
    counts[0] = 0
    combos = combinations_of(counts, window)
    uses = repeat_counts(combos, counts)

    def piece(length: int) -> tuple[int, int, int]:
        i = by_length[length].pop()
        return i, int(lengths[i]) - length, length

    for row in np.argsort(-uses, kind="stable"):
        own = [int(v) for v in combos[row] if v]
        times = min(int(uses[row] + 0.5), *(len(by_length[v]) // own.count(v) for v in own))
        sequences += [[piece(v) for v in own] for _ in range(times)]
    open_, room = [], window
    for length in sorted(by_length, reverse=True):
        while by_length[length]:
            i, start, left = piece(length)
            while left:
                take = min(left, room)
                open_.append((i, start, take))
                start, left, room = start + take, left - take, room - take
                if not room:
                    sequences.append(open_)
                    open_, room = [], window
    size = window
    while open_:
        total = sum(p[2] for p in open_)
        while size > total:
            size //= 2
        whole, need = [], size
        while need:
            i, start, left = open_.pop(0)
            take = min(left, need)
            whole.append((i, start, take))
            need -= take
            if take < left:
                open_.insert(0, (i, start + take, left - take))
        sequences.append(whole)
    return sequences


def _pieces(path: str, window: int, stretch: int, closing: int | None) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        held: list[tuple[int | None, np.ndarray]] = []
        waiting = 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in NAMES]
            for sequence in pack(np.array([len(ids) for _, ids in held], np.int64), window):
                offset = 0
                for i, start, length in sequence:
                    doc, ids = held[i]
                    for column, value in zip(columns, (doc, start, length, zlib.crc32(ids[start : start + length]), len(ids), number, offset), strict=True):
                        column.append(value)
                    offset += length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([*own.parts(text.as_py() or ""), [] if closing is None else [closing]]).astype("<u4")
                if len(ids):
                    held.append((doc, ids))
                    waiting += len(ids)
                if waiting >= stretch:
                    yield packed()
                    held, waiting = [], 0
        if held:
            yield packed()

    return rows


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, stretch: int = STRETCH, closing: int | None = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``closing`` is an id put
    after each document."""
    source = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    return source.mapInArrow(released(_pieces(path or default_vocabulary(), window, stretch, closing)), ", ".join(f"{n} long" for n in NAMES))
