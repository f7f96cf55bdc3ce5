"""Folds over the rows of a group in order, for groups of any size.

Rows are dealt out by ranges of (group, order), so a group that fills many partitions is many tasks. Each partition is
first summed up in one small value, as if nothing stood before it; the driver chains these values, one a
partition, into what stands before each partition; then every partition is folded from there. Rows are computed
once, and both passes see the same partitions, since they are read back from the shared folder.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomtext.shared import cut

PART = "__part"


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """The rows by ranges of the order and sorted, with the number of their partition."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def summaries(placed: DataFrame, columns: list[str], summed: Callable[[Iterator[tuple]], Any]) -> list[tuple[int, Any]]:
    """(partition, the value of its rows) in order, a row a partition; ``summed`` sees tuples of the columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def each() -> Iterator[tuple]:
            nonlocal part
            for batch in batches:
                if len(batch):
                    part = batch.column(0)[0].as_py()
                    yield from zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)

        value = summed(each())
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(value)], pa.binary())], names=["part", "value"])

    found = placed.select(PART, *columns).mapInArrow(rows, "part int, value binary").collect()
    return sorted((r["part"], pickle.loads(r["value"])) for r in found)


def folded(placed: DataFrame, columns: list[str], before: dict[int, Any], fold: Callable[[Iterator[tuple], Any], Iterator[tuple]], added: list[StructField]) -> DataFrame:
    """The rows with the columns that ``fold`` gives for each, from what stands before their partition."""
    names = [f.name for f in placed.schema.fields if f.name != PART]
    at = [placed.columns.index(c) for c in columns]
    where = placed.columns.index(PART)
    kinds = [pa.float64() if f.dataType.typeName() == "double" else pa.int64() for f in added]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        made = None

        def each(first: pa.RecordBatch) -> Iterator[tuple]:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                waiting.append(batch)
                yield from zip(*[batch.column(i).to_pylist() for i in at], strict=True)
                batch = next((b for b in batches if len(b)), None)

        start = next((b for b in batches if len(b)), None)
        if start is None:
            return
        made = fold(each(start), before.get(start.column(where)[0].as_py()))
        buffer: list[tuple] = []
        for row in made:
            buffer.append(row)
            while waiting and len(buffer) >= len(waiting[0]):
                batch = waiting.pop(0)
                own, buffer = buffer[: len(batch)], buffer[len(batch) :]
                kept = [c for i, c in enumerate(batch.columns) if i != where]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r[k] for r in own], kind) for k, kind in enumerate(kinds)]], names=[*names, *[f.name for f in added]])

    return placed.mapInArrow(rows, StructType([*[f for f in placed.schema.fields if f.name != PART], *added]))


# --- running sums -----------------------------------------------------------------------------------------------


def running_sums(df: DataFrame, group: str, order: str, values: dict[str, Column]) -> DataFrame:
    """Adds for each value its sum over the rows of the group up to this one."""
    names = list(values)
    placed = in_ranges(df.select("*", *[v.cast("double").alias(f"__v_{n}") for n, v in values.items()]), F.col(group), F.col(order))
    columns = [group, *[f"__v_{n}" for n in names]]

    def summed(rows: Iterator[tuple]) -> tuple:
        first, last, total, single = None, None, np.zeros(len(names)), True
        for i, (g, *v) in enumerate(rows):
            if i == 0:
                first = last = g
            if g != last:
                last, total, single = g, np.zeros(len(names)), False
            total = total + [x or 0.0 for x in v]
        return first, last, total.tolist(), single

    before: dict[int, Any] = {}
    carry: tuple[Any, list[float]] = (None, [0.0] * len(names))
    for part, (first, last, total, single) in summaries(placed, columns, summed):
        before[part] = carry
        goes_on = single and carry[0] == first
        carry = (last, [a + b for a, b in zip(carry[1], total, strict=True)] if goes_on else total)

    def fold(rows: Iterator[tuple], start: tuple[Any, list[float]]) -> Iterator[tuple]:
        own, total = start
        for g, *v in rows:
            if g != own:
                own, total = g, [0.0] * len(names)
            total = [a + (x or 0.0) for a, x in zip(total, v, strict=True)]
            yield tuple(total)

    added = [StructField(n, DoubleType()) for n in names]
    return folded(placed, columns, before, fold, added).drop(*[f"__v_{n}" for n in names])


# --- turns ------------------------------------------------------------------------------------------------------


class Turns(NamedTuple):
    """Where a fold over utterances stands: in which group, after whose words, in which dialogue and turn of it."""

    group: Any = None
    speaker: Any = None
    dialogue: int = 0
    turn: int = 0  # turns of the dialogue that have begun


def _step(state: Turns, group: Any, speaker: Any, most: int | None, fresh: bool) -> tuple[Turns, int, int]:
    """(the state after an utterance, its dialogue, its turn). A dialogue ends with the first utterance of its turn ``most``."""
    if fresh or group != state.group:
        state = Turns(group, None, 0, 0)
    turn = state.turn if state.turn and speaker == state.speaker else state.turn + 1
    closed = most is not None and turn == most
    return Turns(group, speaker, state.dialogue + closed, 0 if closed else turn), state.dialogue, turn


def numbered_turns(utterances: DataFrame, group: str, order: str, most: int | None = None) -> DataFrame:
    """Adds ``dialogue`` and ``turn``: runs of one speaker in a group are turns, from 1; a dialogue has ``most`` turns, if given."""
    placed = in_ranges(utterances, F.col(group), F.col(order))
    columns = [group, "speaker"]

    def summed(rows: Iterator[tuple]) -> tuple:
        """(first group, first speaker, whether there is one group only, the state after the rows by the state before). Of a
        single group every number of open turns at its start is followed, with its first utterance in a new turn or not."""
        first = None
        single, states = True, {}
        for i, (g, speaker) in enumerate(rows):
            if i == 0:
                first = (g, speaker)
                for open_ in range(most or 2):
                    for joins in (False, True):
                        start = Turns(g, speaker if joins else (object(),), 0, open_)
                        states[open_, joins] = _step(start, g, speaker, most, False)[0]
                continue
            if g != first[0] and single:
                single, states = False, {None: Turns()}
            seen: dict[Turns, Turns] = {}
            for k, s in states.items():
                if s not in seen:
                    seen[s] = _step(s, g, speaker, most, False)[0]
                states[k] = seen[s]
        return first, single, states

    before: dict[int, Turns] = {}
    carry = Turns()
    for part, (first, single, states) in summaries(placed, columns, summed):
        before[part] = carry
        if not single:
            carry = states[None]
        else:
            goes_on = first[0] == carry.group and part != min(before)
            open_ = carry.turn if goes_on else 0
            base = min(open_, 1) if most is None else open_
            after = states[base, goes_on and carry.speaker == first[1]]
            shift = open_ - base  # without a limit, turns only add up
            carry = Turns(after.group, after.speaker, after.dialogue + (carry.dialogue if goes_on else 0), after.turn + shift)

    def fold(rows: Iterator[tuple], start: Turns) -> Iterator[tuple]:
        state = start
        fresh = state == Turns()
        for g, speaker in rows:
            state, dialogue, turn = _step(state, g, speaker, most, fresh)
            fresh = False
            yield dialogue, turn

    return folded(placed, columns, before, fold, [StructField("dialogue", LongType()), StructField("turn", LongType())])
