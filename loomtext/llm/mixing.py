"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source has a quota of words, whole passes over the source and a part of one more. The source's documents stand in a random
order that a hash gives, so its quota is a sequence of words in a random order, cut into blocks. Output shards are the
leaves of a binary tree: at each node half of the node's blocks go to either side, and how many of each source is one
draw from the multivariate hypergeometric distribution, so that leaves hold exact quotas of every source which add
up to the source's. A leaf takes the next blocks of each source, disjoint from those of other leaves; a document goes
to the leaf of its first word. The mix itself is shuffled locally: a shard's rows go to one task, which sorts them by
a hash of each copy.

Draws are seeded by (seed, level, node), so reruns agree, and a task that needs some leaves draws the nodes above
them itself: no table of leaves is made in one place. The driver holds one row for each source; documents never
leave the executors. Blocks are single words up to BLOCKS of them, larger beyond (the generator's bound is 10^9).

Defined results: a null text has size 0 and is never taken; a null source is a source, the last; a null
doc_id stays null; rows with one doc_id are drawn each on its own; with no words at all every target is 0;
an empty table gives an empty result; extra columns do no harm, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.runtime import KEY, ROW, carried, cut, hot_join, keyed

WORD = r"[^\x20\x09-\x0D]+"
SEED = 2024
#: Output shards: about DOCS_A_SHARD documents each; a task draws SUBTREE leaves.
MAX_SHARDS, DOCS_A_SHARD, SUBTREE = 1 << 16, 2_000, 64
#: Places in a source's order: DOCS_A_SLOT documents each, MAX_SLOTS at most; running sums go over slots, then within them.
MAX_SLOTS, DOCS_A_SLOT = 1 << 16, 32
BLOCKS = 1 << 29
#: Sources up to which their table is broadcast.
FEW_SOURCES = 100_000


def fill_targets(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``cap`` times its size; what a cap cuts off is shared again by weight."""
    targets: list[float] = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = budget
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def split(blocks: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each source's ``blocks`` half of them all holds, drawn without replacement."""
    return np.random.default_rng(seed).multivariate_hypergeometric(blocks, int(blocks.sum()) // 2, method="marginals")


def leaf_blocks(blocks: np.ndarray, depth: int, first: int, size: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, each source's first block there, its blocks there) for ``size`` leaves from ``first`` on, of a tree with 2**depth
    leaves; both are powers of two or multiples of them, so these leaves are one subtree."""
    def below(level: int, node: int, start: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        width = 1 << (depth - level)  # leaves under the node
        if (node + 1) * width <= first or node * width >= first + size:
            return
        if level == depth:
            yield node, start, own
            return
        left = split(own, (seed, level, node))
        yield from below(level + 1, 2 * node, start, left)
        yield from below(level + 1, 2 * node + 1, start + left, own - left)

    yield from below(0, 0, np.zeros_like(blocks), blocks)


def _leaves(blocks: np.ndarray, depth: int, seed: int) -> Callable:
    """mapInArrow: numbers of subtrees -> (rank, bin, leaf, low, high): where a source's blocks change to another leaf. A bin is
    a source's blocks over the number of leaves, so a leaf's blocks lie in few bins; a row for each of these."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(SUBTREE, 1 << depth)
        width = np.maximum(-(-blocks // (1 << depth)), 1)
        for batch in batches:
            for subtree in batch.column(0).to_pylist():
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for leaf, start, own in leaf_blocks(blocks, depth, subtree * size, size, seed):
                    some = np.flatnonzero(own)
                    low, high = start[some], start[some] + own[some]
                    first, bins = low // width[some], (high - 1) // width[some] - low // width[some] + 1
                    each = np.repeat(np.arange(len(some)), bins)
                    nth = np.arange(len(each)) - np.repeat(np.cumsum(bins) - bins, bins)
                    for column, values in zip(columns, (some[each], first[each] + nth, np.full(len(each), leaf), low[each], high[each]), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns], names=["rank", "bin", "shard", "low", "high"])

    return rows


class Mix(NamedTuple):
    docs: DataFrame  # __key, size, source_size, target, taken
    copies: DataFrame  # __key, copy, words, size, shard
    source: DataFrame  # the documents with their key
    same: bool  # whether the key is the doc_id


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = SEED, blocks: int = BLOCKS, max_slots: int = MAX_SLOTS) -> Mix:
    """What the mix takes of each of ``docs`` (doc_id, text, source), and the output shard of each copy."""
    spark = docs.sparkSession
    source, same = keyed(docs)
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("name")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = cut(source.select(KEY, name, size))
    totals = {r["name"]: r for r in sized.groupBy("name").agg(F.sum("size").alias("size"), F.count("size").alias("n")).collect()}  # a row a source
    names = sorted(totals, key=lambda s: (not s, s))
    sizes = [int(totals[s]["size"]) for s in names]
    targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], share * sum(sizes), cap)
    quotas = [min(round(t), int(cap * n)) for t, n in zip(targets, sizes, strict=True)]
    n_docs = sum(r["n"] for r in totals.values())
    depth = min(max(0, (n_docs // DOCS_A_SHARD).bit_length()), MAX_SHARDS.bit_length() - 1)
    block = max(1, -(-sum(quotas) // blocks))
    counts = np.array([-(-q // block) for q in quotas], np.int64)
    plan = [(s, i, n, t, q, max(1, min(max_slots, totals[s]["n"] // DOCS_A_SLOT)), totals[s]["n"], max(1, -(-int(c) >> depth))) for i, (s, n, t, q, c) in enumerate(zip(names, sizes, targets, quotas, counts, strict=True))]
    table = spark.createDataFrame(plan, "name string, rank long, source_size long, target double, quota long, slots int, n long, width long")
    planned = sized.join(F.broadcast(table), "name") if len(plan) <= FEW_SOURCES else hot_join(sized, table, "name", "n", n_docs)
    # the order of a source: slots by one hash, documents in a slot by another; running sums likewise
    placed = planned.withColumn("slot", F.pmod(F.xxhash64(KEY, F.lit(seed)), F.col("slots"))).withColumn("place", F.xxhash64(F.lit(seed), KEY))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("rank", "slot").agg(F.sum("size").alias("held"))
    starts = held.select("rank", "slot", F.coalesce(F.sum("held").over(earlier("rank").orderBy("slot")), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("size").over(earlier("rank", "slot").orderBy("place", KEY)), F.lit(0))
    ordered = placed.withColumn("within", within).join(starts, ["rank", "slot"]).withColumn("before", F.col("start") + F.col("within"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("passes") * F.col("source_size") - F.col("before")))
    taken = ordered.withColumn("passes", passes).withColumn("part", part)
    marked = cut(taken.select(KEY, "rank", "width", "size", "source_size", "target", "before", "passes", "part", (F.col("passes") * F.col("size") + F.col("part")).alias("taken")))
    numbers = F.sequence(F.lit(0), F.col("passes") - F.when(F.col("part") > 0, 0).otherwise(1))
    each = marked.where("taken > 0").withColumn("copy", F.explode(numbers)).withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("part")))
    each = each.withColumn("block", F.floor((F.col("copy") * F.col("source_size") + F.col("before")) / F.lit(block)).cast("long")).withColumn("bin", F.floor(F.col("block") / F.col("width")).cast("long"))
    leaves = spark.range(max(1, (1 << depth) // SUBTREE)).mapInArrow(_leaves(counts, depth, seed), "rank long, bin long, shard long, low long, high long")
    met = each.join(leaves, ["rank", "bin"]).where("block >= low AND block < high")
    return Mix(marked.select(KEY, "size", "source_size", "target", "taken"), met.select(KEY, F.col("copy").cast("int"), "words", "size", F.col("shard").cast("int")), source, same)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), shards (of each copy, in the order of copies)."""
    found = mix_sizes(docs.select("doc_id", "text", "source"), **options)
    shards = found.copies.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("c")).select(KEY, F.col("c.shard").alias("shards"))
    out = found.docs.join(shards, KEY, "left").select(KEY, "size", "source_size", "target", "taken", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    if found.same:
        return out.withColumnRenamed(KEY, "doc_id")
    return found.source.select(KEY, "doc_id").join(out, KEY).drop(KEY)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document comes once for each pass that takes it
    whole and once more, as its first words joined by a space, for a part; n_chars follows the text. Rows
    of an output shard stand together, shuffled by a hash of (seed, key, copy)."""
    fields = docs.schema.fields
    found = mix_sizes(carried(docs).withColumn("source", F.col(f"{ROW}.source")), **options)
    rows = found.source.select(KEY, ROW).join(found.copies, KEY).repartition("shard")
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(f"{ROW}.text"), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), first_words).otherwise(F.col(f"{ROW}.text"))
    order = F.xxhash64(F.lit(options.get("seed", SEED)), KEY, "copy")
    out = rows.withColumn("mixed", text).sortWithinPartitions("shard", order, KEY, "copy")
    own = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return out.select(*[own.get(f.name, F.col(f"{ROW}.`{f.name}`")).cast(f.dataType).alias(f.name) for f in fields])
