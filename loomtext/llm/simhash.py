"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most four of 64 bits agree in two of six blocks at least. So the top of
the index are masked patterns, one for each choice of two blocks, and these deal the index out to tasks:
what two fingerprints of a link share lies under one top node. Below a top node fingerprints stand in
the order of their Gray rank and form leaves and, over these, nodes; a node keeps the bits that all its
members share. Going down a pair of nodes, differences accumulate: a child's pattern adds those bits that its parent's did
not fix. The sum is a lower bound of every difference between their members, which rules out whole groups; so
does a component that already holds all of both.

Links are reduced to a spanning forest where they are found, so that a group of n close
fingerprints gives n - 1 edges. A top node with more fingerprints than ``crowd`` is cut into slices by
hash, and each pair of slices is a task's index of its own: the exact way for such nodes.

Defined results: a null or empty text has fingerprint zero, linked like any other; doc_id null sorts
last; rows with one doc_id are documents of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.components import components
from loomtext.llm.runtime import KEY, ROW, carried, cut, hot_join, keyed, released

SEED = 42
BLOCKS = (11, 11, 11, 11, 10, 10)
FANOUT = 16
CROWD = 1 << 16
BATCH = 1 << 15
STRETCH = 1 << 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority of the bits of the XXH64 hashes of all word shingles, repeats included."""
    own = text.lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    size = min(shingle, len(own))
    starts, ends = starts[: len(own) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), STRETCH):
        part = zip(starts[k : k + STRETCH].tolist(), ends[k : k + STRETCH].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), ">u8", min(STRETCH, len(starts) - k))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints(shingle: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(x.as_py() or b"", shingle) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[KEY, "fp"])

    return rows


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected binary Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of each a and b; root[i] is the least member of i's component."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(group: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links within a group; rows stand by group and Gray rank.

    A node's pattern is the bits that all its members share (``known``) and their values. Two nodes carry down the differences
    counted so far, in the bits that both patterns know; a pair of their children adds those in the bits that are
    known anew, and is dropped with all below it once the sum exceeds the distance."""
    n = len(prints)
    root = np.arange(n)
    levels = []  # of each: known bits, their values, first member, end
    of, every, some = group, prints, prints
    while True:
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        sizes = np.diff(np.append(start, len(of)))
        chunks = -(-sizes // FANOUT)
        if levels and (sizes == 1).all():
            break
        nth = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = np.repeat(start, chunks) + nth * FANOUT
        stop = np.minimum(at + FANOUT, np.repeat(start + sizes, chunks))
        every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        of = of[at]
        levels.append((every | ~some, every, at, stop))
        if len(of) == len(start):
            break
    a = np.arange(len(levels[-1][0]))
    b, sofar = a.copy(), np.zeros(len(a), np.int64)
    all_bits = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        known, _, at, stop = levels[depth]
        below, values = levels[depth - 1][:2] if depth else (all_bits, prints)
        found = []
        for k in range(0, len(a), 4096):
            x, y, before = a[k : k + 4096], b[k : k + 4096], sofar[k : k + 4096]
            if depth == 0 and k:  # leaves whose members are all in one component add nothing
                low = np.minimum.reduceat(root, at)
                same = low == np.maximum.reduceat(root, at)
                open_ = ~(same[x] & same[y] & (low[x] == low[y]))
                x, y, before = x[open_], y[open_], before[open_]
            if not len(x):
                continue
            i = at[x][:, None, None] + np.arange(FANOUT)[None, :, None]
            j = at[y][:, None, None] + np.arange(FANOUT)[None, None, :]
            ok = (i < stop[x][:, None, None]) & (j < stop[y][:, None, None]) & ((i < j) if depth == 0 else (i <= j))
            i, j = np.broadcast_arrays(i, j)
            counted = np.broadcast_to((known[x] & known[y])[:, None, None], ok.shape)[ok]
            total = np.broadcast_to(before[:, None, None], ok.shape)[ok]
            i, j = i[ok], j[ok]
            total = total + np.bitwise_count((values[i] ^ values[j]) & below[i] & below[j] & ~counted)
            near = total <= distance
            if depth:
                found.append((i[near], j[near], total[near]))
            else:
                _unite(root, i[near], j[near])
        if depth:
            a, b, sofar = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            close = np.argsort(b - a, kind="stable")  # neighbours in Gray order first: they join most
            a, b, sofar = a[close], b[close], sofar[close]
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def _edges(distance: int) -> Callable:
    """mapInArrow over (top, pattern, x, y, fp), a node's rows together -> edges of links."""

    def of(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(c).to_numpy() for c in ("top", "pattern", "x", "y")]
        prints = table.column("fp").to_numpy().view(np.uint64)
        new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
        group = np.cumsum(new)
        sizes = np.diff(np.append(np.flatnonzero(new), len(group)))
        several = np.repeat(sizes > 1, sizes)
        group, prints = group[several], prints[several]
        order = np.lexsort((gray_rank(prints), group))
        group, prints = group[order], prints[order]
        a, b = forest(group, prints, distance) if len(group) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting < BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.flatnonzero(np.any([(k := table.column(c).to_numpy())[1:] != k[:-1] for c in ("top", "pattern", "x", "y")], axis=0))
            if len(last):
                end = int(last[-1]) + 1
                yield of(table.slice(0, end))
                held, waiting = table.slice(end).to_batches(), waiting - end
            else:
                held = table.to_batches()
        if waiting:
            yield of(pa.Table.from_batches(held).combine_chunks())

    return rows


def _masks(blocks: tuple[int, ...], distance: int) -> list[int]:
    """The masks of all choices of as many blocks as ``distance`` differences must leave whole."""
    at, masks = 0, []
    for size in blocks:
        masks.append(((1 << size) - 1) << at)
        at += size
    return [sum(masks[i] for i in choice) for choice in combinations(range(len(blocks)), len(blocks) - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(prints: DataFrame, distance: int = 4, blocks: tuple[int, ...] = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(fp) distinct -> (node, root) of all fingerprints that are linked to another."""
    tops = F.array(*[F.struct(F.lit(k).alias("top"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("pattern")) for k, mask in enumerate(_masks(blocks, distance))])
    routed = prints.select("fp", F.explode(tops).alias("t")).select("fp", "t.top", "t.pattern")
    crowded = routed.groupBy("top", "pattern").agg(F.count("fp").alias("n")).where(F.col("n") > crowd).select("top", "pattern", F.ceil(F.col("n") / crowd).cast("int").alias("slices"))
    sliced = routed.join(crowded, ["top", "pattern"], "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    dealt = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("top", "pattern", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp")
    node = ["top", "pattern", "x", "y"]
    edges = dealt.repartition(*node).sortWithinPartitions(*node).mapInArrow(released(_edges(distance)), "a long, b long")
    return components(edges)


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, bool]:
    """((``__key``, fp, component), keyed documents, whether the key is the doc_id); component is the
    least key that links reach."""
    source, same = keyed(docs)
    prints = cut(source.select(KEY, "text").mapInArrow(released(_fingerprints(shingle)), f"{KEY} long not null, fp long not null"))
    distinct = cut(prints.groupBy("fp").agg(F.min(KEY).alias("least"), F.count(KEY).alias("n")))
    roots = linked(distinct.select("fp"), distance, crowd=crowd)
    members = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    # copies of one text are one fingerprint, a large group one root: neither may fill a task
    heads = members.groupBy("root").agg(F.min("least").alias("component"), F.count("fp").alias("members"))
    named = hot_join(members, heads, "root", "members", members.count()).select("fp", "component", "n")
    return hot_join(prints, named, "fp", "n", prints.count()).select(KEY, "fp", "component"), source, same


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id that links reach)."""
    found, source, same = simhash_components(docs.select("doc_id", "text"), shingle, distance, crowd)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    if same:
        return found.select(F.col(KEY).alias("doc_id"), hexed, F.col("component").alias("component_id"))
    ids = source.select(KEY, "doc_id")
    return found.join(ids, KEY).join(ids.select(F.col(KEY).alias("component"), F.col("doc_id").alias("component_id")), "component").select("doc_id", hexed, "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The document with the least doc_id of each component, all columns."""
    found, source, _ = simhash_components(carried(docs), shingle, distance)
    kept = found.where(F.col(KEY) == F.col("component")).select(KEY)
    return source.join(kept, KEY, "left_semi").select(f"{ROW}.*")
