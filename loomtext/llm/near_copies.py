"""Near copies by several fingerprints: SimHash and bands of min-hashes retrieve, the exact similarity of shingle sets decides.

A document is its set of five-word shingles (lower-cased bytes, words as in ``simhash``); a text of fewer words is
one shingle. Two documents are linked if the Jaccard similarity of their sets is 0.8 or more. The SimHash fingerprints of the
same shingles go through the Gray-order index (``simhash.py``); what its links join is a bucket. They
reach only four bits, and at 0.8 fingerprints differ in about ten. So each set also gets ``BANDS`` fingerprints of
``ROWS`` min-hashes; two sets of similarity s meet in one of them with the chance 1 - (1 - s ** ROWS) ** BANDS, which
at 0.8 is above 0.9999. Of equal sets the document with the least key stands for all.

Documents with one fingerprint are a bucket, and of buckets with the same members one is kept. A bucket is verified
in one task, all pairs that are not yet joined, on the shingles themselves (64-bit hashes). A bucket with more
than ``ROOM`` shingles or ``CROWD`` documents is cut into slices by hash, and each pair of slices is verified on its own,
so no pair is left out. Links are reduced to a spanning forest where they are found.

Defined results: null and empty texts are equal sets; doc_id null sorts last; rows with one doc_id are documents
of their own; an empty table gives an empty result; other columns are kept and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.components import components
from loomtext.llm.runtime import KEY, ROW, carried, cut, hot_join, keyed, released
from loomtext.llm.simhash import fingerprint, linked
from loomtext.llm.units import Spans, batch_bytes, mix, ranges, salts, word_units, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Bits in which the SimHash fingerprints of a link of the index differ at most.
DISTANCE = 4
ROOM, CROWD = 1 << 19, 1 << 11
STRETCH = 1 << 16
#: Bytes of texts, at most, that are hashed at once (one longer text is hashed alone).
PORTION = 1 << 20
CODEC = "zstd"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTORS = salts(BANDS * ROWS, 3) | np.uint64(1)
SALTS = salts(BANDS, 4)


def portions(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Rows, first and end, whose lengths add up to ``PORTION`` at most, or one row."""
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if i > first and held + n > PORTION:
            yield first, i
            first, held = i, 0
        held += n
    if len(lengths) > first:
        yield first, len(lengths)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    raw = LOWER[raw]
    starts, ends, of_docs = words(raw, bounds)
    units = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), STRETCH):
        a, b = starts[k : k + STRETCH], ends[k : k + STRETCH]
        units[k : k + STRETCH] = word_units(raw[a[0] : b[-1]], a - a[0], b - a[0])
    spans = Spans(units)
    grams = spans.rolling(shingle)
    found = []
    for a, b in zip(of_docs[:-1].tolist(), of_docs[1:].tolist(), strict=True):
        own = grams[a : b - shingle + 1] if b - a >= shingle else spans.hash(np.array([a]), np.array([b])) if b > a else grams[:0]
        found.append(np.unique(own))
    return found


def band_prints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of each set that is not empty: a row a set, a column a band."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    found = np.zeros((len(sets), BANDS), np.uint64)
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + STRETCH)))
        own = np.concatenate(sets[first:last])
        at = ends[first:last] - sizes[first:last] - (ends[first] - sizes[first])
        for k, factor in enumerate(FACTORS):
            band, row = divmod(k, ROWS)
            found[first:last, band] = mix(found[first:last, band] + SALTS[band] + np.minimum.reduceat(own * factor, at) + np.uint64(row))
        first = last
    return found


def _sketches(shingle: int) -> Callable:
    """(key, text) -> (key, shingles, two hashes of the set, SimHash, fingerprints)"""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = batch_bytes(batch.column(1))
            sets = [s for i, j in portions(np.diff(bounds).tolist()) for s in shingle_sets(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle)]
            full = [i for i, s in enumerate(sets) if len(s)]
            prints = band_prints([sets[i] for i in full]).view(np.int64).tolist() if full else []
            bands: list[list[int]] = [[] for _ in sets]
            for i, own in zip(full, prints, strict=True):
                bands[i] = own
            one, two = (pa.array([int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64)) for s in sets], pa.uint64()).view(pa.int64()) for k in (1, 2))
            fp = pa.array([fingerprint(x.as_py() or b"", shingle) for x in batch.column(1).cast(pa.large_binary())], pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), one, two, fp, pa.array(bands, pa.list_(pa.int64()))], names=[KEY, "size", "s1", "s2", "fp", "bands"])

    return rows


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec(CODEC, 6)
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.large_binary())]
        frames = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), frames, pa.array([len(t) for t in texts], pa.int64())], names=[KEY, "frame", "bytes"])


def links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of sets with a Jaccard similarity of at least ``similarity``."""
    sizes = np.array([len(s) for s in sets])
    bounds = np.append(0, np.cumsum(sizes))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(int(ids.max()) + 1, bool)
    of = np.arange(len(sets))
    found = []
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        later = later[(of[later] != of[i]) & (np.minimum(sizes[later], sizes[i]) >= similarity * np.maximum(sizes[later], sizes[i]) - 1e-9)]
        if not len(later):
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        mine[own] = True
        at = np.append(0, np.cumsum(sizes[later])[:-1])
        both = np.add.reduceat(mine[ids[ranges(bounds[later], bounds[later + 1])]].astype(np.int64), at)
        mine[own] = False
        for j in later[both >= similarity * (sizes[later] + sizes[i] - both) - 1e-9].tolist():
            if of[i] != of[j]:
                found.append((i, j))
                of[of == of[j]] = of[i]
    return found


def _edges(shingle: int, similarity: float) -> Callable:
    """mapInArrow over (bucket, x, y, key, frame, bytes), a bucket's rows together -> edges of links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC)
        group: tuple | None = None
        keys: list[int] = []
        sets: list[np.ndarray] = []
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            if len(sets) > 1:
                for i, j in links(sets, similarity):
                    a.append(keys[i])
                    b.append(keys[j])
            keys.clear()
            sets.clear()

        for batch in batches:
            of = list(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True))
            own_keys, frames, lengths = batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist()
            for first, end in portions(lengths):
                texts = pa.array([codec.decompress(frames[i].as_py(), lengths[i], asbytes=True) if lengths[i] else b"" for i in range(first, end)], pa.large_binary())
                for now, key, own in zip(of[first:end], own_keys[first:end], shingle_sets(*batch_bytes(texts), shingle), strict=True):
                    if now != group:
                        close()
                        group = now
                    keys.append(key)
                    sets.append(own)
            if len(a) > STRETCH:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows


def simhash_buckets(several: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, size, bucket) of the documents (key, size, fp) whose fingerprints the index links to others; a bucket is a component."""
    alike = several.groupBy("fp").agg(F.count(KEY).alias("n"))
    roots = linked(alike.select("fp"), distance).select(F.col("node").alias("fp"), "root")
    met = cut(alike.join(roots, "fp", "left").where("n > 1 OR root IS NOT NULL").select("fp", F.xxhash64(F.coalesce("root", "fp"), F.lit("simhash")).alias("bucket"), "n"))
    return hot_join(several, met, "fp", "n", several.count()).select(KEY, "size", "bucket")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, room: int = ROOM, crowd: int = CROWD) -> DataFrame:
    """The document with the least doc_id of each component that links reach, all columns."""
    source, _ = keyed(carried(docs))
    sketched = cut(source.select(KEY, "text").mapInArrow(released(_sketches(shingle)), f"{KEY} long not null, size long, s1 long, s2 long, fp long, bands array<long>"))
    distinct = cut(sketched.groupBy("s1", "s2").agg(F.min(KEY).alias(KEY)).select(KEY))
    own = sketched.join(distinct, KEY, "left_semi").where("size > 0")
    routed = own.select(KEY, "size", F.explode("bands").alias("bucket")).unionByName(simhash_buckets(own.select(KEY, "size", "fp")))
    buckets = routed.groupBy("bucket").agg(F.count(KEY).alias("n"), F.sum("size").alias("weight"), *[F.bit_xor(F.xxhash64(KEY, F.lit(k))).alias(f"m{k}") for k in (1, 2)])
    slices = F.greatest(F.ceil(F.col("weight") / room), F.ceil(F.col("n") / crowd)).cast("int")
    several = buckets.where("n > 1").groupBy("n", "weight", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", slices.alias("slices"))
    mine = F.pmod(F.xxhash64(KEY), F.col("slices")).cast("int")
    dealt = cut(routed.join(several, "bucket").select(KEY, "bucket", "slices", mine.alias("mine")))
    frames = source.join(dealt.select(KEY).distinct(), KEY, "left_semi").select(KEY, "text").mapInArrow(released(_framed), f"{KEY} long, frame binary, bytes long")
    met = dealt.join(frames, KEY).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    node = ["bucket", "x", "y"]
    met = met.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), KEY, "frame", "bytes")
    edges = met.repartition(*node).sortWithinPartitions(*node).mapInArrow(released(_edges(shingle, similarity)), "a long, b long")
    later = components(edges).where("node <> root").select(F.col("node").alias(KEY))
    return source.join(distinct.join(later, KEY, "left_anti"), KEY, "left_semi").select(f"{ROW}.*")
