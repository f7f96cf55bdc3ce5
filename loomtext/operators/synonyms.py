"""Synonym overlap of adjacent segments, for lexicons of any size.

Texts are annotated once, a portion of some documents at a time. A portion's tokens are kept as numbers in a Zstandard frame, beside
the list of its distinct words; only these words meet the lexicon in a join, and what it says of them comes back to the portion in
one row. So what is shuffled grows with the words of portions, not with segments, levels, classes and synonyms of each. A lexicon that fits
a task can be broadcast instead (``lookup``, ``overlap_family``), so that nothing is shuffled.

Defined results: a word without an entry is its own synonym; each of repeated entries counts; a null key stays null; rows with one
key have a result each; a document of fewer than two segments has 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomtext.operators import indices as I
from loomtext.shared import fresh_dir
from loomtext.sources import io

LEVELS = ("sent", "para")
#: Characters of the documents whose words meet the lexicon together.
PORTION = 1 << 22


def _tokens(flat: I.Flat, classes: dict[str, tuple[str, ...]]) -> tuple[dict, pa.Array]:
    """The tokens of the classes (segments of each level, word, classes) with the bounds of documents, and the distinct words."""
    marks = np.zeros(len(flat.raw), np.uint8)
    for i, tags in enumerate(classes.values()):
        marks |= (flat.tagged(tags) & (~flat.aux if "VB" in tags else True)).astype(np.uint8) << i
    keep = np.flatnonzero(marks)
    known, word = np.unique(flat.lemma[keep], return_inverse=True)
    steps = {level: np.diff(of[keep], prepend=0).astype(np.int32) for level, of in (("sent", flat.sent), ("para", flat.para))}
    held = {"bounds": {"sent": flat.doc_sents, "para": flat.docs}, "steps": steps, "word": word.astype(np.int32), "marks": marks[keep]}
    return held, pa.array(flat.words, pa.string()).take(pa.array(known, pa.int64()))


def _portions(key: str, pieces: Callable, classes: dict[str, tuple[str, ...]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            for own, flat in pieces(batch, PORTION):
                held, words = _tokens(flat, classes)
                frame = zstandard.compress(pickle.dumps(held), 6)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([pa.field(key, own.type)])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([own], names=[key]))
                lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([frame], pa.binary()), lists], names=["portion", "keys", "frame", "words"])
                part += 1

    return rows


def _links(words: pa.Array, at: np.ndarray, syns: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its synonyms among the words: bounds and their numbers; ``at`` is the word of each entry."""
    own, of = np.arange(len(words)), np.zeros(0, np.int64)
    to = of
    if len(at):
        own = np.setdiff1d(own, at)
        row = pc.list_parent_indices(syns).to_numpy().astype(np.int64)
        hit = pc.index_in(syns.flatten().cast(pa.string()), value_set=words.cast(pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        (row, to), _ = I._distinct(row[hit >= 0], hit[hit >= 0])
        of = at[row]
    of, to = np.append(own, of), np.append(own, to)
    order = np.argsort(of, kind="stable")
    return np.searchsorted(of[order], np.arange(len(words) + 1)), to[order]


def _scores(held: dict, words: pa.Array, at: np.ndarray, syns: pa.ListArray, classes: dict[str, tuple[str, ...]]) -> dict[str, np.ndarray]:
    first, to = _links(words, at, syns)
    width, out = max(len(words), 1), {}
    for level in LEVELS:
        bounds, segment = held["bounds"][level], np.cumsum(held["steps"][level], dtype=np.int64)
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        for i, name in enumerate(classes):
            keep = (held["marks"] >> i & 1).astype(bool)
            keys, k = np.unique(segment[keep] * width + held["word"][keep], return_counts=True)
            seg, word = keys // width, keys % width
            each = first[word + 1] - first[word]
            at = np.repeat(np.arange(len(keys)), each)
            place = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each) + first[word[at]]
            wanted = (seg[at] - 1) * width + to[place]
            met = np.searchsorted(keys, wanted)
            ok = (keys[np.minimum(met, len(keys) - 1)] == wanted) & (seg[at] > bounds[doc[seg[at]]]) if len(at) else np.zeros(0, bool)
            total = np.bincount(doc[seg[at[ok]]], k[at[ok]], len(n)) if len(n) else np.zeros(0)
            out[f"syn_overlap_{level}_{name}"] = np.where(n < 2, 0.0, total / np.maximum(n - 1, 1))
    return out


def _overlaps(key: str, classes: dict[str, tuple[str, ...]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys = pa.ipc.open_stream(batch.column("keys")[i].as_py()).read_all().column(0).combine_chunks()
                words, entries = batch.column("words")[i].values, batch.column("entries")[i].values
                at, syns = (np.zeros(0, np.int64), pa.array([], pa.list_(pa.string()))) if entries is None else (entries.field("i").to_numpy().astype(np.int64), entries.field("syns"))
                found = _scores(pickle.loads(zstandard.decompress(batch.column("frame")[i].as_py())), words, at, syns, classes)
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.float64()) for x in found.values()]], names=[key, *found])

    return rows


#: Bytes, at most, of a lexicon that every task may hold; larger ones meet the words of portions in a join.
BYTES = 1 << 26


def lookup(synonyms: DataFrame) -> Broadcast | None:
    """The entries of (word, syns) as arrays for every task, or None if they are more than ``BYTES``."""
    entries = synonyms.where("word IS NOT NULL AND syns IS NOT NULL").select("word", "syns")
    size = F.octet_length("word") + F.octet_length(F.concat_ws("", "syns")) + 4 * F.size("syns") + 8
    if (entries.agg(F.sum(size)).first()[0] or 0) > BYTES:
        return None
    table = entries.toArrow()
    return synonyms.sparkSession.sparkContext.broadcast((table.column("word").combine_chunks().cast(pa.string()), table.column("syns").combine_chunks().cast(pa.list_(pa.string()))))


def overlap_family(known: Broadcast, classes: dict[str, tuple[str, ...]]) -> Callable:
    """A family of indices for ``indices.indices``: those of ``synonym_overlaps``, for a lexicon that is broadcast."""

    def family(flat: I.Flat, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        held, words = _tokens(flat, classes)
        heads, syns = known.value
        at = pc.index_in(heads, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lines = np.flatnonzero(at >= 0)
        return _scores(held, words, at[lines], syns.take(pa.array(lines)), classes)

    return family


def synonym_overlaps(docs: DataFrame, synonyms: DataFrame, classes: dict[str, tuple[str, ...]], key: str = "doc_id") -> DataFrame:
    """(key, syn_overlap_{level}_{class}) of sentences and paragraphs, for classes given by their tags (``verb`` tags leave auxiliaries
    out): for each distinct word of a segment the tokens of the next whose synonyms hold it, by segments less one."""
    source, field, pieces = I.pieces_of(docs, key)
    made = source.mapInArrow(_portions(key, pieces, classes), "portion long, keys binary, frame binary, words array<string>")
    table = io.save_table(made, f"{fresh_dir(docs.sparkSession, 'synonyms')}/portions")
    spread = table.select("portion", F.posexplode("words").alias("i", "word"))
    entries = spread.join(synonyms.where("syns IS NOT NULL").select("word", "syns"), "word").select("portion", F.struct("i", "syns").alias("e"))
    listed = entries.groupBy("portion").agg(F.collect_list("e").alias("entries"))
    names = [f"syn_overlap_{level}_{c}" for level in LEVELS for c in classes]
    fields = [field, *[StructField(n, DoubleType()) for n in names]]
    return table.join(listed, "portion", "left").select("keys", "frame", "words", "entries").mapInArrow(_overlaps(key, classes), StructType(fields))
