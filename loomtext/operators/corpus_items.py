"""The n-gram families added up over a corpus of any size, without a shuffle.

A corpus has far more n-grams than texts, so n-grams never lie on disk: texts are annotated once and held as numbers in the shared
folder, less than they take as Parquet; each task reads all of them, picks the n-grams that are its own by a hash, adds them up
and gives out the rows. A task owns about ``TOKENS`` places of the texts, so the number of tasks grows with the corpus, and so
does what each reads: the arrays are read once a task, at a few nanoseconds a word.

An n-gram of all words belongs to the task of its first two words; a masked one to the task of its first word that is kept, and a place
with a kept word makes those with masked words before it, too. N-grams that are masked throughout are counted as texts are annotated.
A masked word is the word ``x``, whether the texts have it or not.

A task holds all places of a kept word (some 30 bytes each): a word of a fiftieth of a corpus is the bound of its memory.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import indices as I
from loomtext.shared import fresh_dir
from loomtext.sources import io

#: Places of the texts that a task owns.
TOKENS = 1 << 21
#: Characters of the texts that are held in one frame, and places that are worth a task of their own.
PORTION, LEAST = 1 << 22, 1 << 16
#: Rows of items that go out at once.
ROWS = 1 << 16
MASKS = tuple(m for m, tags in I.MASKED.items() if tags is not None)
LONGEST = max(I.SIZES.values())


def _around(sents: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words of its sentence stand before and after each word."""
    end, place = np.cumsum(sents), np.arange(n)
    return place - np.repeat(end - sents, sents), np.repeat(end, sents) - place - 1


def _frame(flat: I.Flat) -> tuple[bytes, list[int], list[int]]:
    """The texts as numbers of their lemmas with the masks that keep them; of each mask and size the n-grams that are masked
    throughout, and the texts that hold them."""
    kept = np.zeros(len(flat.raw), np.int64)
    for i, mask in enumerate(MASKS):
        kept |= flat.tagged(I.MASKED[mask]).astype(np.int64) << i
    kept[flat.lemma == flat.number.get("x", -1)] = 0
    known, token = np.unique((flat.lemma << len(MASKS)) + kept, return_inverse=True)
    used, lemma = np.unique(known >> len(MASKS), return_inverse=True)
    words = [flat.words[i] for i in used.tolist()]
    sents = np.diff(flat.sents)
    _, after = _around(sents, len(kept))
    k, held = [], []
    for i in range(len(MASKS)):
        for n in I.SIZES.values():
            start = np.flatnonzero(after >= n - 1)
            for j in range(n):
                start = start[kept[start + j] >> i & 1 == 0]
            k.append(len(start))
            held.append(len(np.unique(flat.doc[start])))
    planes = np.ascontiguousarray(token.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    hashes = np.array([zlib.crc32(w.encode(errors="surrogatepass")) for w in words], np.uint32)
    value = (pa.array(words, pa.string()), hashes, lemma.astype(np.int32), (known & ((1 << len(MASKS)) - 1)).astype(np.uint8), planes, sents.astype(np.int32), flat.sizes.astype(np.int32))
    return zstandard.compress(pickle.dumps(value), 3), k, held


def _frames(path: str) -> Iterator[tuple]:
    fs, folder = io._file_system(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.path):
        if info.type == pafs.FileType.File and info.base_name[0] not in "._":
            with fs.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(1):
                    for row in batch.to_pylist():
                        yield row["k"], row["n_docs"], pickle.loads(zstandard.decompress(row["frame"]))


class _Own:
    """What a task owns of the texts: arrays that grow frame by frame, words being numbered at the end. Number 0 is x."""

    def __init__(self):
        self.words: list[pa.Array] = [pa.array(["x"], pa.string())]
        self.size = 1
        self.parts: list[list[np.ndarray]] = []

    def add(self, words: pa.Array, lemma: np.ndarray, token: np.ndarray, at: np.ndarray, after: np.ndarray, *more: np.ndarray) -> None:
        if not len(at):
            return
        each = [lemma[token[np.where(after >= i, at + i, at)]] for i in range(LONGEST)]
        mark = np.zeros(len(words), bool)
        for one in each:
            mark[one] = True
        used = np.flatnonzero(mark)
        number = np.zeros(len(words), np.int32)
        number[used] = np.arange(self.size, self.size + len(used))
        self.words.append(words.take(pa.array(used)))
        self.size += len(used)
        self.parts.append([*[number[one] for one in each], after, *more])

    def columns(self) -> tuple[list[np.ndarray], pa.Array]:
        if not self.parts:
            return [], self.words[0]
        coded = pa.concat_arrays(self.words).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int32)
        out = []
        for i in range(len(self.parts[0])):
            out.append(np.concatenate([p[i] for p in self.parts]))
            for p in self.parts:
                p[i] = None
        return [*[number[x] for x in out[:LONGEST]], *out[LONGEST:]], coded.dictionary


def _picked(path: str, task: int, tasks: int) -> tuple[_Own, _Own, np.ndarray, np.ndarray]:
    """A task's places for n-grams of all words (words, words after, text) and for masked ones (beside them the masks that keep the
    word, those that keep the words after it, and by mask how many masked words stand before it)."""
    low, high = (-(-(i << 32) // tasks) for i in (task, task + 1))
    own = lambda key: (key >= np.uint32(low)) & (key <= np.uint32(high - 1))
    plain, masked, texts = _Own(), _Own(), 0
    k, n_docs = np.zeros((2, len(MASKS) * len(I.SIZES)), np.int64)
    for some_k, some_docs, (words, hashes, lemma, kept, planes, sents, sizes) in _frames(path):
        k += some_k
        n_docs += some_docs
        token = np.ascontiguousarray(planes.T).view("<i4").ravel()
        before, after = _around(sents, len(token))
        ends = np.cumsum(sizes)

        def text(at: np.ndarray, ends=ends, texts=texts) -> np.ndarray:
            return (np.searchsorted(ends, at, "right") + texts).astype(np.int32)

        h = hashes[lemma][token]
        pair = (h[:-1] * np.uint32(0x9E3779B1) + h[1:]) * np.uint32(0x85EBCA6B)
        at = np.flatnonzero(own(pair) & (after[:-1] > 0))
        plain.add(words, lemma, token, at, np.minimum(after[at], LONGEST - 1).astype(np.uint8), text(at))
        at = np.flatnonzero((own(hashes[lemma] * np.uint32(0x85EBCA6B)) & (kept > 0))[token])
        left = np.minimum(after[at], LONGEST - 1).astype(np.uint8)
        follow, lead = np.zeros(len(at), np.uint16), np.zeros(len(at), np.uint16)
        near = [np.where(before[at] >= j, kept[token[np.maximum(at - j, 0)]], 255) for j in range(1, LONGEST)]  # 255: beyond the sentence
        for i in range(1, LONGEST):
            follow |= np.where(left >= i, kept[token[np.where(left >= i, at + i, at)]], 0).astype(np.uint16) << (len(MASKS) * (i - 1))
        for m in range(len(MASKS)):
            still, n = np.ones(len(at), bool), np.zeros(len(at), np.uint16)
            for one in near:
                still &= one >> m & 1 == 0
                n += still
            lead |= n << (2 * m)
        masked.add(words, lemma, token, at, left, text(at), kept[token[at]], follow, lead)
        texts += len(sizes)
    return plain, masked, k, n_docs


def _grams(columns: list[np.ndarray], mask: str, n: int) -> list[np.ndarray]:
    """The words and the text of each occurrence of a family's n-grams at a task's places."""
    words, (after, text, *more) = columns[:LONGEST], columns[LONGEST:]
    if not more:
        at = np.flatnonzero(after >= n - 1)
        return [*[w[at] for w in words[:n]], text[at]]
    kept, follow, lead = more
    m = MASKS.index(mask)
    parts = []
    for x in range(n):  # masked words before the first one that is kept
        at = np.flatnonzero((kept >> m & 1 == 1) & (after >= n - 1 - x) & (lead >> (2 * m) & 3 >= x))
        rest = [np.where(follow[at] >> (len(MASKS) * (i - 1) + m) & 1 == 1, words[i][at], 0) for i in range(1, n - x)]
        parts.append([*[np.zeros(len(at), np.int32)] * x, words[0][at], *rest, text[at]])
    return [np.concatenate(each) for each in zip(*parts, strict=True)]


def corpus_items(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(family, item, k, n_docs): the n-grams of all documents, within sentences, with their occurrences and the rows that hold them."""
    source, _, pieces = I.pieces_of(docs, key)
    spark = docs.sparkSession

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat in pieces(batch, PORTION):
                if len(flat.raw):
                    frame, k, n_docs = _frame(flat)
                    yield pa.RecordBatch.from_arrays([pa.array([len(flat.raw)], pa.int64()), pa.array([k], pa.list_(pa.int64())), pa.array([n_docs], pa.list_(pa.int64())), pa.array([frame], pa.binary())], names=["n", "k", "n_docs", "frame"])

    path = f"{fresh_dir(spark, 'items')}/frames"
    table = io.save_table(source.mapInArrow(held, "n long, k array<long>, n_docs array<long>, frame binary"), path)
    n = table.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-n // TOKENS), min(-(-n // LEAST), 4 * spark.sparkContext.defaultParallelism))
    names = ["family", "item", "k", "n_docs"]

    def batch_of(family: str, items: pa.Array, k: np.ndarray, n_docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(I.NGRAMS.index(family), pa.int32()), len(k)), items, pa.array(k, pa.int64()), pa.array(n_docs, pa.int64())], names=names)

    def added(columns: list[np.ndarray], words: pa.Array, mask: str) -> Iterator[pa.RecordBatch]:
        for size, n in I.SIZES.items():
            (*each, _), k = I._distinct(*_grams(columns, mask, n))
            if not len(k):
                continue
            first = np.flatnonzero(np.append(True, np.any([g[1:] != g[:-1] for g in each], axis=0)))
            total, rows = np.add.reduceat(k, first), np.diff(np.append(first, len(k)))
            each = [g[first] for g in each]
            for at in range(0, len(first), ROWS):
                some = slice(at, at + ROWS)
                texts = pc.binary_join_element_wise(*[words.take(pa.array(g[some])) for g in each], " ")
                yield batch_of(f"{mask}_{size}" if mask else size, texts, total[some], rows[some])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                plain, masked, k, n_docs = _picked(path, task, tasks)
                if task == 0:
                    for i, (mask, (size, n)) in enumerate((m, s) for m in MASKS for s in I.SIZES.items()):
                        if k[i]:
                            yield batch_of(f"{mask}_{size}", pa.array([" ".join(["x"] * n)], pa.string()), k[i : i + 1], n_docs[i : i + 1])
                columns, words = plain.columns()
                del plain
                if columns:
                    yield from added(columns, words, "")
                columns, words = masked.columns()
                del masked
                if columns:
                    for mask in MASKS:
                        yield from added(columns, words, mask)

    found = spark.range(0, tasks, 1, tasks).mapInArrow(rows, "family int, item string, k long, n_docs long")
    return found.select(F.get(F.array(*map(F.lit, I.NGRAMS)), "family").alias("family"), "item", "k", "n_docs")
