"""Keyword shares of texts against their sources, for corpora of any size.

A source's keywords are found where its text is annotated: of its items those that stand twice are candidates. Candidates of a portion
of sources are kept as numbers, beside the distinct items whose frequency decides a rank; only these meet the reference in
a join, and what it says of them comes back to the portion in one row. Where a source has no more candidates than keywords, all are keywords and
nothing is asked. Texts are annotated once, too, and held in portions (``held.py``); keywords come to them by key, as numbers beside a
source's distinct words, and shares are counted over a portion.

A word has a number within its document (``_Own``), so an item of several words is one number of 64 bits as a rule, and only items all of
whose words stand twice in the document, or are words of keywords, are looked at.

Defined results: keys of sources are unique; a text without a source, without keywords or without items has shares of 0; of several
lines of the reference for one item each is ranked. Words hold no spaces.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from loomtext.operators import indices as I
from loomtext.operators.held import hold
from loomtext.shared import fresh_dir
from loomtext.sources import io

#: Characters of the sources whose items meet the reference together.
PORTION = 1 << 22


def _packed(value: object) -> bytes:
    return zstandard.compress(pickle.dumps(value), 6)


def _unpacked(frame: bytes) -> object:
    return pickle.loads(zstandard.decompress(frame))


class _Own:
    """Lemmas numbered within their documents: ``at`` of each token, over all documents; ``begin``, where a document's numbers begin; ``doc`` and
    ``word`` of each number. Each document has a number for the word ``x``, whether it stands there or not."""

    def __init__(self, flat: I.Flat):
        self.flat = flat
        self.x = flat.number.get("x", len(flat.words))
        self.width = len(flat.words) + 1
        every = np.append(flat.doc * self.width + flat.lemma, np.arange(flat.n) * self.width + self.x)
        self.known, at = np.unique(every, return_inverse=True)
        self.at, self.of_x = at[: len(flat.lemma)], at[len(flat.lemma) :]
        self.doc, self.word = self.known // self.width, self.known % self.width
        self.begin = np.searchsorted(self.known, np.arange(flat.n) * self.width)
        self.size, self.most = len(self.known), int(np.diff(np.append(self.begin, len(self.known))).max(initial=0)) + 1
        self._masked: dict[str, np.ndarray] = {}
        self._starts: dict[tuple[int, str], np.ndarray] = {}

    def masked(self, mask: str) -> np.ndarray:
        """The number of each token, that of x where the mask hides it."""
        if mask not in self._masked:
            tags = I.MASKED[mask]
            self._masked[mask] = self.at if tags is None else np.where(self.flat.tagged(tags), self.at, self.of_x[self.flat.doc])
        return self._masked[mask]

    def starts(self, n: int, within: str) -> np.ndarray:
        """The tokens at which n words of one sentence or document begin."""
        if (n, within) not in self._starts:
            unit = self.flat.sent if within == "sent" else self.flat.doc
            start = np.arange(max(len(unit) - n + 1, 0))
            self._starts[n, within] = start[unit[start] == unit[start + n - 1]]
        return self._starts[n, within]

    def inner(self, numbers: np.ndarray) -> np.ndarray:
        return numbers - self.begin[self.doc[numbers]]

    def short(self, n: int) -> bool:
        return self.size * self.most ** (n - 1) < 1 << 62

    def code(self, columns: list[np.ndarray]) -> np.ndarray:
        """One number for each n-gram; they are numbered anew where it would be too long."""
        code, size = columns[0].astype(np.int64), self.size
        for column in columns[1:]:
            if size * self.most >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                size = int(code.max(initial=0)) + 1
            code, size = code * self.most + self.inner(column), size * self.most
        return code


def _repeated(own: _Own, family: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each document the items of a family and how many are different; of the items that stand twice in one the document, how often,
    and the words. N-grams lie within sentences."""
    flat = own.flat
    if family in I.UNIGRAMS:
        tags = I.UNIGRAMS[family]
        k = np.bincount(own.at if tags is None else own.at[flat.tagged(tags)], minlength=own.size)
        two = np.flatnonzero((k >= 2) & (own.word != flat.number.get("", -1)))
        return np.bincount(own.doc, k, flat.n), np.bincount(own.doc[k > 0], minlength=flat.n), own.doc[two], k[two], [own.word[two]]
    mask, _, size = family.rpartition("_")
    n, numbers = I.SIZES[size], own.masked(mask)
    start = own.starts(n, "sent")
    total = np.bincount(flat.doc[start], minlength=flat.n)
    twice = (np.bincount(numbers, minlength=own.size) >= 2)[numbers]
    kept = twice[start]
    for i in range(1, n):
        kept &= twice[start + i]
    start = start[kept]
    columns = [numbers[start + i] for i in range(n)]
    if own.short(n):
        scale = own.most ** (n - 1)
        code, k = np.unique(own.code(columns), return_counts=True)
        doc = own.doc[code // scale]
        types = np.bincount(doc, minlength=flat.n)
        two = np.flatnonzero(k >= 2)
        doc, k, rest, inner = doc[two], k[two], code[two], []
        for _ in range(n - 1):
            rest, last = np.divmod(rest, own.most)
            inner.append(last)
        found = [rest, *[x + own.begin[doc] for x in reversed(inner)]]
    else:
        found, k = I._distinct(*columns)
        types = np.bincount(own.doc[found[0]], minlength=flat.n)
        two = np.flatnonzero(k >= 2)
        found, k = [x[two] for x in found], k[two]
        doc = own.doc[found[0]]
    return total, total - np.bincount(flat.doc[start], minlength=flat.n) + types, doc, k, [own.word[x] for x in found]


def _candidates(flat: I.Flat, share: float) -> tuple[tuple[list[tuple], list[str], int], pa.Array, pa.Array]:
    """For each family (all items and the limit of each document; document, n, line or -1, words of the candidates) with the words' texts in
    order and how many documents there are; and family and item by line of those to look up."""
    rows, asked, families, line, own = [], [], [], 0, _Own(flat)
    for family in I.ITEM_FAMILIES:
        total, types, doc, k, grams = _repeated(own, family)
        limit = np.floor(types * share).astype(np.int64)
        two = np.flatnonzero(limit[doc] > 0)
        doc, k, grams = doc[two], k[two], [g[two] for g in grams]
        many = np.bincount(doc, minlength=flat.n) > limit
        hard = np.flatnonzero(many[doc])
        at = np.full(len(doc), -1)
        if len(hard):
            distinct, _ = I._distinct(*[g[hard] for g in grams])
            number = np.unique(_codes(distinct, [g[hard] for g in grams]), return_inverse=True)[1]
            at[hard] = number + line
            asked.append(I.item_texts(flat, distinct))
            families += [family] * len(asked[-1])
            line += len(asked[-1])
        rows.append((total.astype(np.int64), limit, doc.astype(np.int32), k.astype(np.int32), at.astype(np.int32), grams))
    used = np.unique(np.concatenate([g for row in rows for g in row[-1]]))
    texts = pa.array([*flat.words, "x"], pa.string()).take(pa.array(used, pa.int64())).to_pylist()
    order = sorted(range(len(texts)), key=texts.__getitem__)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    rows = [(*row[:-1], [place[np.searchsorted(used, g)] for g in row[-1]]) for row in rows]
    return (rows, [texts[i] for i in order], flat.n), pa.array(families, pa.string()), pa.concat_arrays(asked) if asked else pa.array([], pa.string())


def _codes(known: list[np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
    """A number for each gram, in the order of the grams."""
    code = np.zeros(len(grams[0]), np.int64)
    for all_, own in zip(known, grams, strict=True):
        width = int(all_.max()) + 1
        code = np.unique(code * width + own, return_inverse=True)[1]
    return code


def _portions(key: str, pieces: Callable, share: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            for keys, flat in pieces(batch, PORTION):
                found, families, asked = _candidates(flat, share)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([pa.field(key, keys.type)])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([keys], names=[key]))
                one = pa.array([0, len(asked)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([_packed(found)], pa.binary()), pa.ListArray.from_arrays(one, families), pa.ListArray.from_arrays(one, asked)], names=["portion", "keys", "frame", "families", "items"])
                part += 1

    return rows


def _ranked(key: str):
    """(key, keywords): of each source its keywords' words, by number family by family, and how many there are of each."""

    def chosen(found: tuple[list[tuple], list[str], int], lines: np.ndarray, rates: np.ndarray) -> list[bytes]:
        rows, words, n = found
        order = np.argsort(lines, kind="stable")
        lines, rates = lines[order], rates[order]
        x = words.index("x") if "x" in words else -1
        docs, numbers, counts = [], [], np.zeros((n, len(rows)), np.int64)
        for f, (total, limit, doc, k, line, grams) in enumerate(rows):
            hard = np.flatnonzero(line >= 0)
            first, stop = (np.searchsorted(lines, line[hard], side) for side in ("left", "right"))
            each = np.maximum(stop - first, 1)
            at = np.repeat(np.arange(len(hard)), each)
            place = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            known = stop[at] > first[at]
            at = hard[at]
            tf = k[at] / total[doc[at]]
            rate = np.where(known, rates[np.minimum(place, len(rates) - 1)] if len(rates) else 0.0, 1.0) / 1_000_000
            with np.errstate(all="ignore"):
                diff = np.where(known & ~np.isnan(rate), (tf - rate) * 100 / rate, 1_000_000.0)
            order = np.lexsort((*[g[at] for g in reversed(grams)], -tf, -diff, doc[at]))
            sizes = np.bincount(doc[at], minlength=n)
            rank = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            best = order[rank <= limit[doc[at[order]]]]
            kept = np.append(np.flatnonzero(line < 0), at[best])
            if len(grams) > 1:
                kept = kept[~np.all([g[kept] == x for g in grams], axis=0)]
            docs.append(np.repeat(doc[kept], len(grams)))
            numbers.append(np.stack([g[kept] for g in grams], 1).ravel())
            counts[:, f] = np.bincount(doc[kept], minlength=n)
        doc, numbers = np.concatenate(docs), np.concatenate(numbers)
        order = np.argsort(doc, kind="stable")
        numbers, bounds, out = numbers[order], np.append(0, np.cumsum(np.bincount(doc, minlength=n))), []
        for d in range(n):
            used, of = np.unique(numbers[bounds[d] : bounds[d + 1]], return_inverse=True)
            out.append(_packed(([words[i] for i in used.tolist()], of.astype(np.int32), counts[d].astype(np.int32))))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys = pa.ipc.open_stream(batch.column("keys")[i].as_py()).read_all().column(0).combine_chunks()
                rates = batch.column("rates")[i].values
                lines, values = (np.zeros(0, np.int64), np.zeros(0)) if rates is None else (rates.field("i").to_numpy().astype(np.int64), rates.field("per_million").to_numpy(zero_copy_only=False))
                found = chosen(_unpacked(batch.column("frame")[i].as_py()), lines, values)
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.binary())], names=[key, "keywords"])

    return rows


def _counted(key: str):
    lengths = np.array([1 if f in I.UNIGRAMS else I.SIZES[f.rpartition("_")[2]] for f in I.ITEM_FAMILIES])

    def wanted(own: _Own, docs: np.ndarray, frames: list[bytes]) -> list[np.ndarray]:
        """For each family the keywords that stand in the documents they are meant for, if their words do, as numbers of these."""
        words, numbers, counts, before = [], [], [], 0
        for frame in frames:
            some, of, n = _unpacked(frame)
            numbers.append(of + before)
            counts.append(n)
            before += len(some)
            words.append(some)
        if not before:
            return [np.zeros((0, n), np.int64) for n in lengths]
        of_word = pc.index_in(pa.array([w for some in words for w in some], pa.string()), value_set=pa.array([*own.flat.words, *(["x"] if own.x == len(own.flat.words) else [])], pa.string()))
        doc = np.repeat(docs, [len(some) for some in words])
        word = of_word.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = doc * own.width + word
        at = np.minimum(np.searchsorted(own.known, code), own.size - 1)
        at = np.where((word >= 0) & (own.known[at] == code), at, -1)[np.concatenate(numbers)]
        family = np.repeat(np.tile(np.arange(len(lengths)), len(frames)), (np.array(counts) * lengths).ravel())
        found = [at[family == f].reshape(-1, n) for f, n in enumerate(lengths)]
        return [x[(x >= 0).all(axis=1)] for x in found]

    def shares(own: _Own, table: list[np.ndarray]) -> list[np.ndarray]:
        flat, out = own.flat, []
        for family, size, rows in zip(I.ITEM_FAMILIES, lengths.tolist(), table, strict=True):
            marks = np.zeros((size, own.size), bool)
            for i in range(size):
                marks[i, rows[:, i]] = True
            if family in I.UNIGRAMS:
                tags = I.UNIGRAMS[family]
                keep = np.ones(len(own.at), bool) if tags is None else flat.tagged(tags)
                n, hits = flat.each(keep), flat.each(keep & marks[0][own.at])
            else:
                start, numbers = own.starts(size, "doc"), own.masked(family.rpartition("_")[0])
                n, hits = np.maximum(flat.sizes - size + 1, 0), np.zeros(flat.n)
                if len(rows):
                    hit = marks[0][numbers[start]]
                    for i in range(1, size):
                        hit &= marks[i][numbers[start + i]]
                    start = start[hit]
                    code = own.code([np.append(rows[:, i], numbers[start + i]) for i in range(size)])
                    known, asked = np.sort(code[: len(rows)]), code[len(rows) :]
                    hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
                    hits = np.bincount(flat.doc[start[hit]], minlength=flat.n)
            out.append(I.ratio(hits, n))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, met, own = batch.column(0)[i].values, batch.column(2)[i].values, _Own(I.unpacked(batch.column(1)[i].as_py()))
                docs, frames = (np.zeros(0, np.int64), []) if met is None else (met.field("i").to_numpy().astype(np.int64), met.field("keywords").to_pylist())
                found = shares(own, wanted(own, docs, frames))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.float64()) for x in found]], names=[key, *names()])

    return rows


def names() -> list[str]:
    return [f"{f}_keywords_percentage" for f in I.ITEM_FAMILIES]


def keyword_shares(docs: DataFrame, sources: DataFrame, references: DataFrame, key: str = "doc_id", share: float = 0.1) -> DataFrame:
    """(key, the 23 keyword shares) of texts whose sources are (key, text): of a text's items those that are keywords of its source, as
    ``lexicon.keyness`` ranks them by (family, item, per_million)."""
    source, field, pieces = I.pieces_of(sources, key)
    made = source.mapInArrow(_portions(key, pieces, share), "portion long, keys binary, frame binary, families array<string>, items array<string>")
    table = io.save_table(made, f"{fresh_dir(docs.sparkSession, 'keywords')}/portions")
    spread = table.select("portion", F.posexplode(F.arrays_zip("families", "items")).alias("i", "e")).select("portion", "i", F.col("e.families").alias("family"), F.lower("e.items").alias("item"))
    met = spread.join(references.where("per_million IS NOT NULL").select("family", "item", "per_million"), ["family", "item"])
    listed = met.groupBy("portion").agg(F.collect_list(F.struct("i", "per_million")).alias("rates"))
    ranked = table.select("portion", "keys", "frame").join(listed, "portion", "left").select("keys", "frame", "rates")
    keywords = ranked.mapInArrow(_ranked(key), StructType([field, StructField("keywords", BinaryType())]))
    texts = hold(docs, key)
    at = texts.select("portion", F.posexplode(key).alias("i", key)).join(keywords, key)
    given = at.groupBy("portion").agg(F.collect_list(F.struct("i", "keywords")).alias("given"))
    own = StructField(key, texts.schema[key].dataType.elementType)
    return texts.join(given, "portion", "left").select(key, "flat", "given").mapInArrow(_counted(key), StructType([own, *[StructField(n, DoubleType()) for n in names()]]))
