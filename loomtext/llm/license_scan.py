"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

A template is a license notice or text as a sequence of words (runs of ASCII letters, lower-cased, digits and bytes of
other characters) and its set of five-word shingles. Texts are cut into blocks of 1, 2, 4, ... shingles, and overlapping windows are
runs of blocks, one starting at each block. A template of n shingles is sought by blocks of b of them, 2 b < n <= 4 b, in
windows of ceil(n / b) + 1 blocks, the fewest in which any passage of n shingles lies whole. A window and a template meet if
one of ``BANDS`` min-hashes is equal. A passage that holds 80 % of a template's shingles has a Jaccard similarity of at
least 0.8 n / (b (ceil(n / b) + 1) + 0.2 n) with its window, that is 0.36 at worst (n just above 2 b); the chance that no band meets is below (1 - 0.36) ** 32, below one in a million.

A met pair is verified: the share of the template's distinct shingles that stand in the window, exactly,
must reach 0.8. The best window of each document and template is returned.

Notices of different licenses or versions may differ in a word, and one may hold another, so that one passage holds 0.8 of both:
rivals. What tells a template from its rival are the shingles that only one of them has. A match is dropped if the
window and its surroundings hold less than half of the template's own such shingles, and less than of the rival's; a template that
has no such shingles gives way to a rival of which 0.8 of what it has more is there.

Defined results: a null or empty text matches nothing, so such a document gives no row; a null doc_id stays
null; rows with one doc_id are matched each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm.license_texts import NOTICES
from loomtext.llm.units import Spans, batch_bytes, mix, pieces, ranges, runs_of, salts, word_units

SHINGLE = 5
BANDS = 32
SIMILARITY = 0.8
#: Words that are hashed at once.
STRETCH = 1 << 16
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def shingles_of(words: list[bytes], size: int = SHINGLE) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


SALTS = salts(BANDS, 5)


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # of each document's words
    shingles: np.ndarray  # hashes, by first word; those across documents are not used


def hashed_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> Words:
    low, high = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    return Words(starts, ends, bounds, Spans(word_units(LOWER[raw[low:high]], starts - low, ends - low)).rolling(SHINGLE))


class Templates:
    """Notices as sets of shingles, their classes by size and the bands that retrieve them."""

    def __init__(self, notices: dict[str, tuple[str, ...]] = NOTICES, similarity: float = SIMILARITY):
        self.names: list[str] = []
        self.sets: list[frozenset[tuple[bytes, ...]]] = []
        classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}  # by block and blocks a window
        for name, texts in notices.items():
            for text in texts:
                raw = np.frombuffer(text.encode(), np.uint8)
                hashes = hashed_words(raw, *runs_of(INSIDE[raw], np.array([0, len(raw)]))).shingles
                if not len(hashes):
                    raise ValueError(f"a notice of {name} has fewer than {SHINGLE} words")
                self.names.append(name)
                self.sets.append(frozenset(shingles_of(words_of(text.encode()))))
                block = 1 << max((len(hashes) - 1).bit_length() - 2, 0)
                classes.setdefault((block, -(-len(hashes) // block) + 1), []).append((len(self.names) - 1, hashes))
        self.rivals = [
            [(own - other, other - own) for j, other in enumerate(self.sets) if self.names[j] != self.names[i] and len(own & other) >= similarity * len(own)]
            for i, own in enumerate(self.sets)
        ]
        self.blocks = [1 << k for k in range(max(block for block, _ in classes).bit_length())]
        self.windows = {block: sorted(m for size, m in classes if size == block) for block in self.blocks}
        self.reach = max(block * m for block, m in classes) + SHINGLE  # words around a window in which rivals are looked for
        self.bands = {key: [self._table(members, salt) for salt in SALTS] for key, members in classes.items()}

    @staticmethod
    def _table(members: list[tuple[int, np.ndarray]], salt: np.uint64) -> tuple[np.ndarray, dict[int, list[int]]]:
        """(which low 16 bits some template's min-hash has, the templates by min-hash)"""
        table: dict[int, list[int]] = {}
        for i, hashes in members:
            table.setdefault(int(mix(hashes ^ salt).min()), []).append(i)
        low = np.zeros(1 << 16, bool)
        low[[value & 0xFFFF for value in table]] = True
        return low, table

    def candidates(self, words: Words) -> set[tuple[int, int, int, int]]:
        """(document, template, first shingle, end) of all windows that meet a template in some band."""
        counts = np.maximum(np.diff(words.bounds) - SHINGLE + 1, 0)
        own = ranges(words.bounds[:-1], words.bounds[:-1] + counts)
        found: set[tuple[int, int, int, int]] = set()
        if not len(own):
            return found
        shingles = words.shingles[own]
        doc = np.repeat(np.arange(len(counts)), counts)
        blocks = {1: (own, own + 1, doc)}
        heads = {}
        for size in self.blocks[1:]:  # two blocks of half the size make one, if both are the document's
            start, end, of = blocks[size // 2]
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            heads[size] = np.flatnonzero(nth % 2 == 0)
            blocks[size] = (start[heads[size]], end[np.append(heads[size][1:], len(of)) - 1], of[heads[size]])
        for k, salt in enumerate(SALTS):
            least = mix(shingles ^ salt)
            for size in self.blocks:
                if size > 1:
                    least = np.minimum.reduceat(least, heads[size])
                start, end, of = blocks[size]
                joined, taken = least.copy(), 1
                for m in self.windows[size]:
                    for t in range(taken, min(m, len(of))):  # min-hashes of t + 1 blocks from those of t; past a document's end they
                        np.minimum(joined[:-t], least[t:], out=joined[:-t])  # only add candidates that do not hold
                    taken = m
                    low, table = self.bands[size, m][k]
                    for i in np.flatnonzero(low[(joined & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                        met = table.get(int(joined[i]), ())
                        if met:
                            last = min(i + m - 1, int(np.searchsorted(of, of[i], side="right")) - 1)
                            found.update((int(of[i]), t, int(start[i]), int(end[last])) for t in met)
        return found


def outdone(rivals: list[tuple[frozenset, frozenset]], held: set[tuple[bytes, ...]]) -> bool:
    """Whether the shingles held are those of a rival rather than the template's own."""

    def share(own: frozenset) -> float:
        return len(own & held) / len(own) if own else 0.0

    return any(share(own) < 0.5 and share(own) < share(other) if own else share(other) >= SIMILARITY for own, other in rivals)


def matches(raw: np.ndarray, words: Words, templates: Templates, similarity: float = SIMILARITY, before: bool = False, after: bool = False) -> list[tuple[int, int, float, int]]:
    """(document, template, containment, first word of the window): verified on the words themselves. ``before``
    and ``after``: the text goes on there, and windows whose surroundings are cut off are left to the next stretch."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for doc, t, start, end in templates.candidates(words):
        end = min(end + SHINGLE - 1, int(words.bounds[doc + 1]))
        low, high = int(words.bounds[doc]), int(words.bounds[doc + 1])
        first, last = start - templates.reach, end + templates.reach
        if before and first < low or after and last > high:
            continue
        first, last = max(first, low), min(last, high)
        near = [raw[a:b].tobytes().lower() for a, b in zip(words.starts[first:last].tolist(), words.ends[first:last].tolist(), strict=True)]
        own = near[start - first : end - first]
        share = len(templates.sets[t].intersection(shingles_of(own))) / len(templates.sets[t])
        if share >= similarity and templates.rivals[t] and outdone(templates.rivals[t], set(shingles_of(near))):
            continue
        entry = (share, -(start - int(words.bounds[doc])))
        if share >= similarity and entry > best.get((doc, t), (0.0, 0)):
            best[doc, t] = entry
    return [(doc, t, share, -start) for (doc, t), (share, start) in sorted(best.items())]


def _scanned(notices: dict[str, tuple[str, ...]], similarity: float, stretch: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(notices, similarity)
        overlap = 6 * templates.reach  # words; a window of a cut document has its surroundings on either side
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, bounds = batch_bytes(batch.column(1))
            starts, ends, of_docs = runs_of(INSIDE[raw], bounds)
            best: dict[tuple[int, str], float] = {}
            for doc, a, b, inner in pieces(of_docs, stretch, overlap):
                words = hashed_words(raw, starts[a:b], ends[a:b], inner)
                for at, t, share, _ in matches(raw, words, templates, similarity, a > of_docs[doc], len(inner) == 2 and b < of_docs[doc + 1]):
                    key = (doc + at, templates.names[t])
                    best[key] = max(best.get(key, 0.0), share)
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in best], pa.int64()), pa.array([name for _, name in best], pa.string()), pa.array(list(best.values()), pa.float64())], names=["doc_id", "license", "containment"])

    return rows


def license_scan(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, similarity: float = SIMILARITY, stretch: int = STRETCH) -> DataFrame:
    """doc_id, license, containment (of the best notice of that license in its best window)."""
    source = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    return source.mapInArrow(_scanned(notices or NOTICES, similarity, stretch), "doc_id long, license string, containment double")
