"""Token ids of whole texts under a public byte-level vocabulary, with bounded memory for huge documents.

The vocabulary file is read as the ``tokenizers`` library reads it; its byte-pair merges run in
``tiktoken`` with the same ranks, which gives the same ids several times faster (tests hold both
libraries against each other). A string of an added special token inside a text is one id, the
library's default.

Overlap resynchronisation: a document longer than ``chunk`` characters is encoded in chunks that
overlap. Where a single space stands between two characters that are no white space, the pattern
that splits text before merging always starts a piece at the space, whatever stands before or
after. So two neighbouring chunks are spliced at such a space in their overlap, once the offsets of
both encodings show a token border there; the overlap is widened until one is found, at most up
to the rest of the document. Special strings never straddle a splice, as they hold no white space (checked on
loading).

A long run of white space has proven borders too: a piece starts where it starts, since no alternative of the
pattern goes from other characters into white space, and the pattern takes all of it but the last character (all of it at the
end of a text) as one piece. Such pieces are merged without the pattern, whose matcher fails on runs of a million.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from loomtext.llm.runtime import KEY, unkeyed

CHUNK, OVERLAP = 1 << 16, 1 << 9
STABLE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of white space as the pattern knows them; a run of LONG_RUN and more is a piece of its own. Texts shorter
#: than SHORT hold no run that the pattern's matcher could fail on.
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN, SHORT = 1 << 10, 1 << 14
RUN = re.compile(f"{SPACES}{{{LONG_RUN},}}")
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as ``tokenizers`` gives them for a byte-level BPE file, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        kind = model["pre_tokenizer"]
        if model["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or model["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        joined = [model["model"]["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["model"]["merges"]]
        if any(b <= a for a, b in zip([-1, *joined], joined)):
            raise ValueError(f"{path}: ids do not stand in the order of the merges")
        if any(c.isspace() for s in special for c in s):
            raise ValueError(f"{path}: a special string holds white space")
        self.core = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for piece, i in ranks.items():
            self.sizes[i] = len(piece)
        for piece, i in special.items():
            self.sizes[i] = len(piece.encode())

    def plain(self, text: str) -> list[int]:
        """The ids of a text that is encoded at once."""
        if len(text) < SHORT:
            return self._matched(text)
        return [i for segment, blank in segments(text) for i in (self._blank(segment) if blank else self._matched(segment))]

    def _matched(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.core.encode(text, allowed_special=set(self.special), disallowed_special=())
        return self.core.encode_ordinary(text)

    def _blank(self, run: str) -> list[int]:
        return self.core._encode_single_piece(run.encode())  # one piece of the pattern, whatever its length

    def parts(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
        """The ids of a text, in parts of a bounded size; a long run of white space is a part."""
        if len(text) <= chunk + overlap:
            yield np.array(self.plain(text), np.uint32)
            return
        for segment, blank in segments(text):
            if blank:
                yield np.array(self._blank(segment), np.uint32)
                continue
            start = 0
            while start < len(segment):
                ids, start = self._until_splice(segment, start, chunk, overlap)
                yield ids

    def _until_splice(self, text: str, start: int, chunk: int, overlap: int) -> tuple[np.ndarray, int]:
        """The ids from ``start``, a start of a piece, to a splice; where the next part starts."""
        while True:
            end = min(start + chunk + overlap, len(text))
            ids = np.array(self._matched(text[start:end]), np.uint32)
            if end == len(text):
                return ids, end
            seam = start + chunk  # the next chunk's encoding starts here, in the middle of anything
            borders = np.cumsum(self.sizes[ids])
            after = np.cumsum(self.sizes[np.array(self._matched(text[seam : end + overlap]), np.uint32)])
            for found in STABLE.finditer(text, seam + 1, end - 1):
                at = found.start()
                here, there = len(text[start:at].encode()), len(text[seam:at].encode())
                i = int(np.searchsorted(borders, here))
                if borders[i] == here and there in after[np.searchsorted(after, there) : np.searchsorted(after, there) + 1]:
                    return ids[: i + 1], at
            overlap *= 2


def segments(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut at proven borders around long runs of white space: (segment, whether it is such a run)."""
    start = 0
    for run in RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > start:
            yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    if start < len(text):
        yield text[start:], False


def _byte_of() -> dict[str, int]:
    """The bytes that the vocabulary's characters stand for: printable Latin-1 characters for themselves, the rest
    for the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _counts(path: str, limit: int, chunk: int, overlap: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n_bytes = [len(x.as_buffer() or b"") for x in texts]
            counts = [len(own.plain(x)) if len(x) <= chunk + overlap else sum(map(len, own.parts(x, chunk, overlap))) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[KEY, "n_bytes", "n_tokens", "over_limit"])

    return rows


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. A null text is empty, a null doc_id stays null,
    repeated rows stay rows; other columns are not read."""
    source = docs.selectExpr(f"CAST(doc_id AS long) AS {KEY}", "text")
    counted = source.mapInArrow(_counts(path or default_vocabulary(), limit, chunk, overlap), f"{KEY} long, n_bytes long, n_tokens long, over_limit boolean")
    return unkeyed(counted, source, True)
