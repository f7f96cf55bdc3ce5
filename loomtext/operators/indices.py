"""Cohesion indices of whole documents in one pass over batches of texts.

A batch is held as flat arrays: a number for each token's word and lemma, its tag, and the bounds of sentences, paragraphs and
documents. Every index is then a few array operations over the batch; none depends on the number of phrases or
looks at a document's tokens one by one. Nothing is shuffled: a task reads its documents and gives a row for each.

Texts are cut by the rule annotator of ``annotate.py``, which is applied to each distinct word of a batch once; a table that any
other annotator made (a ``doc`` column of its nested type) is read as it is.

Defined results: a null or empty text has no words, and all its indices are 0; a null key stays null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomtext.functions import connective_lists as lists
from loomtext.functions.text import paragraphs
from loomtext.operators import annotate as A

CLASSES = ("all", "cw", "fw", "noun", "verb", "adj", "adv", "pronoun", "argument")
NOUN_TAGS, VERB_TAGS, ADJECTIVE_TAGS, ADVERB_TAGS, PRONOUN_TAGS = ("NN", "NNS", "NNP", "NNPS"), ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD"), ("JJ", "JJR", "JJS"), ("RB", "RBR", "RBS"), ("PRP", "PRP$")
#: Characters of text that are held as arrays at once.
PORTION = 1 << 21
PIECE = re.compile(r"[^\W_]+|[.!?\n]")
WINDOW = 50


class Flat:
    """Documents as arrays. ``words`` are the distinct words and lemmas; the bounds of a level count the level below."""

    def __init__(self, words: list[str], raw: np.ndarray, lemma: np.ndarray, tag: np.ndarray, aux: np.ndarray, dep: np.ndarray, sents: np.ndarray, paras: np.ndarray, docs: np.ndarray):
        self.words, self.raw, self.lemma, self.tag, self.aux, self.dep = words, raw, lemma, tag, aux, dep
        self.sents, self.paras, self.docs = sents, paras, docs
        self.n = len(docs) - 1

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def sent(self) -> np.ndarray:
        """The sentence of each token."""
        return np.repeat(np.arange(len(self.sents) - 1), np.diff(self.sents))

    @cached_property
    def para(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.paras) - 1), np.diff(self.paras))[self.sent]

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.docs))[self.para]

    @cached_property
    def doc_sents(self) -> np.ndarray:
        """The bounds of documents in sentences."""
        return self.paras[self.docs]

    @cached_property
    def doc_tokens(self) -> np.ndarray:
        return self.sents[self.doc_sents]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.doc_tokens)

    @cached_property
    def tag_codes(self) -> tuple[np.ndarray, dict[str, int]]:
        """A number for each token's tag, and the numbers by tag."""
        letters = np.ascontiguousarray(self.tag).view(np.uint32).reshape(len(self.tag), -1) if len(self.tag) else np.zeros((0, 1), np.uint32)
        if letters.shape[1] <= 4 and letters.max(initial=0) < 256:
            codes = (letters.astype(np.int64) << (8 * np.arange(letters.shape[1]))).sum(axis=1)
            first = np.unique(codes, return_index=True)
            return codes, dict(zip(self.tag[first[1]].tolist(), first[0].tolist(), strict=True))
        found, codes = np.unique(self.tag, return_inverse=True)
        return codes, {tag: i for i, tag in enumerate(found.tolist())}

    def tagged(self, tags: tuple[str, ...]) -> np.ndarray:
        """Which tokens have one of the tags."""
        codes, known = self.tag_codes
        keep = np.zeros(len(codes), bool)
        for tag in tags:
            if tag in known:
                keep |= codes == known[tag]
        return keep

    def each(self, keep: np.ndarray) -> np.ndarray:
        """How many marked tokens each document has."""
        return np.bincount(self.doc[keep], minlength=self.n)

    def among(self, words: list[str]) -> np.ndarray:
        """Which tokens are one of the words."""
        own = np.zeros(len(self.words), bool)
        own[[self.number[w] for w in words if w in self.number]] = True
        return own[self.raw]


def tag_of(word: str) -> str:
    return _CLOSED_TAGS.get(word) or ("CD" if word.isascii() and word.isdigit() else "RB" if word.endswith("ly") else "VBG" if word.endswith("ing") else "VBD" if word.endswith("ed") else "JJ" if word.endswith(("ble", "al", "ous", "ful")) else "NNS" if word.endswith("s") and len(word) > 3 else "NN")


_CLOSED_TAGS: dict[str, str] = {}
for _tag, _words in A.CLOSED.items():
    for _word in _words.split():
        _CLOSED_TAGS.setdefault(_word, _tag)
AUXILIARIES = frozenset(f"{A.CLOSED['VBP']} {A.CLOSED['MD']}".split())


def lemma_of(word: str) -> str:
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def _numbered(values: pa.Array) -> tuple[np.ndarray, list]:
    coded = values.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def flat_of_paragraphs(column: pa.Array) -> Flat:
    """Lower-cased paragraphs, cut into sentences and words and annotated by rule."""
    per_doc = np.array([len(x) if x else 0 for x in column.to_pylist()], np.int64)
    pieces = PIECE.findall("\n".join(column.flatten().to_pylist()))
    ids, found = _numbered(pa.array(pieces, pa.string()))
    marks = np.array([w in ".!?\n" for w in found], bool)
    lines = np.array([w == "\n" for w in found], bool)
    token = ~marks[ids] if len(found) else np.zeros(0, bool)
    raw = ids[token]
    segment = np.cumsum(~token)[token]
    para = (np.cumsum(lines[ids]) if len(found) else ids)[token]
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(raw) else np.zeros(0, np.int64)
    sents = np.append(starts, len(raw))
    sents_of_para = np.bincount(para[starts], minlength=int(per_doc.sum()))
    words = list(found)
    number = {w: i for i, w in enumerate(words)}
    lemma = np.empty(len(found), np.int64)
    for i, w in enumerate(found):
        own = lemma_of(w)
        if own not in number:
            number[own] = len(words)
            words.append(own)
        lemma[i] = number[own]
    tags = np.array([tag_of(w) for w in found], "U4") if found else np.zeros(0, "U4")
    aux = np.array([w in AUXILIARIES for w in found], bool)
    det = np.array([w in A.DETERMINED.split() for w in found], bool)
    mark = np.array([w in A.MARKS.split() for w in found], bool)
    size = np.repeat(np.diff(sents), np.diff(sents))
    place = np.arange(len(raw)) - np.repeat(sents[:-1], np.diff(sents))
    dep = np.where(det[raw] & (place < size - 1), 1, np.where(mark[raw] & (place > 0), 2, 0)) if len(raw) else raw
    return Flat(words, raw, lemma[raw], tags[raw], aux[raw], dep, sents, np.append(0, np.cumsum(sents_of_para)), np.append(0, np.cumsum(per_doc)))


def flat_of_nested(column: pa.Array) -> Flat:
    """Documents that some annotator made, as nested lists of tokens."""
    bounds, level = [], column
    for _ in range(3):
        bounds.append(np.append(0, np.cumsum(level.value_lengths().fill_null(0).to_numpy())))
        level = level.flatten()
    text = lambda name: level.field(name).fill_null("")
    both, words = _numbered(pa.concat_arrays([text("raw"), text("lemma")]))
    strings = lambda name: np.array(text(name).to_pylist(), "U16") if len(level) else np.zeros(0, "U16")
    dep = strings("dep")
    return Flat(words, both[: len(level)], both[len(level) :], strings("tag"), strings("pos") == "AUX", np.where(dep == "det", 1, np.where(dep == "mark", 2, 0)), bounds[2], bounds[1], bounds[0])


def masks(flat: Flat, adjectives: list[str] | None = None) -> dict[str, np.ndarray]:
    """For each word class which tokens are in it, as ``metrics.class_conditions`` says it in SQL."""
    known = set(adjectives or [])
    content = np.array([w in known or w.endswith("ly") and w[:-2] in known for w in flat.words], bool)
    content = content[flat.lemma] if len(flat.words) else np.zeros(0, bool)
    noun, verb, adj, adv, prp = (flat.tagged(tags) for tags in (NOUN_TAGS, VERB_TAGS, ADJECTIVE_TAGS, ADVERB_TAGS, PRONOUN_TAGS))
    return {
        "all": np.ones(len(flat.raw), bool),
        "cw": noun | adj | (verb & ~flat.aux) | (adv & content),
        "fw": ~(noun | adj | verb | adv) | (verb & flat.aux) | (adv & ~content),
        "noun": noun,
        "verb": verb & ~flat.aux,
        "adj": adj,
        "adv": adv,
        "pronoun": prp | unattended(flat),
        "argument": prp | noun,
    }


def unattended(flat: Flat) -> np.ndarray:
    return flat.among(lists.DEMONSTRATIVES) & (flat.dep != 1)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) != 0)


def _types(doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """How many different ids each document has."""
    if not len(ids):
        return np.zeros(n, np.int64)
    width = int(ids.max()) + 1
    return np.bincount(np.unique(doc * width + ids) // width, minlength=n)


def moving_ratio(doc: np.ndarray, ids: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """The mean share of different ids in all windows of a document's ids; of all of them, if they fit one window. An id counts
    in the windows in which it stands first, which its last place before tells. Shares are added in the order of the windows, as an
    engine does that holds them in a list."""
    sizes = np.bincount(doc, minlength=n)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((place, ids, doc))
    last = np.full(len(ids), -1)
    same = (doc[order[1:]] == doc[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
    last[order[1:][same]] = place[order[:-1][same]]
    first = np.maximum(np.maximum(last + 1, place - window + 1), 0)
    end = np.minimum(place, sizes[doc] - window)
    stands = end >= first
    starts = np.cumsum(sizes) - sizes
    at, stop = (starts[doc] + first)[stands], (starts[doc] + end)[stands] + 1
    held = np.cumsum(np.bincount(at, minlength=len(ids) + 1) - np.bincount(stop, minlength=len(ids) + 1)) / window
    total = np.zeros(n)
    for d in np.flatnonzero(sizes > window).tolist():
        total[d] = np.cumsum(held[starts[d] : starts[d] + sizes[d] - window + 1])[-1]
    return np.where(sizes <= window, ratio(_types(doc, ids, n), sizes), ratio(total, np.maximum(sizes - window + 1, 1)))


DIVERSE = {"lemma": "all", "content": "cw", "function": "fw", "noun": "noun", "verb": "verb", "adj": "adj", "adv": "adv", "prp": "pronoun", "argument": "argument"}


def diversity(flat: Flat, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The 13 type-token and density indices and the two n-gram ratios."""
    out, tokens, types = {}, {}, {}
    for name, c in DIVERSE.items():
        doc, ids = flat.doc[own[c]], flat.lemma[own[c]]
        tokens[name], types[name] = np.bincount(doc, minlength=flat.n), _types(doc, ids, flat.n)
        out[f"{name}_ttr"] = ratio(types[name], tokens[name])
    for name in ("lemma", "function"):
        out[f"{name}_mattr"] = moving_ratio(flat.doc[own[DIVERSE[name]]], flat.lemma[own[DIVERSE[name]]], flat.n)
    out["lexical_density_tokens"] = ratio(tokens["content"], tokens["lemma"])
    out["lexical_density_types"] = ratio(types["content"], types["lemma"])
    ids, doc = flat.lemma, flat.doc
    for name in ("bigram", "trigram"):  # longer by one word, and numbered anew
        within = doc[len(doc) - len(ids) + 1 :] == doc[: max(len(ids) - 1, 0)] if len(ids) else np.zeros(0, bool)
        joined = ids[:-1] * max(len(flat.words), 1) + flat.lemma[len(doc) - len(ids) + 1 :] if len(ids) else ids
        ids = np.unique(joined, return_inverse=True)[1] if len(joined) else joined
        starts = doc[: len(ids)][within]
        out[f"{name}_lemma_ttr"] = ratio(_types(starts, ids[within], flat.n), np.bincount(starts, minlength=flat.n))
    return out


def overlap(flat: Flat, own: dict[str, np.ndarray], levels: tuple[str, ...] = ("sent", "para"), classes: tuple[str, ...] = CLASSES) -> dict[str, np.ndarray]:
    """Adjacent overlap: six indices for each level and class, 108 for all."""
    out = {}
    width = max(len(flat.words), 1)
    for level in levels:
        of_token, bounds = (flat.sent, flat.doc_sents) if level == "sent" else (flat.para, flat.docs)
        n = np.diff(bounds)
        doc = np.repeat(np.arange(flat.n), n)
        after = np.repeat(bounds[1:], n) - np.arange(len(doc)) - 1  # segments after each one in its document
        for c in classes:
            keys = np.unique(of_token[own[c]] * width + flat.lemma[own[c]])
            segment = keys // width

            def held(shift: int, keys=keys) -> np.ndarray:
                at = np.searchsorted(keys, keys + shift * width)
                return keys[np.minimum(at, len(keys) - 1)] == keys + shift * width if len(keys) else np.zeros(0, bool)

            one = held(1) & (after[segment] > 0)
            two = (held(1) | held(2)) & (after[segment] > 1)
            for prefix, hits, least in (("", one, 1), ("2_", two, 2)):
                total = np.bincount(segment[hits], minlength=len(doc))
                words = np.bincount(segment[after[segment] >= least], minlength=len(doc))
                o, b, d = (np.bincount(doc, x, flat.n) for x in (total, total > 0, words))
                pairs = np.maximum(n - least, 0)
                out[f"adjacent_overlap_{prefix}{c}_{level}"] = ratio(o, d)
                out[f"adjacent_overlap_{prefix}{c}_{level}_div_seg"] = ratio(o, pairs)
                out[f"adjacent_overlap_binary_{prefix}{c}_{level}"] = ratio(b, pairs)
    return out


def phrase_counts(flat: Flat, named: dict[str, list[str]], within: str = "doc") -> dict[str, np.ndarray]:
    """For each list of phrases its occurrences in each document, not across documents (or sentences). Two occurrences of
    one phrase have a word between them at least, as the spaces around a phrase are part of it.

    All phrases are matched together, a word at a time, as one trie of their words."""
    nodes: dict[tuple[int, int], int] = {}
    ends: dict[int, int] = {}  # node -> phrase
    uses: list[dict[str, int]] = []
    lengths: list[int] = []
    numbered: dict[str, int] = {}
    for name, phrases in named.items():
        for phrase in phrases:
            if phrase not in numbered:
                numbered[phrase] = len(uses)
                uses.append({})
                lengths.append(len(phrase.split(" ")))
                node = 0
                words = [flat.number.get(w) for w in phrase.split(" ")]
                if None not in words:
                    for w in words:
                        node = nodes.setdefault((node, w), len(nodes) + 1)
                    ends[node] = numbered[phrase]
            uses[numbered[phrase]][name] = uses[numbered[phrase]].get(name, 0) + 1
    out = {name: np.zeros(flat.n) for name in named}
    if not nodes or not len(flat.raw):
        return out
    width = len(flat.words)
    keys = np.array([node * width + w for node, w in nodes])
    order = np.argsort(keys)
    keys, to = keys[order], np.array(list(nodes.values()))[order]
    phrase_of = np.full(len(nodes) + 1, -1)
    phrase_of[list(ends)] = list(ends.values())
    unit = flat.doc if within == "doc" else flat.sent
    start, node = np.arange(len(flat.raw)), np.zeros(len(flat.raw), np.int64)
    found_at, found = [], []
    for k in range(max(lengths)):
        ok = start + k < len(flat.raw)
        start, node = start[ok], node[ok]
        ok = unit[start + k] == unit[start]
        start, node = start[ok], node[ok]
        step = node * width + flat.raw[start + k]
        at = np.minimum(np.searchsorted(keys, step), len(keys) - 1)
        ok = keys[at] == step
        start, node = start[ok], to[at[ok]]
        whole = phrase_of[node] >= 0
        found_at.append(start[whole])
        found.append(phrase_of[node[whole]])
    at, phrase = np.concatenate(found_at), np.concatenate(found)
    order = np.lexsort((at, phrase))
    at, phrase = at[order], phrase[order]
    need = np.array(lengths)[phrase] + 1
    close = np.zeros(len(at), bool)
    close[1:] = (phrase[1:] == phrase[:-1]) & (unit[at[1:]] == unit[at[:-1]]) & (at[1:] - at[:-1] < need[1:])
    counted = np.ones(len(at), bool)
    for i in np.flatnonzero(close).tolist():  # occurrences too close to the one counted before
        j = i - 1
        while not counted[j]:
            j -= 1
        counted[i] = at[i] - at[j] >= need[i]
    doc, phrase = flat.doc[at[counted]], phrase[counted]
    table = np.bincount(phrase * flat.n + doc, minlength=len(uses) * flat.n).reshape(len(uses), flat.n)
    for i, own in enumerate(uses):
        for name, times in own.items():
            out[name] += times * table[i]
    return out


#: index: (phrases, words that count alone, words that count as a mark)
CONNECTIVES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "basic_connectives": (lists.BASIC_CONNECTIVES, [], []),
    "conjunctions": (lists.CONJUNCTIONS, [], []),
    "disjunctions": (lists.DISJUNCTIONS, [], []),
    "coordinating_conjuncts": (lists.COORDINATING_CONJUNCTS, [], []),
    "addition": (lists.ADDITION, [], []),
    "order": (lists.ORDER_NGRAM, lists.ORDER, lists.ORDER_CAVEAT),
    "reason_and_purpose": (lists.REASON_AND_PURPOSE_NGRAM, lists.REASON_AND_PURPOSE, lists.REASON_AND_PURPOSE_CAVEAT),
    "all_causal": (lists.ALL_CAUSAL, [], []),
    "positive_causal": (lists.POSITIVE_CAUSAL, [], []),
    "opposition": (lists.OPPOSITION, [], []),
    "determiners": (lists.DETERMINERS, [], []),
    "all_demonstratives": (lists.DEMONSTRATIVES, [], []),
    "all_additive": (lists.ALL_ADDITIVE, [], []),
    "all_logical": (lists.ALL_LOGICAL_NGRAM, lists.ALL_LOGICAL, lists.ALL_LOGICAL_CAVEAT),
    "positive_logical": (lists.POSITIVE_LOGICAL_NGRAM, lists.POSITIVE_LOGICAL, lists.POSITIVE_LOGICAL_CAVEAT),
    "negative_logical": (lists.NEGATIVE_LOGICAL, [], []),
    "all_temporal": (lists.ALL_TEMPORAL_NGRAM, lists.ALL_TEMPORAL, lists.ALL_TEMPORAL_CAVEAT),
    "positive_intentional": (lists.POSITIVE_INTENTIONAL_NGRAM, lists.POSITIVE_INTENTIONAL, lists.POSITIVE_INTENTIONAL_CAVEAT),
    "all_positive": (lists.ALL_POSITIVE_NGRAM, lists.ALL_POSITIVE, lists.ALL_POSITIVE_CAVEAT),
    "all_negative": (lists.ALL_NEGATIVE, [], []),
    "all_connective": (lists.ALL_CONNECTIVE_NGRAM, lists.ALL_CONNECTIVE, lists.ALL_CONNECTIVE_CAVEAT),
}


def connectives(flat: Flat) -> dict[str, np.ndarray]:
    """The 25 connective densities: phrases over the document's words, single words, and words that must be a mark. Linkers that
    need a mark are looked for within one string, so parts of its words match too."""
    demonstrative, mark = flat.among(lists.DEMONSTRATIVES), flat.dep == 2
    linkers = flat.among([w for w in flat.words if w in lists.SENTENCE_LINKERS_CAVEAT[0]]) & mark
    counts = {
        "lexical_subordinators": flat.each(mark),
        "attended_demonstratives": flat.each(demonstrative & (flat.dep == 1)),
        "unattended_demonstratives": flat.each(unattended(flat)),
        "sentence_linking": flat.each(flat.among(lists.SENTENCE_LINKERS)) + flat.each(linkers),
    }
    phrases = phrase_counts(flat, {name: phrases for name, (phrases, _, _) in CONNECTIVES.items()})
    for name, (_, alone, marked) in CONNECTIVES.items():
        counts[name] = phrases[name] + (flat.each(flat.among(alone)) + flat.each(flat.among(marked) & mark) if alone else 0)
    return {name: ratio(n, flat.sizes) for name, n in counts.items()}


def _repeated(doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Tokens whose id stands in the document more than once."""
    if not len(ids):
        return np.zeros(n, np.int64)
    width = int(ids.max()) + 1
    keys, counts = np.unique(doc * width + ids, return_counts=True)
    return np.bincount(keys // width, np.where(counts > 1, counts, 0), n)


def givenness(flat: Flat, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Pronoun density and ratio (unattended demonstratives count twice) and repeated content words."""
    alone = unattended(flat)
    pronouns = flat.each(own["pronoun"]) + flat.each(alone)
    content, prp = (_repeated(flat.doc[own[c]], flat.lemma[own[c]], flat.n) for c in ("cw", "pronoun"))
    return {
        "pronoun_density": ratio(pronouns, flat.sizes),
        "pronoun_noun_ratio": ratio(pronouns, flat.each(own["noun"])),
        "repeated_content_lemmas": ratio(content, flat.sizes),
        "repeated_content_and_pronoun_lemmas": ratio(content + prp + _repeated(flat.doc[alone], flat.raw[alone], flat.n), flat.sizes),
    }


def single_givenness(flat: Flat, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The shares of words that stand once, and more than once, among a document's words, lemmas and content lemmas."""
    out = {}
    for name, doc, ids in (("words", flat.doc, flat.raw), ("lemmas", flat.doc, flat.lemma), ("content_lemmas", flat.doc[own["cw"]], flat.lemma[own["cw"]])):
        repeated, total = _repeated(doc, ids, flat.n), np.bincount(doc, minlength=flat.n)
        out[f"repeated_{name}_givenness"], out[f"single_{name}_givenness"] = ratio(repeated, flat.sizes), ratio(total - repeated, flat.sizes)
    return out


def basic_counts(flat: Flat) -> dict[str, np.ndarray]:
    return {"nwords": flat.sizes, "nsents": np.diff(flat.doc_sents), "nparas": np.diff(flat.docs), "ntypes": _types(flat.doc, flat.raw, flat.n)}


Family = Callable[[Flat, dict[str, np.ndarray]], dict[str, np.ndarray]]
FAMILIES: dict[str, Family] = {
    "counts": lambda flat, own: basic_counts(flat),
    "diversity": diversity,
    "overlap": overlap,
    "connectives": lambda flat, own: connectives(flat),
    "givenness": givenness,
    "single_givenness": single_givenness,
}
COUNTS = ("nwords", "nsents", "nparas", "ntypes")


def indices(docs: DataFrame, families: dict[str, Family], adjectives: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, the indices of the families) for each row of ``docs``, annotated (``doc``) or not (``text``)."""
    source, field, pieces = pieces_of(docs, key)

    def of(flat: Flat) -> dict[str, np.ndarray]:
        own = masks(flat, adjectives)
        return {name: values for family in families.values() for name, values in family(flat, own).items()}

    names = list(of(flat_of_paragraphs(pa.array([], pa.list_(pa.string())))))
    fields = [StructField(n, LongType() if n in COUNTS else DoubleType()) for n in names]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, flat in pieces(batch):
                found = of(flat)
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(found[n], pa.int64() if n in COUNTS else pa.float64()) for n in names]], names=[key, *names])

    return source.mapInArrow(rows, StructType([field, *fields]))


def pieces_of(docs: DataFrame, key: str) -> tuple[DataFrame, StructField, Callable]:
    """The columns that are read of ``docs``, which are held (``flat``), annotated (``doc``) or neither (``text``); the field of a document's key;
    and how a batch of them becomes the keys and arrays of portions, of about so many characters unless they are held."""
    if "flat" in docs.columns:

        def held(batch: pa.RecordBatch, size: int = PORTION) -> Iterator[tuple[pa.Array, Flat]]:
            for i in range(len(batch)):
                yield batch.column(0)[i].values, unpacked(batch.column(1)[i].as_py())

        return docs.select(key, "flat"), StructField(key, docs.schema[key].dataType.elementType), held
    nested = "doc" in docs.columns
    flat_of = flat_of_nested if nested else flat_of_paragraphs

    def pieces(batch: pa.RecordBatch, size: int = PORTION) -> Iterator[tuple[pa.Array, Flat]]:
        for part in _portions(batch, size):
            yield part.column(0), flat_of(part.column(1))

    return docs.select(key, F.col("doc") if nested else paragraphs(F.lower("text")).alias("p")), docs.schema[key], pieces


def keys_of(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.explode(key).alias(key) if "flat" in docs.columns else key)


def packed(flat: Flat) -> bytes:
    """The arrays as a Zstandard frame. What follows from the word is kept once a word; numbers are kept byte by byte."""

    def by_word(values: np.ndarray) -> tuple[bool, np.ndarray]:
        table = np.zeros(len(flat.words), values.dtype)
        table[flat.raw] = values
        same = bool((table[flat.raw] == values).all())
        return same, table if same else values

    planes = np.ascontiguousarray(flat.raw.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    bounds = [np.diff(b).astype(np.int32) for b in (flat.sents, flat.paras, flat.docs)]
    return zstandard.compress(pickle.dumps((flat.words, planes, [by_word(x) for x in (flat.lemma, flat.tag, flat.aux)], flat.dep.astype(np.int8), bounds)), 3)


def unpacked(frame: bytes) -> Flat:
    words, planes, columns, dep, bounds = pickle.loads(zstandard.decompress(frame))
    raw = np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)
    lemma, tag, aux = (values[raw] if same else values for same, values in columns)
    return Flat(words, raw, lemma, tag, aux, dep, *[np.append(0, np.cumsum(b, dtype=np.int64)) for b in bounds])


def _portions(batch: pa.RecordBatch, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` characters each, or one document."""
    column = batch.column(1)
    share = max(1, int(len(batch) * size / max(column.nbytes, 1)))
    for start in range(0, len(batch), share):
        yield batch.slice(start, share)


# --- words and n-grams as rows, for joins with lexicons ---------------------------------------------------------

#: n-gram families by the tags that keep their lemma; all other words are ``x``.
MASKED = {"": None, "n": NOUN_TAGS, "adj": ADJECTIVE_TAGS, "v": VERB_TAGS, "v_n": VERB_TAGS + NOUN_TAGS, "a_n": ADJECTIVE_TAGS + NOUN_TAGS}
UNIGRAMS = {"uni": None, "n_uni": NOUN_TAGS, "v_uni": VERB_TAGS, "v_n_uni": VERB_TAGS + NOUN_TAGS, "adj_uni": ADJECTIVE_TAGS}
SIZES = {"bi": 2, "tri": 3, "quad": 4}
NGRAMS = tuple(f"{m}_{s}" if m else s for s in SIZES for m in MASKED)
ITEM_FAMILIES = (*UNIGRAMS, *NGRAMS)


def _rows(docs: DataFrame, key: str, fields: str, make: Callable[[Flat], list[tuple[np.ndarray, list[pa.Array]]]]) -> DataFrame:
    """Rows made of each document's arrays: (document of each row, its columns) for every part."""
    source, field, pieces = pieces_of(docs, key)
    names = [f.split()[0] for f in fields.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, flat in pieces(batch):
                for doc, columns in make(flat):
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *columns], names=[key, *names])

    return source.mapInArrow(rows, StructType([field, *StructType.fromDDL(fields).fields]))


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct combinations of keys, in order, and how often each stands."""
    if not len(keys[0]):
        return [k[:0] for k in keys], np.zeros(0, np.int64)
    code, size, steps = np.asarray(keys[0], np.int64), int(keys[0].max()) + 1, []
    for key in keys[1:]:  # one number for all keys; where it would be too long, what there is so far is numbered anew
        width = int(key.max()) + 1
        if size * width >= 1 << 62:
            table, code = np.unique(code, return_inverse=True)
            steps.append((0, table))
            size = len(table)
        code, size = code * width + key, size * width
        steps.append((width, None))
    code, counts = np.unique(code, return_counts=True)
    found = []
    for width, table in reversed(steps):
        if table is None:
            code, own = np.divmod(code, width)
            found.append(own)
        else:
            code = table[code]
    return [code, *reversed(found)], counts


def segment_words(docs: DataFrame, level: str = "sent", tags: tuple[str, ...] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, seg, word, k): the lemmas of each segment of a document (``sent``, ``para``, or ``doc``, one segment) with their
    occurrences; of words with one of the tags, if given. ``verb`` tags leave auxiliaries out."""

    def make(flat: Flat) -> list[tuple[np.ndarray, list[pa.Array]]]:
        keep = np.ones(len(flat.raw), bool) if tags is None else np.isin(flat.tag, tags) & (~flat.aux if "VB" in tags else True)
        doc = flat.doc[keep]
        first = {"sent": flat.doc_sents, "para": flat.docs, "doc": np.arange(flat.n)}[level]
        segment = {"sent": flat.sent, "para": flat.para, "doc": flat.doc}[level][keep] - first[doc]
        (doc, segment, word), k = _distinct(doc, segment, flat.lemma[keep])
        words = pa.array(flat.words, pa.string()).take(pa.array(word))
        return [(doc, [pa.array(segment, pa.int64()), words, pa.array(k, pa.int64())])]

    return _rows(docs, key, "seg long, word string, k long", make)


def corpus_words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, n): the lemmas of all documents with their occurrences."""
    source, _, pieces = pieces_of(docs, key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat in pieces(batch):
                n = np.bincount(flat.lemma, minlength=len(flat.words))
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(flat.words, pa.string()).take(pa.array(found)), pa.array(n[found], pa.int64())], names=["word", "n"])

    return source.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams_of(flat: Flat, family: str, within: str) -> list[np.ndarray]:
    """The document and the words of each occurrence of a family's items; a masked word is the word ``x``, whether the texts have it
    or not."""
    mask, _, size = family.rpartition("_")
    tags = UNIGRAMS[family] if family in UNIGRAMS else MASKED[mask]
    keep = np.ones(len(flat.raw), bool) if tags is None else flat.tagged(tags)
    if family in UNIGRAMS:
        return [flat.doc[keep], flat.lemma[keep]]
    n, unit = SIZES[size], flat.sent if within == "sent" else flat.doc
    ids = np.where(keep, flat.lemma, flat.number.get("x", len(flat.words)))
    start = np.arange(max(len(ids) - n + 1, 0))
    start = start[unit[start] == unit[start + n - 1]]
    return [flat.doc[start], *[ids[start + i] for i in range(n)]]


def item_texts(flat: Flat, grams: list[np.ndarray]) -> pa.Array:
    words = pa.array([*flat.words, "x"], pa.string())
    each = [words.take(pa.array(g, pa.int64())) for g in grams]
    return pc.binary_join_element_wise(*each, " ") if len(each) > 1 else each[0]


def items(docs: DataFrame, families: tuple[str, ...] = ITEM_FAMILIES, within: str = "sent", key: str = "doc_id", least: int = 1) -> DataFrame:
    """(key, family, item, k): lemmas and masked n-grams of each document with their occurrences, ``least`` at least; n-grams lie
    within a sentence or, with ``doc``, only within the document."""

    def of(flat: Flat, family: str) -> tuple[np.ndarray, list[pa.Array]]:
        (doc, *grams), k = _distinct(*grams_of(flat, family, within))
        if least > 1:
            doc, k, grams = doc[k >= least], k[k >= least], [g[k >= least] for g in grams]
        return doc, [pa.array([family] * len(doc), pa.string()), item_texts(flat, grams), pa.array(k, pa.int64())]

    return _rows(docs, key, "family string, item string, k long", lambda flat: [of(flat, f) for f in families])
