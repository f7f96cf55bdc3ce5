"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps words to classes: an offence carries a weight learnt from labelled
documents, for the whole word or for the stem it begins with; threats, persons addressed, negations
and verbs of reported speech are closed classes. Transducers for insults and threats, targets, negation and reported speech,
with their states, arcs and weights as data, are composed (``grammar.py``) and read each line: an offence alone is a
pattern with a weight of its own, one near a person weighs more, one in a negation's scope or in reported or quoted
speech less, and a threat counts only with a person after it. A document's score is the logistic of its clauses' sum,
with a bias and slope fitted on the same labelled rows.

Labels are read only from rows that are not held out; source, language and doc_id are no inputs.

Defined results: a null or empty text scores by the bias alone, below one half; a null doc_id is not held
out and never learnt from; repeated rows score alike; a document with both labels counts as toxic; without labels of both kinds only
the built-in words count; an empty table gives an empty result; extra columns do no harm, and ``drop_toxic`` keeps all columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.grammar import C, N, O, P, Q, R, S, T, W, line_scores
from loomtext.llm.runtime import cut, released
from loomtext.llm.units import Spans, batch_bytes, mix, salts, word_units, words

#: Labelled rows, at most, from which words and stems are learnt; a larger table is sampled by hash.
MAX_LABELLED = 40_000
STEMS = (4, 5, 6, 7)
#: An entry is learnt if at least LEAST_DOCS toxic documents have it and its hits are so one-sided that chance would hardly
#: do it among all the words and stems there are: about ENTRIES_A_DOC for each labelled document.
LEAST_DOCS, ENTRIES_A_DOC, MARGIN = 3, 50, 3.0
#: Min-hashes of a labelled text, and how many of them near-copies of one label share.
SKETCH, ALIKE, MEET = 16, 8, 3
LEAST_LOG_ODDS = 3.0
#: A stem is kept if it has this many times the hits of the best longer entry that begins with it.
OWN_HITS = 1.3

# closed classes: fixed words
TARGETS = frozenset("you your yours yourself he him his she her they them their these those du dich dir euch ihr sie tu te toi vous vos ton usted ustedes tú ti su".split())
NEGATIONS = frozenset("not no never nor none neither without isn't aren't don't doesn't wasn't won't nicht kein keine nie ne pas jamais sans nunca jamás sin ni".split())
REPORTS = frozenset("said says say quoted quote wrote writes called calls claimed claims according reported reports sagte sagt schrieb dit disait écrit dijo dice escribió".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn strangle umbringen töten tuer frapper matar golpear".split())

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:,\"“”»«]")
MARKS = {**dict.fromkeys(".!?;", S), **dict.fromkeys(":,", C), **dict.fromkeys("\"“”»«", Q)}


class Grammar(NamedTuple):
    weights: dict[str, float]  # of whole words, and of stems as "stem*"
    bias: float
    slope: float


def word_weight(word: str, weights: dict[str, float]) -> float:
    """The class weight of a word: its own, or the strongest of the stems it begins with."""
    found = weights.get(word)
    if found is not None:
        return found
    return max((weights.get(word[:k] + "*", 0.0) for k in STEMS if len(word) > k), default=0.0)


def word_class(word: str, weights: dict[str, float]) -> tuple[int, float]:
    """The lexical transducer: the class of a token, and an offence's weight."""
    for words, c in ((THREATS, T), (TARGETS, P), (NEGATIONS, N), (REPORTS, R)):
        if word in words:
            return c, 0.0
    if word in MARKS:
        return MARKS[word], 0.0
    weight = word_weight(word, weights)
    return (O, weight) if weight > 0 else (W, 0.0)


class Reader:
    """Scores texts by the composed transducers. An automaton over the learnt entries and the threats finds the lines that can
    hold an offence or threat; only these are cut into words and read."""

    ROOM = 1 << 16

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, tuple[int, float]] = {}
        self.starts = ahocorasick.Automaton()
        for entry in {*(w.rstrip("*") for w in weights), *THREATS}:
            self.starts.add_word(entry, len(entry))
        self.starts.make_automaton()

    def _class(self, token: str) -> tuple[int, float]:
        own = self.known.get(token)
        if own is None:
            own = word_class(token, self.weights)
            if len(self.known) < self.ROOM:
                self.known[token] = own
        return own

    def _lines(self, text: str) -> Iterator[str]:
        done = -1  # the end of the last line given
        for last, size in self.starts.iter(text):
            first = last + 1 - size
            if first > done and not (first and text[first - 1].isalnum()):
                done = text.find("\n", last)
                done = len(text) if done < 0 else done
                yield text[text.rfind("\n", 0, first) + 1 : done]

    def scores(self, text: str) -> tuple[float, int]:
        """(sum of the matched clauses' scores, matched clauses)."""
        total, matched = 0.0, 0
        for line in self._lines(text.lower()):
            found = [self._class(t) for t in TOKEN.findall(line)]
            score, n = line_scores([c for c, _ in found], [w for _, w in found])
            total, matched = total + score, matched + n
        return total, matched


def clause_scores(text: str, weights: dict[str, float]) -> tuple[float, int]:
    return Reader(weights).scores(text)


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a row is in the fold that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_entries: int = 2_000, most_hits: int = 4) -> Grammar:
    """Words and stems that mark toxic rows, by smoothed log odds of their hits, then bias and slope.

    Only rows that are not held out are read, at most about ``max_labelled`` of them, sampled by hash. Of copies and
    near-copies with one label, which min-hashes tell, one is used: the words of a text copied many times would all seem to
    mark its label. The rows' ids, a bounded number, are broadcast, so no text is shuffled. ``max_entries`` bounds the words and
    stems kept, strongest first. A document's hits of an entry, a word's occurrences or the different words that begin
    with a stem, count up to ``most_hits``, so that a document that repeats a word does not speak for many."""
    marked = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    total = marked.count()
    if total > max_labelled:
        marked = marked.where(F.pmod(F.xxhash64("__doc", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * max_labelled / total))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = cut(texts.join(F.broadcast(marked), F.col("doc_id") == F.col("__doc")).select("__doc", "__toxic", "text").mapInArrow(released(_sketches), "__doc long, __toxic int, s array<int>"))
    for k in range(MEET):  # heads of several rows only, a bounded number, go back to the rows by a broadcast
        heads = one.groupBy(F.col("__toxic").alias("t"), F.col("s")[k].alias("h")).agg(F.min(F.struct("__doc", "s")).alias("head"), F.count("__doc").alias("n")).where("n > 1").drop("n")
        alike = F.aggregate(F.zip_with("s", "head.s", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
        met = one.join(F.broadcast(heads), (F.col("__toxic") == F.col("t")) & (F.col("s")[k] == F.col("h")), "left")
        one = met.where(F.col("t").isNull() | (F.col("head.__doc") == F.col("__doc")) | (alike < ALIKE)).select("__doc", "__toxic", "s")
    one = cut(one.select("__doc", "__toxic").distinct())
    rows = texts.join(F.broadcast(one), F.col("doc_id") == F.col("__doc")).select("text", "__toxic")
    n_toxic, n_clean = (one.where(F.col("__toxic") == k).count() for k in (1, 0))
    weights: dict[str, float] = {}
    if n_toxic and n_clean:
        counted = rows.mapInArrow(released(_entries(most_hits)), "entry string, toxic long, hits long, others long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("toxic", "hits", "others")])
        odds = F.log((F.col("hits") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("others") + 0.5) / (n_clean + 1.0))
        share = n_toxic / (n_toxic + n_clean)
        n = F.col("hits") + F.col("others")
        sided = F.col("hits") * F.log(F.col("hits") / (n * share)) + F.when(F.col("others") > 0, F.col("others") * F.log(F.col("others") / (n * (1 - share)))).otherwise(0.0)
        strong = counted.where((F.col("toxic") >= LEAST_DOCS) & (sided >= math.log(ENTRIES_A_DOC * (n_toxic + n_clean)) + MARGIN)).withColumn("w", odds).where(F.col("w") >= LEAST_LOG_ODDS)
        best = strong.orderBy(F.col("w").desc(), F.length("entry"), "entry").limit(max_entries).collect()
        weights = _own_evidence([(r["entry"], float(r["w"]), int(r["hits"])) for r in best])
    tallies = rows.mapInArrow(released(_tallies(weights)), "score double, toxic long").groupBy(F.round("score", 1).alias("score"), "toxic").count().collect() if weights else []
    bias, slope = _fit([tuple(r) for r in tallies])
    return Grammar(weights, bias, slope)


def _own_evidence(entries: list[tuple[str, float, int]]) -> dict[str, float]:
    """The entries without stems that one longer entry explains: what begins with them needs hits of its own."""
    longer: dict[str, int] = {}
    for entry, _, hits in entries:
        core = entry.rstrip("*")
        for k in STEMS:
            if k < len(core):
                longer[core[:k]] = max(longer.get(core[:k], 0), hits)
    return {entry: w for entry, w, hits in entries if not entry.endswith("*") or hits >= OWN_HITS * longer.get(entry[:-1], 0)}


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Min-hashes of each text's runs of three words; shorter texts are one run, of the words they have."""
    for batch in batches:
        raw, bounds = batch_bytes(batch.column(2))
        starts, ends, of_docs = words(raw, bounds)
        spans = Spans(word_units(raw, starts, ends))
        grams = spans.rolling(3)
        found = np.zeros((len(batch), SKETCH), np.uint64)
        for i, (a, b) in enumerate(zip(of_docs[:-1].tolist(), of_docs[1:].tolist(), strict=True)):
            own = grams[a : b - 2] if b - a >= 3 else spans.hash(np.array([a]), np.array([b])) if b > a else np.zeros(1, np.uint64)
            found[i] = [mix(own ^ salt).min() for salt in salts(SKETCH, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((found >> np.uint64(33)).astype(np.int64).tolist(), pa.list_(pa.int32()))], names=["__doc", "__toxic", "s"])


def _entries(most_hits: int) -> Callable:
    """The words and stems of each labelled document, counted within the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = Counter(w for w in TOKEN.findall((text.as_py() or "").lower()) if w not in MARKS)
                own.update(w[:k] + "*" for w in list(own) for k in STEMS if len(w) > k)
                for entry, n in own.items():
                    tally = counts.setdefault(entry, [0, 0, 0])
                    tally[0] += toxic
                    tally[2 - toxic] += min(n, most_hits)
            if len(counts) > 1 << 20:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    return rows


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    tallies = [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *tallies], names=["entry", "toxic", "hits", "others"])


def _tallies(weights: dict[str, float]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights)
        for batch in batches:
            scores = [reader.scores(t.as_py() or "")[0] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), batch.column(1).cast(pa.int64())], names=["score", "toxic"])

    return rows


def _fit(tallies: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Bias and slope of a logistic in log1p(score), by gradient steps on a histogram of scores."""
    bias, slope = -4.0, 3.0
    total = sum(n for _, _, n in tallies)
    if not total:
        return bias, slope
    for _ in range(400):
        gb = gs = 0.0
        for score, toxic, n in tallies:
            x = math.log1p(score)
            error = (logistic(bias + slope * x) - toxic) * n / total
            gb, gs = gb + error, gs + error * x
        bias, slope = bias - 2.0 * gb, max(slope - 2.0 * gs, 0.1)
    return min(bias, -0.1), slope


def _scores(grammar: Grammar) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grammar.weights)
        for batch in batches:
            found = [reader.scores(t.as_py() or "") for t in batch.column(2)]
            scores = [logistic(grammar.bias + grammar.slope * math.log1p(s)) for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([n for _, n in found], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted", "clauses"],
            )

    return rows


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses (matched ones) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(released(_scores(grammar)), "doc_id long, held_out boolean, score double, predicted int, clauses int")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold, all columns, in one pass over the table."""
    names = docs.columns
    at = names.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grammar.weights)
        for batch in batches:
            sums = [reader.scores(t.as_py() or "")[0] for t in batch.column(at)]
            keep = [logistic(grammar.bias + grammar.slope * math.log1p(s)) < threshold for s in sums]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(rows), docs.schema)
