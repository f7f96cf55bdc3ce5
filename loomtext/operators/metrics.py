"""Document-level cohesion indices: families computed in one pass (``indices.py``), and what other operators need as
expressions over annotated tokens: word classes as SQL conditions, segments, n-grams.

Nothing here shuffles but the n-gram counts. Documents come annotated (a ``doc`` column) or as ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import connective_lists as lists
from loomtext.operators import indices as I

NOUNS, VERBS, ADJECTIVES, ADVERBS, PRONOUNS = "('NN','NNS','NNP','NNPS')", "('VB','VBD','VBG','VBN','VBP','VBZ','MD')", "('JJ','JJR','JJS')", "('RB','RBR','RBS')", "('PRP','PRP$')"
DEMONSTRATIVE = "(" + ", ".join(f"'{w}'" for w in lists.DEMONSTRATIVES) + ")"
UNATTENDED = f"(t.raw IN {DEMONSTRATIVE} AND t.dep <> 'det')"
CLASSES, CONNECTIVES = I.CLASSES, I.CONNECTIVES


def class_conditions(adjectives: list[str] | None = None, t: str = "t") -> dict[str, str]:
    """For each word class the SQL condition on a token. Auxiliaries are function words; an adverb is a content word if
    it, or it without -ly, is in the adjective list."""
    known = ", ".join("'" + a.replace("'", "''") + "'" for a in adjectives or []) or "' '"  # no word
    main = f"(t.tag IN {VERBS} AND t.pos <> 'AUX')"
    contentful = f"(t.lemma IN ({known}) OR (t.lemma LIKE '%ly' AND substr(t.lemma, 1, length(t.lemma) - 2) IN ({known})))"
    found = {
        "all": "true",
        "cw": f"(t.tag IN {NOUNS} OR t.tag IN {ADJECTIVES} OR {main} OR (t.tag IN {ADVERBS} AND {contentful}))",
        "fw": f"((t.tag NOT IN {NOUNS} AND t.tag NOT IN {ADJECTIVES} AND t.tag NOT IN {VERBS} AND t.tag NOT IN {ADVERBS}) OR (t.tag IN {VERBS} AND t.pos = 'AUX') OR (t.tag IN {ADVERBS} AND NOT {contentful}))",
        "noun": f"t.tag IN {NOUNS}",
        "verb": main,
        "adj": f"t.tag IN {ADJECTIVES}",
        "adv": f"t.tag IN {ADVERBS}",
        "pronoun": f"(t.tag IN {PRONOUNS} OR {UNATTENDED})",
        "argument": f"(t.tag IN {PRONOUNS} OR t.tag IN {NOUNS})",
    }
    return {k: v.replace("t.", f"{t}.") for k, v in found.items()}


def with_segments(annotated: DataFrame) -> DataFrame:
    """Adds ``sent`` (all sentences), ``para`` (paragraphs as token arrays) and ``tokens`` (all tokens)."""
    return annotated.withColumn("sent", F.flatten("doc")).withColumn("para", F.transform("doc", F.flatten)).withColumn("tokens", F.flatten("sent"))


def diversity(docs: DataFrame, adjectives: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """The 13 type-token and density indices and the two n-gram ratios."""
    return I.indices(docs, {"diversity": I.diversity}, adjectives, key)


def overlap(docs: DataFrame, levels: tuple[str, ...] = ("sent", "para"), classes: tuple[str, ...] = CLASSES, adjectives: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Adjacent overlap: six indices for each level and class (108 for all)."""
    return I.indices(docs, {"overlap": lambda flat, own: I.overlap(flat, own, levels, classes)}, adjectives, key)


def _quoted(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def token_conditions() -> dict[str, str]:
    """Of the indices that count tokens: the condition on a token. Linkers that need a mark are looked for within one
    string, so parts of its words match too."""
    found = {"lexical_subordinators": "t.dep = 'mark'", "attended_demonstratives": f"t.raw IN {DEMONSTRATIVE} AND t.dep = 'det'", "unattended_demonstratives": UNATTENDED}
    found["sentence_linking"] = f"t.raw IN {_quoted(lists.SENTENCE_LINKERS)}"
    found["sentence_linking_marked"] = f"t.dep = 'mark' AND instr('{lists.SENTENCE_LINKERS_CAVEAT[0]}', t.raw) > 0"
    for name, (_, alone, marked) in CONNECTIVES.items():
        if alone:
            found[name] = f"t.raw IN {_quoted(alone)}"
            found[f"{name}_marked"] = f"t.dep = 'mark' AND t.raw IN {_quoted(marked)}"
    return found


def connectives(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The 25 connective densities: phrases over the document's words, single words, and words that must be a mark."""
    return I.indices(docs, {"connectives": I.FAMILIES["connectives"]}, key=key)


def phrases_per_sentence(docs: DataFrame, named: dict[str, list[str]], key: str = "doc_id") -> DataFrame:
    """For each named list its phrases within sentences, by words of the document."""
    return I.indices(docs, {"phrases": lambda flat, own: {name: I.ratio(n, flat.sizes) for name, n in I.phrase_counts(flat, named, "sent").items()}}, key=key)


def givenness(docs: DataFrame, adjectives: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Pronoun density and ratio (unattended demonstratives count twice) and repeated content words."""
    return I.indices(docs, {"givenness": I.givenness}, adjectives, key)


def single_givenness(docs: DataFrame, adjectives: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """The shares of words that stand once, and more than once, in a document."""
    return I.indices(docs, {"single": I.single_givenness}, adjectives, key)


def basic_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return I.indices(docs, {"counts": I.FAMILIES["counts"]}, key=key)


def masked_ngrams(docs: DataFrame, family: str, key: str = "doc_id") -> DataFrame:
    """(key, ngram, count): n-grams of lemmas within sentences, of a family such as ``bi``, ``n_tri``, ``v_n_quad``; lemmas outside
    its classes are ``x``."""
    return I.items(docs, (family,), key=key).select(key, F.col("item").alias("ngram"), F.col("k").alias("count"))


def all_families(docs: DataFrame, families: tuple[str, ...] = ("diversity", "overlap", "connectives", "givenness"), adjectives: list[str] | None = None, key: str = "doc_id", more: dict[str, I.Family] | None = None) -> DataFrame:
    """One wide row a document with the families asked for, and ``more`` that are given, in one pass. A text of fewer than two words gets a
    status and no indices."""
    found = I.indices(docs, {"counts": I.FAMILIES["counts"], **{f: I.FAMILIES[f] for f in families}, **(more or {})}, adjectives, key)
    long = F.col("nwords") > 1
    names = [c for c in found.columns if c not in (key, *I.COUNTS)]
    return found.select(key, F.when(long, "ok").otherwise("text too short").alias("status"), *[F.when(long, F.col(c)).alias(c) for c in names])
