"""Annotation of documents as nested arrays: paragraphs of sentences of tokens.

``annotate`` is the rule annotator, a column expression that stays in the JVM. Any other annotator that gives
the same nested type can take its place, for instance a tagger run by ``mapInPandas`` (``annotate_with``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import paragraphs

TOKEN = "struct<raw:string,lemma:string,tag:string,pos:string,dep:string>"
NESTED = f"array<array<array<{TOKEN}>>>"

# closed classes of the rule annotator
CLOSED = {
    "PRP": "i you he she it we they me him us them",
    "PRP$": "my your his her its our their",
    "DT": "a an the this that these those",
    "TO": "to",
    "CC": "and or but nor yet so",
    "IN": "of in on at by for with from as after before since if because although while until unless",
    "MD": "can could will would shall should may might must",
    "VBP": "is are was were be been being am have has had do does did",
    "RB": "not very too also then",
}
MARKS = "because if while although since so for after before as that until unless"
DETERMINED = "a an the this that these those"


def _list(words: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def tag_sql(raw: str) -> str:
    """The tag of a word as an SQL CASE that Spark and other engines read alike."""
    closed = " ".join(f"WHEN {raw} IN {_list(words)} THEN '{tag}'" for tag, words in CLOSED.items())
    return f"CASE {closed} WHEN regexp_like({raw}, '^[0-9]+$') THEN 'CD' WHEN {raw} LIKE '%ly' THEN 'RB' WHEN {raw} LIKE '%ing' THEN 'VBG' WHEN {raw} LIKE '%ed' THEN 'VBD' WHEN {raw} LIKE '%ble' OR {raw} LIKE '%al' OR {raw} LIKE '%ous' OR {raw} LIKE '%ful' THEN 'JJ' WHEN {raw} LIKE '%s' AND length({raw}) > 3 THEN 'NNS' ELSE 'NN' END"


def lemma_sql(raw: str) -> str:
    return f"CASE WHEN {raw} LIKE '%s' AND NOT {raw} LIKE '%ss' AND length({raw}) > 3 THEN substr({raw}, 1, length({raw}) - 1) ELSE {raw} END"


def pos_sql(raw: str) -> str:
    return f"CASE WHEN {raw} IN {_list(CLOSED['VBP'] + ' ' + CLOSED['MD'])} THEN 'AUX' ELSE 'X' END"


def dep_sql(raw: str, place: str, size: str) -> str:
    """``place`` counts from 0: determiners that a word follows are det, subordinators after the first word are mark."""
    return f"CASE WHEN {raw} IN {_list(DETERMINED)} AND {place} < {size} - 1 THEN 'det' WHEN {raw} IN {_list(MARKS)} AND {place} > 0 THEN 'mark' ELSE 'dep' END"


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``doc``: the text's paragraphs, sentences (with at least one word) and tokens."""
    split = docs.withColumn("__paras", paragraphs(F.lower(text)))
    token = f"named_struct('raw', w, 'lemma', {lemma_sql('w')}, 'tag', {tag_sql('w')}, 'pos', {pos_sql('w')}, 'dep', {dep_sql('w', 'i', 'size(s)')})"
    sentences = r"filter(transform(regexp_extract_all(p, '[^.!?]+', 0), x -> regexp_extract_all(x, '[\\p{L}\\p{N}]+', 0)), s -> size(s) > 0)"
    return split.withColumn("doc", F.expr(f"transform(__paras, p -> transform({sentences}, s -> transform(s, (w, i) -> {token})))")).drop("__paras")


def annotate_with(docs: DataFrame, annotator: Callable[[str], list], text: str = "text") -> DataFrame:
    """Adds ``doc`` by a Python annotator, text -> nested lists of token dicts, in Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", doc {NESTED}"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(doc=[annotator(t or "") for t in batch[text]])

    return docs.mapInPandas(rows, schema)


def token_table(annotated: DataFrame, key: str = "doc_id") -> DataFrame:
    """The long form: key, para, sent (within the paragraph), pos_in_sent, raw, lemma, tag, pos, dep."""
    paras = annotated.select(key, F.posexplode("doc").alias("para", "p"))
    sents = paras.select(key, "para", F.posexplode("p").alias("sent", "s"))
    return sents.select(key, "para", "sent", F.posexplode("s").alias("place", "t")).select(key, "para", "sent", "place", "t.*")


def tagged_table(annotated: DataFrame, conditions: dict[str, str], key: str = "doc_id") -> DataFrame:
    """The diagnostic form: the token table with CW or FW, a flag for each word class, and where a sentence or paragraph ends.
    ``conditions`` are those of ``metrics.class_conditions`` over ``t``."""
    paras = annotated.select(key, F.posexplode("doc").alias("para", "p"))
    sents = paras.select(key, "para", F.size("p").alias("n_sents"), F.posexplode("p").alias("sent", "s"))
    tokens = sents.select(key, "para", "sent", "n_sents", F.size("s").alias("n"), F.posexplode("s").alias("place", "t"))
    last = F.col("place") == F.col("n") - 1
    kind = F.when(F.expr(conditions["cw"]), "CW").when(F.expr(conditions["fw"]), "FW")
    ends = F.when(last & (F.col("sent") == F.col("n_sents") - 1), "paragraph").when(last, "sentence")
    flags = [F.expr(cond).alias(f"is_{name}") for name, cond in conditions.items() if name not in ("all", "cw", "fw")]
    return tokens.select(key, "para", "sent", "place", F.col("t.raw").alias("word"), F.col("t.lemma").alias("lemma"), F.col("t.tag").alias("tag"), kind.alias("kind"), *flags, ends.alias("ends"))
