"""Registered queries of the composites: all indices by options, rewards, annotated dialogues, preference rounds, each with DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import indices as I
from loomtext.operators import metrics as M
from loomtext.operators import prefs as P
from loomtext.operators.held import hold
from loomtext.plans import cohesion as CO
from loomtext.plans import pipelines as R
from loomtext.plans import table_queries as Q
from loomtext.plans import text_queries as X
from loomtext.plans.registry import ORACLES, query, rounded
from loomtext.shared import fresh_dir
from loomtext.sources import io

SHARES = [f"{f}_keywords_percentage" for f in I.ITEM_FAMILIES]
SYNONYMS = [f"syn_overlap_{level}_{c}" for level in ("sent", "para") for c in ("noun", "verb")]
#: Sub-folders of the folder of texts, and the groups in which they are taken: texts and what is made of them lie on disk together for one group.
SPREAD, GROUPS = 256, 8
VECTORS = [name for level in ("sent", "para") for name, _, _ in X.VECTOR_KINDS[level]]


def _gated(parts: list[str], names: list[str]) -> str:
    """Other queries' SQL side by side, null where a document has fewer than two words."""
    joined = " ".join(f"LEFT JOIN ({ORACLES[q]}) AS p{i} USING (doc_id)" for i, q in enumerate(parts))
    fixed = ", ".join(f'CASE WHEN nwords > 1 THEN "{n}" END AS "{n}"' for n in names)
    return f"SELECT doc_id, CASE WHEN nwords > 1 THEN 'ok' ELSE 'text too short' END AS status, {fixed} FROM ({ORACLES['q_basic_counts']}) AS w {joined}"


@query(_gated(["q_givenness", "q_synonym_overlap", "q_vector_similarity", "q_vector_similarity_paragraphs", "q_source_keyword_shares", "q_source_similarity"], [*X.FAMILY_NAMES["givenness"], *SYNONYMS, *VECTORS, *SHARES, "source_similarity_lsa", "source_similarity_lda"]))
def process_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with and without lexicons in one call; the next document is a document's source."""
    docs = hold(X.texts(spark, sf_dir))
    words = io.save_table(I.corpus_words(docs), f"{fresh_dir(spark, 'words')}/counts")
    vectors = X._vectors(spark, sf_dir, words)
    lexicons = CO.Lexicons(X._entries(words), vectors, vectors, None, X._family_reference(docs), tuple(X.ADJECTIVES), 64)
    found = CO.process_texts(docs, lexicons, ("givenness", "synonyms", "lsa", "lda", "source_keywords", "source_similarity"), X.next_texts(docs))
    rough = [*VECTORS, "source_similarity_lsa", "source_similarity_lda"]
    return found.select(*[F.round(c, 4 if c in rough else 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(f"""SELECT doc_id || '.txt' AS "Filename", status, {', '.join(f'"{n}"' for n in [*X.DIVERSE, *X.MOVING, *X.FAMILY_NAMES['givenness']])} FROM ({ORACLES['q_all_families']})""")
def run_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files, written first, to a CSV of indices, read back."""
    folder = fresh_dir(spark, "texts")
    io.write_files(X.texts(spark, sf_dir).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), "name", "text", folder, SPREAD)
    found = CO.run_folder(spark, folder, None, CO.Lexicons(adjectives=tuple(X.ADJECTIVES)), ("diversity", "givenness"), tagged=True, counts=True, spread=SPREAD, groups=GROUPS, compression="gzip", consume=True)
    return rounded(found.select("Filename", "status", *X.DIVERSE, *X.MOVING, *X.FAMILY_NAMES["givenness"]))


# --- rewards ----------------------------------------------------------------------------------------------------


def scores_sql(documents: str) -> str:
    """(doc_id, status, the metrics of a score, score) of the texts of a subquery (doc_id, text), without adjectives."""
    plain = X.unrounded(X.without_adjectives(ORACLES["q_all_families"]))
    total = " + ".join(f'"{n}"' for n in P.SCORED)
    return f"""WITH documents AS ({documents}) SELECT doc_id, status, {', '.join(f'"{n}"' for n in P.SCORED)}, CASE WHEN status = 'ok' THEN 1 / (1 + exp(-({total}) / {len(P.SCORED)})) ELSE 0 END AS score FROM ({plain})"""


@query(f"""WITH {Q.PAIRS} SELECT p.conv_id, p.turn, round(c.score, 4) AS child_score, round(t.score, 4) AS teacher_score, round(c.score - t.score, 4) AS reward FROM pairs AS p
JOIN ({scores_sql("SELECT conv_id * 1000 + turn AS doc_id, rejected AS text FROM pairs")}) AS c ON c.doc_id = p.conv_id * 1000 + p.turn JOIN ({scores_sql("SELECT conv_id * 1000 + turn AS doc_id, chosen AS text FROM pairs")}) AS t ON t.doc_id = p.conv_id * 1000 + p.turn""")
def child_teacher_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores of one conversation's answers and of another's, and their difference."""
    pairs = Q._pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("rejected").alias("child"), F.col("chosen").alias("teacher"))
    found = R.compute_rewards(pairs)
    return found.select(F.floor(F.col("id") / 1000).cast("long").alias("conv_id"), (F.col("id") % 1000).alias("turn"), F.round("child_score", 4).alias("child_score"), F.round("teacher_score", 4).alias("teacher_score"), F.round("reward", 4).alias("reward"))


@query(f"""SELECT doc_id, round(score, 4) AS composite_score, round(coalesce(lemma_ttr, 0) * 2, 4) AS twice_lemma_ttr, round(coalesce(noun_ttr, 0) * 0.5, 4) AS half_noun_ttr, round(verb_ttr, 4) AS verb_ttr FROM ({scores_sql("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations")})""")
def detailed_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Q._read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    found = R.detailed_analysis(turns, {"lemma_ttr": 2.0, "noun_ttr": 0.5, "unknown": 9.0}, "doc_id")
    return rounded(found.select("doc_id", "composite_score", F.col("weighted_metrics.lemma_ttr").alias("twice_lemma_ttr"), F.col("weighted_metrics.noun_ttr").alias("half_noun_ttr"), F.col("detailed_metrics.verb_ttr").alias("verb_ttr")), 4)


# --- annotated dialogues ----------------------------------------------------------------------------------------

_TEXT = "array_to_string(list_transform(turns, lambda t: t.speaker || ': ' || t.text), chr(10))"
_USER = "coalesce(array_to_string(list_transform(list_filter(turns, lambda t: t.speaker = 'user'), lambda t: t.text), ' '), '')"


def _annotated_sql(text: str, name: str) -> str:
    """(doc_id, lemma_ttr, lda_1_all_sent, lexicon mean, aggregate of ten z-scores) of a text of each dialogue."""
    ten = [f'"{c}"' for c in P.ANNOTATED]
    z = " + ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)" for c in ten)
    return f"""(WITH documents AS (SELECT conv_id * 1000 + dialogue AS doc_id, {text} AS text FROM chunks),
lex AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark), b AS (SELECT min(length(word)) AS lo, max(length(word)) AS hi FROM lex),
means AS (SELECT doc_id, sum(length(word)) AS s, avg(length(word)) AS m FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' ')) AS word FROM documents) JOIN lex USING (word) GROUP BY doc_id)
SELECT doc_id, round(lemma_ttr, 4) AS lemma_ttr_{name}, round(lda_1_all_sent, 4) AS lda_{name}, round(CASE WHEN s > 0 THEN (m - lo) / (hi - lo) END, 6) AS lexicon_{name}, round(({z}) / 10, 5) AS aggregate_{name}
FROM ({X.unrounded(X.without_adjectives(ORACLES['q_all_families']))}) AS f JOIN ({X.unrounded(ORACLES['q_vector_similarity'])}) AS v USING (doc_id) LEFT JOIN means USING (doc_id), b)"""


@query(f"""{Q.CHUNKS} SELECT conv_id, dialogue, len(regexp_extract_all({_TEXT}, '\\S+'))::BIGINT AS num_words, d.* EXCLUDE (doc_id), u.* EXCLUDE (doc_id) FROM chunks JOIN {_annotated_sql(_TEXT, 'dialog')} AS d ON d.doc_id = conv_id * 1000 + dialogue JOIN {_annotated_sql(_USER, 'user')} AS u ON u.doc_id = conv_id * 1000 + dialogue""")
def annotated_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues and the turns of one speaker in them: indices, the lexicon mean, and the aggregate of ten."""
    lexicon = Q._read(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct().select("word", F.length("word").cast("double").alias("value"), F.lit(1).alias("line"))
    utterances = Q._utterances(spark, sf_dir)
    chunks = Q.D.chunk_dialogues(utterances, "conv_id", "k")

    def topics(text) -> DataFrame:  # the fixture's vectors follow the words of the very texts
        own = chunks.select((F.col("conv_id") * 1000 + F.col("dialogue")).alias("doc_id"), text.alias("text"))
        return X._vectors(spark, sf_dir, I.segment_words(own, "doc").groupBy("word").agg(F.sum("k").alias("n")))

    out = None
    for name, speakers, text in (("dialog", (), Q.D.dialogue_text(F.col("turns"))), ("user", ("user",), Q.D.speaker_view(F.col("turns"), "user"))):
        found = R.annotate_dialogues(utterances, "conv_id", "k", lexicon, topics(text), speakers, dims=64)
        own = found.select("conv_id", "dialogue", *(["num_words"] if out is None else []), F.round(f"metrics_{name}.lemma_ttr", 4).alias(f"lemma_ttr_{name}"), F.round(f"metrics_{name}.lda_1_all_sent", 4).alias(f"lda_{name}"), F.round(f"lexicon_{name}", 6).alias(f"lexicon_{name}"), F.round(f"aggregate_{name}", 5).alias(f"aggregate_{name}"))
        out = own if out is None else out.join(own, ["conv_id", "dialogue"])
    return out


# --- preference data --------------------------------------------------------------------------------------------


def _child(prompts: pd.Series) -> pd.Series:
    return prompts.str.slice(0, 20)


def _teacher(prompts: pd.Series) -> pd.Series:
    return prompts.str[::-1] + " and several more words than that"


def _length(texts: pd.Series) -> pd.Series:
    return texts.str.len().astype(float)


PREFERENCES = """SELECT conv_id, turn, text AS prompt, reverse(text) || ' and several more words than that' AS chosen, left(text, 20) AS rejected, (length(text) + 33)::DOUBLE AS score_chosen, least(length(text), 20)::DOUBLE AS score_rejected, (len(regexp_extract_all(text, '\\S+')) + 6)::BIGINT AS token_count, true AS valid FROM conversations WHERE role = 'user'"""


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))


@query(PREFERENCES)
def preference_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, a child's and a teacher's text, their scores; functions stand in for models."""
    return R.preference_dataset(_prompts(spark, sf_dir), _child, _teacher, _length)


@query("""SELECT round, count(*)::BIGINT AS n, sum(token_count)::BIGINT AS tokens FROM (SELECT least((row_number() OVER (ORDER BY k) - 1) // (count(*) OVER () // 3), 2)::BIGINT AS round, token_count FROM (SELECT conv_id * 1000 + turn AS k, len(regexp_extract_all(text, '\\S+')) + 6 AS token_count FROM conversations WHERE role = 'user')) GROUP BY round""")
def iterative_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds that accumulate preference rows; training is a function that does nothing here."""
    rows = _prompts(spark, sf_dir).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    make = lambda part, i: R.preference_dataset(part, _child, _teacher, _length).withColumn("round", F.lit(i).cast("long"))
    done = R.iterative_rounds(rows, "k", 3, make, lambda every, i: None, fresh_dir(spark, "rounds"))
    return done.groupBy("round").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query("""SELECT attempt, count(*)::BIGINT AS n, (count(*) FILTER (WHERE valid))::BIGINT AS valid FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS attempt, doc_id % 4 < 3 AS valid FROM documents) GROUP BY attempt""")
def with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are made again for the prompts that were not valid while too few are: a quarter at first, then three of four."""
    prompts = Q._read(spark, sf_dir, "documents").select("doc_id")
    make = lambda left, attempt: left.withColumn("valid", F.col("doc_id") % 4 < (1 if attempt == 0 else 3))
    done = R.with_retries(prompts, make, "doc_id", fresh_dir(spark, "attempts"))
    return done.groupBy("attempt").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


@query("""SELECT conv_id, turn, left(text, 20) AS child, 'T:' || left(text, 20) AS teacher, length(text)::DOUBLE AS score FROM conversations WHERE role = 'user'""")
def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child's continuation, a teacher's answer to it and a scorer's number, a batch at a time."""
    made = R.apply_batches(_prompts(spark, sf_dir), "prompt", "child", _child)
    taught = R.apply_batches(made, "child", "teacher", lambda s: "T:" + s)
    return R.apply_batches(taught, "prompt", "score", _length, "double").select("conv_id", "turn", "child", "teacher", "score")
