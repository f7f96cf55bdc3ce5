"""Scores and preference data: z-means, composites, rewards, pairs, validity, repetition, summaries."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loomtext.functions.text import strip, words

#: The metrics of a composite score, each with the mean and deviation it is scaled by.
SCORED = ("noun_ttr", "verb_ttr", "adj_ttr", "lemma_ttr", "bigram_lemma_ttr", "trigram_lemma_ttr", "adjacent_overlap_all_sent", "repeated_content_lemmas", "repeated_content_and_pronoun_lemmas")


#: The metrics of an annotated dialogue's aggregate: those of a score and the topic similarity of adjacent sentences.
ANNOTATED = (*SCORED[:7], "lda_1_all_sent", *SCORED[7:])


def z_mean(rows: DataFrame, columns: list[str], name: str = "aggregate", by: int | None = None) -> DataFrame:
    """Adds the mean of the columns' z-scores (population deviation; 0 where it is 0). One aggregate row is joined back."""
    stats = rows.agg(*[f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    zs = [F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)) for c in columns]
    total = sum(zs[1:], zs[0]) / float(by or len(columns))
    return rows.crossJoin(F.broadcast(stats)).withColumn(name, total).select(*rows.columns, name)  # one row


def composite(columns: dict[str, Column], mean: float = 0.0, sd: float = 1.0) -> Column:
    """Sigmoid of the mean of the scaled metrics that are numbers; 0 where there are none."""
    usable = F.filter(F.array(*columns.values()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    average = F.aggregate(usable, F.lit(0.0), lambda a, x: a + (x - mean) / sd) / F.size(usable)
    return F.when(F.size(usable) == 0, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-average)))


def reward(child: Column, teacher: Column) -> Column:
    """The child's score less the teacher's; one half for a score that failed."""
    return F.coalesce(child, F.lit(0.5)) - F.coalesce(teacher, F.lit(0.5))


def preference_rows(pairs: DataFrame) -> DataFrame:
    """prompt, chosen, rejected, score_chosen, score_rejected -> with token_count and valid."""
    return pairs.withColumn("token_count", F.size(words(F.col("chosen"))).cast("long")).withColumn("valid", F.coalesce(F.col("score_chosen") > F.col("score_rejected"), F.lit(False)))


@F.pandas_udf(BooleanType())
def _alike(prompt: pd.Series, response: pd.Series, threshold: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, list(p), list(r)).ratio() > t for p, r, t in zip(prompt, response, threshold, strict=True)])


def repetitive_native(prompt: Column, response: Column) -> Column:
    """The rules that need no sequence matcher: too short, too few words, or the prompt's end inside; a null or empty prompt's end
    is in every response."""
    own = words(F.coalesce(response, F.lit("")))
    tail = lambda a, n: F.when(F.size(a) > n, F.slice(a, F.size(a) - n + 1, n)).otherwise(a)
    end = F.array_join(tail(words(F.coalesce(prompt, F.lit(""))), 50), " ")
    return response.isNull() | (F.length(strip(response)) < 10) | (F.size(own) < 5) | F.contains(response, end)


def repetitive(prompt: Column, response: Column, threshold: float = 0.8) -> Column:
    """Whether a response only repeats its prompt. The matcher sees rows that the other rules leave, in Arrow batches."""
    p, r = words(F.coalesce(prompt, F.lit(""))), words(F.coalesce(response, F.lit("")))
    tail = F.when(F.size(p) > 20, F.slice(p, F.size(p) - 19, 20)).otherwise(p)
    head = F.slice(r, 1, 20)
    return F.when(repetitive_native(prompt, response), F.lit(True)).when(F.size(head) >= 10, _alike(tail, head, F.lit(threshold))).otherwise(F.lit(False))


def accepted_batches(rows: DataFrame, batch: str, ratio: float = 0.7, retries: Column | None = None, most: int = 2) -> DataFrame:
    """Rows of batches of which enough are valid or whose retries are used up."""
    used = (retries if retries is not None else F.lit(0)) >= most
    fine = rows.withColumn("__used", used).groupBy(batch).agg(F.avg(F.col("valid").cast("double")).alias("rate"), F.max("__used").alias("used")).where((F.col("rate") >= ratio) | F.col("used")).select(batch)
    return rows.join(fine, batch, "left_semi")


def summary(rows: DataFrame) -> DataFrame:
    """Counts, mean and sample deviation of scores, and the spread of token counts."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        *[f(c).alias(f"{c}_{k}") for c in ("score_chosen", "score_rejected") for k, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.avg("token_count").alias("token_count_mean"),
        F.min("token_count").alias("token_count_min"),
        F.max("token_count").alias("token_count_max"),
    )


def valid_rates(rows: DataFrame, batch: str) -> DataFrame:
    """The share of valid rows by batch, and over all under a null batch."""
    return rows.rollup(batch).agg((F.count_if("valid") / F.count("*")).alias("valid_rate"), F.count("*").alias("rows"))


def positive_score(scores: Column, label: str = "POSITIVE") -> Column:
    """The score under one label of an array<struct<label, score>>."""
    return F.get(F.filter(scores, lambda s: s["label"] == label), F.lit(0))["score"]


def ranked_only(pairs: DataFrame, rankings: DataFrame, key: str) -> DataFrame:
    """The pairs that have a ranking, with its columns; an empty ranking, all of whose columns are null, is none."""
    given = [c for c in rankings.columns if c != key]
    return pairs.join(rankings.where(F.coalesce(*[F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in given], F.lit(False))), key)


def single_token_words(words: DataFrame, ids: str) -> DataFrame:
    """The words that a tokenizer gives one id."""
    return words.where(F.size(ids) == 1)


def weighted_metrics(metrics: dict[str, Column], weights: dict[str, float]) -> Column:
    """A struct of the metrics that have a weight, each times its weight."""
    return F.struct(*[(F.coalesce(metrics[name], F.lit(0.0)) * weight).alias(name) for name, weight in weights.items() if name in metrics])

