"""Composite pipelines: dialogue annotation, rewards, preference rows, rounds of generation.

Models stay outside: a ``Generator`` maps prompts to texts and a ``Scorer`` texts to numbers, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.config import EngineConfig
from loomtext.functions import text as T
from loomtext.operators import dialogue as D
from loomtext.operators import lexicon as L
from loomtext.operators import indices as I
from loomtext.operators import metrics as M
from loomtext.operators import prefs as P
from loomtext.operators import select as S
from loomtext.operators import similarity as V
from loomtext.shared import cut

Generator = Callable[[pd.Series], pd.Series]
Scorer = Callable[[pd.Series], pd.Series]


def apply_batches(rows: DataFrame, source: str, target: str, model: Callable[[pd.Series], pd.Series], kind: str = "string") -> DataFrame:
    """Adds a column that a model makes from another, an Arrow batch at a time. A batch that fails gives ``[ERROR]`` for texts
    and null for numbers, its rows are kept."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{target}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                made = model(batch[source])
            except Exception:  # noqa: BLE001  a model's failure is data here
                made = pd.Series(["[ERROR]" if kind == "string" else None] * len(batch), index=batch.index)
            yield batch.assign(**{target: made})

    return rows.mapInPandas(run, schema)


def composite_scores(texts: DataFrame, key: str = "id", adjectives: list[str] | None = None) -> DataFrame:
    """(key, score): sigmoid of the mean of the selected indices; 0 for texts of fewer than two words. One pass over the texts."""
    rows = scored_metrics(texts, key, adjectives)
    score = P.composite({c: F.col(c) for c in P.SCORED})
    return rows.select(key, F.when(F.col("status") == "ok", score).otherwise(0.0).alias("score"))


def scored_metrics(texts: DataFrame, key: str = "id", adjectives: list[str] | None = None) -> DataFrame:
    """(key, status, the metrics of a score) for each text, without white space around it."""
    docs = texts.select(key, F.coalesce(T.strip(F.col("text")), F.lit("")).alias("text"))
    return M.all_families(docs, ("diversity", "overlap", "givenness"), adjectives, key).select(key, "status", *P.SCORED)


def detailed_analysis(texts: DataFrame, weights: dict[str, float], key: str = "id", adjectives: list[str] | None = None) -> DataFrame:
    """(key, composite_score, detailed_metrics, weighted_metrics): the score of each text and what it is made of."""
    rows = scored_metrics(texts, key, adjectives)
    score = F.when(F.col("status") == "ok", P.composite({c: F.col(c) for c in P.SCORED})).otherwise(0.0)
    return rows.select(key, score.alias("composite_score"), F.struct(*P.SCORED).alias("detailed_metrics"), P.weighted_metrics({c: F.col(c) for c in P.SCORED}, weights).alias("weighted_metrics"))


def compute_rewards(pairs: DataFrame, key: str = "id") -> DataFrame:
    """(key, child, teacher) texts -> (key, child_score, teacher_score, reward)."""
    both = pairs.select(F.struct(key, F.lit(0).alias("s")).alias("k"), F.col("child").alias("text")).unionByName(pairs.select(F.struct(key, F.lit(1).alias("s")).alias("k"), F.col("teacher").alias("text")))
    scores = composite_scores(both, "k").select(F.col(f"k.{key}").alias(key), F.col("k.s").alias("s"), "score")
    wide = scores.groupBy(key).agg(*[F.max(F.when(F.col("s") == i, F.col("score"))).alias(name) for i, name in enumerate(("child_score", "teacher_score"))])
    return wide.select(key, "child_score", "teacher_score", P.reward(F.col("child_score"), F.col("teacher_score")).alias("reward"))


def annotate_dialogues(utterances: DataFrame, group: str, order: str, lexicon: DataFrame, topics: DataFrame | None = None, speakers: tuple[str, ...] = (), config: EngineConfig = EngineConfig(), dims: int = 300) -> DataFrame:  # noqa: B008  frozen
    """Utterances to annotated dialogues: five-turn chunks, cleaned text and word counts, the token budget, and, for the dialogue and
    for each of the ``speakers``' turns in it, the indices packed in a struct, the lexicon mean, and the mean z-score of the
    selected indices: ten with ``topics`` (word, vec), else the nine that need no lexicon."""
    d = D.chunk_dialogues(utterances, group, order).withColumn("text", D.dialogue_text(F.col("turns")))
    cleaned = d.withColumn("cleaned", T.strip_markers(F.col("text"))).withColumn("num_words", T.word_count(F.col("cleaned")))
    kept = cut(S.token_budget(cleaned.withColumn("id", F.struct(group, "dialogue")), "num_words", config.budget, "id").drop("running"))
    out = kept
    for name, text in (("dialog", F.col("cleaned")), *[(s, D.speaker_view(F.col("turns"), s)) for s in speakers]):
        out = out.join(_described(kept.select("id", text.alias("text")), name, lexicon, topics, config, dims), "id", "left")
    return out.drop("id")


def _described(docs: DataFrame, name: str, lexicon: DataFrame, topics: DataFrame | None, config: EngineConfig, dims: int) -> DataFrame:
    """(id, metrics, lexicon mean, aggregate), the columns named after what is described."""
    rows = M.all_families(docs, config.families, list(config.adjectives), "id").drop("status")
    if topics is not None:
        sums = V.segment_sums(I.segment_words(docs, "sent", key="id"), topics, ["id", "seg"])
        segments = M.basic_counts(docs, "id").select("id", F.col("nsents").alias("n_segments"))
        rows = rows.join(V.adjacent_similarity(sums, segments, "id", "seg", 1, "divergence", dims).withColumnRenamed("similarity", "lda_1_all_sent"), "id")
    packed = rows.select("id", F.struct(*[c for c in rows.columns if c != "id"]).alias(f"metrics_{name}"))
    words = docs.select("id", F.explode(F.split(T.alnum_only(F.lower("text")), " ")).alias("word"))
    scored = [c for c in (P.ANNOTATED if topics is not None else P.SCORED) if c in rows.columns]
    z = P.z_mean(rows.select("id", *scored), scored, f"aggregate_{name}").select("id", f"aggregate_{name}")
    mean = L.normalised_mean(words, lexicon, "id").withColumnRenamed("score", f"lexicon_{name}")
    return packed.join(mean, "id", "left").join(z, "id", "left")


def preference_dataset(prompts: DataFrame, child: Generator, teacher: Generator, scorer: Scorer | None = None, threshold: float = 0.8) -> DataFrame:
    """prompt rows -> preference rows: the teacher's text is chosen, the child's rejected; repeated prompts go."""
    rows = apply_batches(apply_batches(prompts, "prompt", "rejected", child), "prompt", "chosen", teacher)
    rows = rows.where(~P.repetitive(F.col("prompt"), F.col("chosen"), threshold) & (F.col("chosen") != "[ERROR]") & (F.col("rejected") != "[ERROR]"))
    if scorer is None:
        return P.preference_rows(rows.withColumn("score_chosen", F.lit(None).cast("double")).withColumn("score_rejected", F.lit(None).cast("double")))
    scored = apply_batches(apply_batches(rows, "chosen", "score_chosen", scorer, "double"), "rejected", "score_rejected", scorer, "double")
    return P.preference_rows(scored)


def with_retries(prompts: DataFrame, make: Callable[[DataFrame, int], DataFrame], key: str, folder: str, config: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008  frozen
    """Makes rows for all prompts, then again for those that were not valid while too few of all are, a bounded number of
    times; each attempt is written before the next."""
    spark = prompts.sparkSession
    total, left, paths = prompts.count(), prompts, []
    for attempt in range(config.max_retries + 1):
        path = f"{folder}/attempt-{attempt}"
        make(left, attempt).withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(path)
        paths.append(path)
        done = spark.read.parquet(*paths)
        valid = done.where("valid").select(key).distinct()
        if not total or valid.count() >= config.valid_ratio * total:
            break
        left = prompts.join(valid, key, "left_anti")
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("valid").desc(), F.col("attempt").desc()))
    return done.withColumn("__n", latest).where("__n = 1").drop("__n")


def iterative_rounds(rows: DataFrame, key: str, rounds: int, make: Callable[[DataFrame, int], DataFrame], train: Callable[[DataFrame, int], None], folder: str) -> DataFrame:
    """For each of ``rounds`` equal ranges of rows: make preference rows, append them, train on all so far."""
    spark = rows.sparkSession
    ranged = S.iteration_ranges(rows, key, rounds)
    for i in range(rounds):
        make(ranged.where(F.col("iteration") == i).drop("iteration"), i).write.mode("append" if i else "overwrite").parquet(folder)
        train(spark.read.parquet(folder), i)
    return spark.read.parquet(folder)


def sample_round(chunks: DataFrame, round_no: int, seed: int = 42) -> DataFrame:
    """Of each data set the chunk that this round draws, another one each round: (dataset, chunk, ...)."""
    order = Window.partitionBy("dataset").orderBy(F.xxhash64("chunk", F.lit(seed)), "chunk")
    return chunks.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == round_no + 1).drop("__n")


def query_prefix(ids: Column, key: Column, least: int = 2, most: int = 8) -> Column:
    """The first ids of a row, a number between the bounds that its key gives."""
    return F.slice(ids, F.lit(1), (F.pmod(F.xxhash64(key), F.lit(most - least + 1)) + least).cast("int"))


def collate(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """Rows of a batch as one row of arrays, in order."""
    others = [c for c in rows.columns if c not in (batch, order)]
    listed = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *others))).alias("r"))
    return listed.select(batch, *[F.col(f"r.{c}").alias(c) for c in others])


def uncollate(batches: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """Arrays of a batch as rows again; missing texts are ``[ERROR]``."""
    return batches.select(batch, F.posexplode(F.arrays_zip(*columns)).alias("place", "r")).select(batch, "place", *[F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("[ERROR]")).alias(c) for c in columns])


def report(words: DataFrame, found: DataFrame, value: str = "value") -> DataFrame:
    """Every word with its value, -1 where it has no context."""
    return words.join(found, "word", "left").select("word", F.coalesce(value, F.lit(-1.0)).alias(value))


def last_and_periodic(rows: DataFrame, order: str, keep: int = 10, every: int = 10) -> DataFrame:
    """The last rows and each ``every``-th step."""
    top = rows.agg(F.max(order)).first()[0]
    return rows.where((F.col(order) > F.lit((top or 0) - keep)) | (F.col(order) % every == 0))
