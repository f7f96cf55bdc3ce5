"""Training-signal mathematics as table operations over (sequence, position, ...) rows and arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from loomtext.operators.scan import running_sums


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(F.least(x, as_col(hi)), as_col(lo))


def masked_mean(x: Column, mask: Column) -> Column:
    return F.try_divide(F.sum(x * mask), F.sum(mask))


def masked_var(x: Column, mask: Column) -> Column:
    """Mean of squares less square of the mean, over masked rows."""
    return masked_mean(x * x, mask) - masked_mean(x, mask) * masked_mean(x, mask)


def sft_loss(rows: DataFrame) -> DataFrame:
    return rows.agg((-F.try_divide(F.sum(F.col("logprob") * F.col("mask")), F.sum("mask"))).alias("sft_loss"))


def simpo(rows: DataFrame, beta: float = 2.0, gamma_ratio: float = 0.5) -> DataFrame:
    """rows: (pair, winner boolean, logprob, mask) -> loss, mean rewards by beta, win rate, margin, pairs."""
    mean = lambda won: F.try_divide(F.sum(F.when(F.col("winner") == won, F.col("logprob") * F.col("mask"))), F.sum(F.when(F.col("winner") == won, F.col("mask"))))
    pairs = rows.groupBy("pair").agg((beta * mean(True)).alias("w"), (beta * mean(False)).alias("l")).where("w IS NOT NULL AND l IS NOT NULL")
    margin = F.col("w") - F.col("l")
    return pairs.agg(
        F.avg(F.log1p(F.exp(-(margin - beta * gamma_ratio)))).alias("simpo_loss"),
        (F.avg("w") / beta).alias("w_reward"),
        (F.avg("l") / beta).alias("l_reward"),
        F.avg((F.col("w") > F.col("l")).cast("double")).alias("win_rate"),
        (F.avg(margin) / beta).alias("margin"),
        F.count("*").alias("pairs"),
    )


def ppo_stats(rows: DataFrame, *by: str, cliprange: float = 0.2, cliprange_value: float = 0.2, vf_coef: float = 0.1, ratio_threshold: float = 10.0) -> DataFrame:
    """rows: logprob, old_logprob, value, vpred, advantage, ret, mask -> clipped losses, clip fractions, divergences."""
    m = F.col("mask")
    vclip = clip(F.col("vpred"), F.col("value") - cliprange_value, F.col("value") + cliprange_value)
    v1, v2 = F.pow(F.col("vpred") - F.col("ret"), 2), F.pow(vclip - F.col("ret"), 2)
    ratio = F.exp(F.col("logprob") - F.col("old_logprob"))
    bounded = clip(ratio, 1 - cliprange, 1 + cliprange)
    p1, p2 = -F.col("advantage") * ratio, -F.col("advantage") * bounded
    flag = lambda c: masked_mean(c.cast("double"), m)
    found = rows.groupBy(*by).agg(
        masked_mean(F.greatest(p1, p2), m).alias("pg"),
        (0.5 * masked_mean(F.greatest(v1, v2), m)).alias("vf"),
        masked_mean(ratio, m).alias("avg_ratio"),
        flag(p2 > p1).alias("pg_clipfrac"),
        flag(v2 > v1).alias("vf_clipfrac"),
        flag(ratio > bounded).alias("ceiling_clipfrac"),
        flag(ratio < bounded).alias("floor_clipfrac"),
        (0.5 * masked_mean(F.pow(F.col("logprob") - F.col("old_logprob"), 2), m)).alias("approxkl"),
        masked_mean(F.col("old_logprob") - F.col("logprob"), m).alias("policykl"),
        masked_mean(F.col("ret"), m).alias("return_mean"),
        masked_var(F.col("ret"), m).alias("return_var"),
        masked_mean(F.col("value"), m).alias("value_mean"),
        masked_var(F.col("value"), m).alias("value_var"),
    )
    kept = F.when(F.col("avg_ratio") > ratio_threshold, F.lit(0.0)).otherwise(F.lit(1.0))
    losses = [(F.col("pg") * kept).alias("pg_loss"), (F.col("vf") * kept).alias("vf_loss"), ((F.col("pg") + vf_coef * F.col("vf")) * kept).alias("loss")]
    return found.select(*by, *losses, *[c for c in found.columns if c not in (*by, "pg", "vf")])


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(logits, lambda x: x - top - total)


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), lambda x: F.exp(x))


def label_logprob(logits: Column, label: Column) -> Column:
    """The log probability of the label, an index from 0."""
    return F.get(log_softmax(logits), label)


def entropy(logits: Column) -> Column:
    return F.aggregate(softmax(logits), F.lit(0.0), lambda s, p: s - p * F.log(p + 1e-10))


def kl_divergence(teacher: Column, student: Column) -> Column:
    """Sum over entries of p (log p - log q), p the teacher's softmax, q the student's."""
    pairs = F.zip_with(log_softmax(teacher), log_softmax(student), lambda p, q: F.exp(p) * (p - q))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def ppo_array_loss(teacher: Column, student: Column, reward: Column, cliprange: float = 0.2) -> Column:
    """The clipped policy loss of each entry of a row's logits."""
    def one(t: Column, s: Column) -> Column:
        ratio = F.exp(s - t)
        return -F.least(ratio * reward, clip(ratio, 1 - cliprange, 1 + cliprange) * reward)

    return F.zip_with(teacher, student, one)


def teacher_reward(teacher: Column, student: Column, temperature: float = 1.0) -> Column:
    from loomtext.operators.similarity import cosine

    return F.coalesce(cosine(teacher, student), F.lit(0.0)) / temperature


def mixed_reward(teacher: Column, base: Column, weight: float = 0.5) -> Column:
    return weight * teacher + (1 - weight) * base


def gradient_scale(norms: Column, max_norm: float = 1.0, min_scale: float | None = 0.1) -> Column:
    """The factor of a loss from an array of gradient norms; 1 where there are none. Without ``min_scale`` it has no lower bound."""
    scale = F.least(F.lit(max_norm) / (F.array_max(norms) + 1e-6), F.lit(1.0))
    return F.coalesce(scale if min_scale is None else F.greatest(scale, F.lit(min_scale)), F.lit(1.0))


def layer_scale(layers: Column, weights: dict[str, float]) -> Column:
    """Product of the weights of the named layers in the array."""
    table = F.create_map(*[F.lit(x) for item in weights.items() for x in item]) if weights else F.create_map()
    return F.aggregate(layers, F.lit(1.0), lambda a, n: a * F.coalesce(F.try_element_at(table, n), F.lit(1.0)))


def lm_ppo_loss(lm: Column, ppo: Column, share: float) -> Column:
    return share * lm + (1 - share) * ppo


def shape_reward(reward: Column, baseline: Column, kind: str = "sub", scaling: float = 1.0, binary: bool = False) -> Column:
    """reward less or by the baseline, scaled; the binary form is -1 where the difference is negative, else the raw reward."""
    if binary:
        return F.when((reward - baseline) * scaling < 0, F.lit(-1.0)).otherwise(reward)
    return {"sub": reward - baseline, "div": F.try_divide(reward, baseline), "none": reward}[kind] * scaling


def perplexity(rows: DataFrame, *by: str) -> DataFrame:
    """exp of the mean loss over masked positions."""
    return rows.groupBy(*by).agg(F.exp(-F.try_divide(F.sum(F.col("logprob") * F.col("mask")), F.sum("mask"))).alias("perplexity"))


def surprisal(rows: DataFrame, *by: str) -> DataFrame:
    """Mean -log2(p + 1e-6) at target positions."""
    return rows.where("target = 1").groupBy(*by).agg(F.avg(-F.log2(F.col("p") + 1e-6)).alias("surprisal"))


def word_perplexity(rows: DataFrame) -> DataFrame:
    """(word, context, p) -> per word the mean over contexts of 2 ** mean(-log2 p)."""
    contexts = rows.groupBy("word", "context").agg(F.pow(F.lit(2.0), F.avg(-F.log2("p"))).alias("ppl"))
    return contexts.groupBy("word").agg(F.avg("ppl").alias("perplexity"), F.count("*").alias("contexts"))


def minimal_pairs(scored: DataFrame) -> DataFrame:
    """(task, id, good boolean, logprob by token) -> accuracy by task and their mean, under the task ``mean``."""
    totals = scored.groupBy("task", "id").agg(F.sum(F.when(F.col("good"), F.col("logprob"))).alias("g"), F.sum(F.when(~F.col("good"), F.col("logprob"))).alias("b"))
    tasks = totals.groupBy("task").agg(F.avg((F.col("g") > F.col("b")).cast("double")).alias("accuracy"))
    return tasks.unionByName(tasks.agg(F.lit("mean").alias("task"), F.avg("accuracy").alias("accuracy")))


def classification(rows: DataFrame) -> DataFrame:
    """(label, predicted) -> accuracy and support-weighted F1."""
    cells = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    by_label = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    by_guess = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), (F.col("support") + F.coalesce("guessed", F.lit(0))).cast("double")), F.lit(0.0))
    return by_label.join(by_guess, "label", "left").agg((F.sum("hits") / F.sum("support")).alias("accuracy"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def running_normalised(rows: DataFrame, value: str, group: str, order: str, bound: float = 3.0) -> DataFrame:
    """Adds ``normalised``: value by mean and deviation of all values up to it in its group, then clipped. Sums run over groups
    of any size (``scan.py``); a null value counts nothing and stays null."""
    x = F.col(value).cast("double")
    summed = running_sums(rows, group, order, {"__n": F.when(x.isNotNull(), 1).otherwise(0), "__s": x, "__q": x * x})
    n = F.col("__n")
    mean = F.try_divide(F.col("__s"), n)
    deviation = F.sqrt(F.greatest(F.try_divide(F.col("__q"), n) - mean * mean, F.lit(0.0)))
    scaled = F.when(deviation < 1e-9, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - mean, deviation))
    return summed.withColumn("normalised", F.when(F.col(value).isNotNull(), clip(F.coalesce(scaled, F.lit(0.0)), -bound, bound))).drop("__n", "__s", "__q")


def token_usage(rows: DataFrame, size: Column, group: str, order: str, period: int = 100_000) -> DataFrame:
    """Adds ``place``: the sum of sizes up to a row in its group, modulo the period."""
    return running_sums(rows, group, order, {"__used": size}).withColumn("place", F.pmod(F.col("__used").cast("long"), F.lit(period))).drop("__used")


def pad_ids(ids: Column, size: int, pad: int = 0, left: bool = False) -> Column:
    """Exactly ``size`` ids: cut at the end, filled on one side."""
    cut = F.slice(ids, 1, size)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.lit(size) - F.size(cut))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def attention_mask(ids: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i <= F.least(F.size(ids), F.lit(size))).cast("long"))


def eos_wrap(context: Column, response: Column, eos: int) -> Column:
    return F.concat(F.array(F.lit(eos).cast("long")), context, response, F.array(F.lit(eos).cast("long")))


def response_mask(context: Column, response: Column) -> Column:
    """1 at the shifted targets that belong to the response or close it."""
    n = F.size(context) + F.size(response) + 1
    return F.transform(F.sequence(F.lit(1), n), lambda i: (i > F.size(context)).cast("long"))


def find_ids(ids: Column, part: Column) -> Column:
    """The first place of an id sequence in another, from 0; -1 where there is none."""
    last = F.size(ids) - F.size(part)
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(ids, i + 1, F.size(part)) == part)
    return F.when(last < 0, F.lit(-1)).otherwise(F.coalesce(F.get(places, F.lit(0)), F.lit(-1)))


def until_pad(ids: Column, pad: int) -> Column:
    at = F.array_position(ids, pad)
    return F.when(at > 0, F.slice(ids, F.lit(1), at.cast("int") - 1)).otherwise(ids)


def banned_renormalised(probabilities: DataFrame, banned: DataFrame, eos: int, by: str = "seq") -> DataFrame:
    """(by, token, p) without banned tokens and scaled to 1; all of it to the end token where nothing is left."""
    kept = probabilities.join(banned, "token", "left_anti")
    scaled = kept.withColumn("t", F.sum("p").over(Window.partitionBy(by))).where("t > 0").select(by, "token", (F.col("p") / F.col("t")).alias("p"))
    empty = probabilities.select(by).distinct().join(scaled.select(by).distinct(), by, "left_anti").select(by, F.lit(eos).cast("long").alias("token"), F.lit(1.0).alias("p"))
    return scaled.unionByName(empty)


def finite_or_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def kl_regularised_loss(teacher: Column, student: Column, reward: Column, coefficient: float = 0.1) -> Column:
    """Mean over entries of the clipped loss plus the weighted divergence of a row."""
    losses = ppo_array_loss(teacher, student, reward)
    return F.aggregate(losses, F.lit(0.0), lambda a, x: a + x) / F.size(losses) + coefficient * kl_divergence(teacher, student)


def entropy_regularised_loss(teacher: Column, student: Column, reward: Column, coefficient: float = 0.01) -> Column:
    losses = ppo_array_loss(teacher, student, reward)
    return F.aggregate(losses, F.lit(0.0), lambda a, x: a + x) / F.size(losses) - coefficient * entropy(student)


def with_length_bonus(reward: Column, length: Column, weight: float, bound: float = 1.0) -> Column:
    """A reward with a share of the response's length added, clipped."""
    return clip(reward + weight * length, -bound, bound)


def mean_squared_error(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col("label") - F.col("predicted"), 2)).alias("mse"))


def cross_entropy(rows: DataFrame, *by: str) -> DataFrame:
    """(logits array, label from 0) -> mean negative log probability and accuracy of the largest entry."""
    guess = F.array_position("logits", F.array_max("logits")) - 1
    return rows.groupBy(*by).agg((-F.avg(label_logprob(F.col("logits"), F.col("label")))).alias("cross_entropy"), F.avg((guess == F.col("label")).cast("double")).alias("accuracy"))


def weighted_epoch_mean(steps: DataFrame, loss: str, weight: str, *by: str) -> DataFrame:
    """Mean of step losses by their weights, tokens or pairs."""
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.col(loss) * F.col(weight)), F.sum(weight).cast("double")).alias(f"mean_{loss}"))


def reward_stats(rewards: Column) -> Column:
    """Mean, population deviation, least and largest of an array of rewards."""
    n = F.size(rewards)
    mean = F.try_divide(F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x), n)
    square = F.try_divide(F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x * x), n)
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.array_min(rewards).alias("min"), F.array_max(rewards).alias("max"))


#: Metrics by name, each an expression over a row's arrays.
METRICS = {"kl": kl_divergence, "entropy": lambda teacher, student: entropy(student), "reward_stats": lambda teacher, student: reward_stats(student)}


def metric(name: str, teacher: Column, student: Column) -> Column:
    if name not in METRICS:
        raise ValueError(f"metrics are {', '.join(METRICS)}")
    return METRICS[name](teacher, student)


def tokenised(rows: DataFrame, text: str, tokenizer: Callable[[pd.Series], pd.Series], size: int, pad: int = 0, label: str | None = None) -> DataFrame:
    """Adds input_ids and attention_mask of exactly ``size`` entries, and a label as a number: a tokenizer, any function from texts to
    lists of ids, sees Arrow batches; cutting and padding stay expressions."""
    schema = StructType([*rows.schema.fields, StructField("__ids", ArrayType(LongType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(__ids=tokenizer(batch[text].fillna("")))

    made = rows.mapInPandas(run, schema)
    ids = F.col("__ids")
    out = made.withColumn("input_ids", pad_ids(ids, size, pad)).withColumn("attention_mask", attention_mask(ids, size))
    return (out.withColumn("labels", F.col(label).cast("float")) if label else out).drop("__ids")

