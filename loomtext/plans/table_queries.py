"""Registered queries over conversations, events, labels and benchmark rows, each with DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import schedule as C
from loomtext.functions import text as T
from loomtext.operators import dialogue as D
from loomtext.operators import prefs as P
from loomtext.operators import select as S
from loomtext.operators import signal as G
from loomtext.operators.similarity import cosine
from loomtext.plans import pipelines as R
from loomtext.plans.registry import query, rounded
from loomtext.streaming.running import windowed_rewards as windowed


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- dialogues --------------------------------------------------------------------------------------------------

UTTERANCES = r"""utt AS (SELECT conv_id, role AS speaker, trim(s) AS text, turn * 1000000 + i AS k FROM (SELECT conv_id, turn, role, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '[^.!?]+[.!?]*') AS ss FROM conversations)))"""


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("i", "s"))
    return each.select("conv_id", F.col("role").alias("speaker"), F.trim("s").alias("text"), (F.col("turn") * 1_000_000 + F.col("i")).alias("k"))


@query(f"""WITH {UTTERANCES}, c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM utt WINDOW w AS (PARTITION BY conv_id ORDER BY k)), t AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY k) AS turn FROM c)
SELECT conv_id, turn::BIGINT AS turn, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY k) AS text FROM t GROUP BY conv_id, turn""")
def turn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge_turns(_utterances(spark, sf_dir), "conv_id", "k")


CHUNKS = f"""WITH RECURSIVE {UTTERANCES}, u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS r FROM utt),
f(conv_id, r, d, n, last, cur, closed) AS (
  SELECT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, []::STRUCT(speaker VARCHAR, text VARCHAR)[], []::STRUCT(speaker VARCHAR, text VARCHAR)[] FROM (SELECT DISTINCT conv_id FROM u)
  UNION ALL
  SELECT u.conv_id, u.r, CASE WHEN f.n + g = 5 THEN f.d + 1 ELSE f.d END, CASE WHEN f.n + g = 5 THEN 0 ELSE f.n + g END, u.speaker,
    CASE WHEN f.n + g = 5 THEN [] WHEN g = 1 THEN list_append(f.cur, {{'speaker': u.speaker, 'text': u.text}}) ELSE list_append(f.cur[1:-2], {{'speaker': u.speaker, 'text': f.cur[-1].text || ' ' || u.text}}) END,
    CASE WHEN f.n + g = 5 THEN list_append(f.cur, {{'speaker': u.speaker, 'text': u.text}}) ELSE [] END
  FROM f JOIN (SELECT * FROM u) AS u ON u.conv_id = f.conv_id AND u.r = f.r + 1, LATERAL (SELECT CASE WHEN f.n > 0 AND f.last = u.speaker THEN 0 ELSE 1 END AS g) AS x),
chunks AS (SELECT conv_id, d - 1 AS dialogue, closed AS turns FROM f WHERE len(closed) = 5)"""


@query(CHUNKS + " SELECT conv_id, dialogue, " + ", ".join(f"turns[{i}].speaker || ': ' || turns[{i}].text AS turn_{i}" for i in range(1, 6)) + " FROM chunks")
def chunk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.wide_turns(D.chunk_dialogues(_utterances(spark, sf_dir), "conv_id", "k"))


@query(CHUNKS + " SELECT conv_id, dialogue, coalesce(array_to_string(list_transform(list_filter(turns, lambda t: t.speaker = 'user'), lambda t: t.text), ' '), '') AS user_text, coalesce(array_to_string(list_transform(list_filter(turns, lambda t: t.speaker = 'assistant'), lambda t: t.text), ' '), '') AS assistant_text FROM chunks")
def speaker_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.chunk_dialogues(_utterances(spark, sf_dir), "conv_id", "k")
    return d.select("conv_id", "dialogue", D.speaker_view(F.col("turns"), "user").alias("user_text"), D.speaker_view(F.col("turns"), "assistant").alias("assistant_text"))


@query(f"""SELECT conv_id, string_agg(m || trim(t, ' ' || chr(10)), ' ' ORDER BY turn) AS text FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'A::' ELSE 'B::' END AS m, lower(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id""")
def first_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("role") == "user", "A:: ").otherwise("B:: "), F.lower("text"), F.lit("\n")).alias("t")))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda x: x["t"]), "")
    return marked.select("conv_id", T.first_rounds(text, 2, version=2).alias("text"))


@query("""SELECT conv_id, string_agg(trim(m || ' ' || trim(t, ' ' || chr(10)), ' '), chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'A::' ELSE 'B::' END AS m, lower(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id""")
def first_rounds_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("role") == "user", "A:: ").otherwise("B:: "), F.lower("text"), F.lit("\n")).alias("t")))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda x: x["t"]), "")
    return marked.select("conv_id", T.first_rounds(text, 2, version=1).alias("text"))


@query("""SELECT c.conv_id, u.text AS first_user, a.text AS first_assistant FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) AS u USING (conv_id) LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id) AS a USING (conv_id)""")
def left_join_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    first = lambda role, name: c.where(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias(name))
    return c.select("conv_id").distinct().join(first("user", "first_user"), "conv_id", "left").join(first("assistant", "first_assistant"), "conv_id", "left")


@query("SELECT conv_id, turn, trim(text) AS answer FROM conversations")
def response_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, F.concat(F.lit("x <|start_header_id|>assistant<|end_header_id|> "), "text", F.lit(" <|eot_id|>"))).when(kind == 1, F.concat(F.lit("[INST] q [/INST] "), "text")).when(kind == 2, F.concat(F.lit("prompt. "), "text")).otherwise(F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.response_content(raw, F.lit("prompt. ")).alias("answer"))


# --- preferences ------------------------------------------------------------------------------------------------

PAIRS = r"""pairs AS (SELECT p.conv_id, p.turn, p.text AS prompt, c.text AS chosen, r.text AS rejected, length(c.text)::DOUBLE / 100 AS score_chosen, length(r.text)::DOUBLE / 100 AS score_rejected, len(regexp_extract_all(c.text, '\S+'))::BIGINT AS token_count, length(c.text) > length(r.text) AS valid
FROM conversations AS p JOIN conversations AS c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1 AND c.role = 'assistant' JOIN conversations AS r ON r.conv_id = p.conv_id + 1 AND r.turn = p.turn + 1 AND r.role = 'assistant' WHERE p.role = 'user')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = c.where("role = 'assistant'")
    chosen = answers.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    rejected = answers.select((F.col("conv_id") - 1).alias("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("rejected"))
    rows = asked.join(chosen, ["conv_id", "turn"]).join(rejected, ["conv_id", "turn"])
    return P.preference_rows(rows.withColumn("score_chosen", F.length("chosen") / 100.0).withColumn("score_rejected", F.length("rejected") / 100.0))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"""WITH {PAIRS} SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE valid))::BIGINT AS valid, (count(*) FILTER (WHERE NOT valid))::BIGINT AS invalid, round(avg(score_chosen), 6) AS score_chosen_mean, round(stddev_samp(score_chosen), 6) AS score_chosen_std, round(avg(score_rejected), 6) AS score_rejected_mean, round(stddev_samp(score_rejected), 6) AS score_rejected_std, round(avg(token_count), 6) AS token_count_mean, min(token_count) AS token_count_min, max(token_count) AS token_count_max FROM pairs""")
def preference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.summary(_pairs(spark, sf_dir)))


@query(f"""WITH {PAIRS} SELECT turn, round(avg(valid::INT), 6) AS valid_rate, count(*)::BIGINT AS rows FROM pairs GROUP BY ROLLUP (turn)""")
def valid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.valid_rates(_pairs(spark, sf_dir), "turn"))


@query(f"""WITH {PAIRS} SELECT conv_id, turn FROM pairs WHERE conv_id IN (SELECT conv_id FROM pairs GROUP BY conv_id HAVING avg(valid::INT) >= 0.7 OR max(conv_id % 3) >= 2)""")
def accepted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.accepted_batches(_pairs(spark, sf_dir), "conv_id", 0.7, F.col("conv_id") % 3, 2).select("conv_id", "turn")


@query(rf"""WITH {PAIRS} SELECT conv_id, turn, (length(trim(chosen)) < 10 OR len(regexp_extract_all(chosen, '\S+')) < 5 OR contains(chosen, array_to_string(list_slice(regexp_extract_all(prompt, '\S+'), -50, -1), ' '))) AS repetitive FROM pairs""")
def repetitive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", P.repetitive_native(F.col("prompt"), F.col("chosen")).alias("repetitive"))


@query(None)
def repetitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", P.repetitive(F.col("prompt"), F.col("chosen")).alias("repetitive"))


# --- scores -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) + (user_id - (SELECT avg(user_id) FROM events)) / (SELECT stddev_pop(user_id) FROM events)) / 2, 6) AS aggregate FROM events")
def z_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.z_mean(_read(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id")), ["value", "user_id"]).select("event_id", "aggregate"))


@query("SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 1 / (1 + exp(-value / 100)) ELSE 1 / (1 + exp(-(value / 100 + user_id / 1000.0) / 2)) END, 6) AS composite, round(CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE value / 100 END - user_id / 1000.0, 6) AS reward FROM events")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("value") / 100, F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("user_id") / 1000.0)
    child = F.when(F.col("event_id") % 5 != 0, F.col("value") / 100)
    return rounded(_read(spark, sf_dir, "events").select("event_id", P.composite({"a": a, "b": b}).alias("composite"), P.reward(child, F.col("user_id") / 1000.0).alias("reward")))


@query("SELECT event_id, round((value - log2(event_id + 2)) * 2, 6) AS sub, round(value / log2(event_id + 2), 6) AS div, round(value, 6) AS plain, round(CASE WHEN value - log2(event_id + 2) < 0 THEN -1 ELSE value END, 6) AS bin, round(least(greatest(value, 10), 50), 6) AS clipped FROM events")
def reward_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, base = F.col("value"), F.log2(F.col("event_id") + 2)
    shape = G.shape_reward
    return rounded(_read(spark, sf_dir, "events").select("event_id", shape(r, base, "sub", 2.0).alias("sub"), shape(r, base, "div").alias("div"), shape(r, base, "none").alias("plain"), shape(r, base, binary=True).alias("bin"), G.clip(r, 10, 50).alias("clipped")))


@query("""SELECT event_id, round(CASE WHEN s IS NULL OR s < 1e-9 THEN 0 ELSE least(greatest((value - m) / s, -3), 3) END, 4) AS normalised FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))""")
def running_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.running_normalised(_read(spark, sf_dir, "events"), "value", "user_id", "event_id").select("event_id", "normalised"), 4)


# --- training signals: rows derived from events -----------------------------------------------------------------

SIGNALS = "sig AS (SELECT user_id, event_id, -(1 + value / 50) AS logprob, -(1 + value / 50) + ((event_id % 11) - 5) / 10.0 AS old_logprob, value / 10 AS value_, value / 10 + ((event_id % 7) - 3) / 5.0 AS vpred, ((event_id % 13) - 6) / 3.0 AS advantage, value / 12 AS ret, (event_id % 4 > 0)::INT AS mask, event_id % 2 = 0 AS winner FROM events)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = -(1 + F.col("value") / 50)
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select("user_id", "event_id", lp.alias("logprob"), (lp + (e % 11 - 5) / 10.0).alias("old_logprob"), (F.col("value") / 10).alias("value"), (F.col("value") / 10 + (e % 7 - 3) / 5.0).alias("vpred"), ((e % 13 - 6) / 3.0).alias("advantage"), (F.col("value") / 12).alias("ret"), (e % 4 > 0).cast("int").alias("mask"), (e % 2 == 0).alias("winner"))


def _mm(x: str) -> str:
    return f"(sum(({x}) * mask) / nullif(sum(mask), 0))"


_RATIO, _CLIP, _VCLIP = "exp(logprob - old_logprob)", "greatest(least(exp(logprob - old_logprob), 1.2), 0.8)", "greatest(least(vpred, value_ + 0.2), value_ - 0.2)"


@query(f"""WITH {SIGNALS}, s AS (SELECT user_id, {_mm(f'greatest(-advantage * {_RATIO}, -advantage * {_CLIP})')} AS pg, 0.5 * {_mm(f'greatest((vpred - ret) ** 2, ({_VCLIP} - ret) ** 2)')} AS vf, {_mm(_RATIO)} AS avg_ratio, {_mm(f'(-advantage * {_CLIP} > -advantage * {_RATIO})::INT')} AS pg_clipfrac, {_mm(f'(({_VCLIP} - ret) ** 2 > (vpred - ret) ** 2)::INT')} AS vf_clipfrac, {_mm(f'({_RATIO} > {_CLIP})::INT')} AS ceiling_clipfrac, {_mm(f'({_RATIO} < {_CLIP})::INT')} AS floor_clipfrac, 0.5 * {_mm('(logprob - old_logprob) ** 2')} AS approxkl, {_mm('old_logprob - logprob')} AS policykl, {_mm('ret')} AS return_mean, {_mm('ret * ret')} - {_mm('ret')} * {_mm('ret')} AS return_var, {_mm('value_')} AS value_mean, {_mm('value_ * value_')} - {_mm('value_')} * {_mm('value_')} AS value_var FROM sig GROUP BY user_id)
SELECT user_id, round(CASE WHEN avg_ratio > 1.02 THEN 0 ELSE pg END, 3) AS pg_loss, round(CASE WHEN avg_ratio > 1.02 THEN 0 ELSE vf END, 3) AS vf_loss, round(CASE WHEN avg_ratio > 1.02 THEN 0 ELSE pg + 0.1 * vf END, 3) AS loss, round(avg_ratio, 3) AS avg_ratio, round(pg_clipfrac, 3) AS pg_clipfrac, round(vf_clipfrac, 3) AS vf_clipfrac, round(ceiling_clipfrac, 3) AS ceiling_clipfrac, round(floor_clipfrac, 3) AS floor_clipfrac, round(approxkl, 3) AS approxkl, round(policykl, 3) AS policykl, round(return_mean, 3) AS return_mean, round(return_var, 3) AS return_var, round(value_mean, 3) AS value_mean, round(value_var, 3) AS value_var FROM s""")
def ppo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.ppo_stats(_signals(spark, sf_dir), "user_id", ratio_threshold=1.02), 3)


@query(f"WITH {SIGNALS} SELECT round(-sum(logprob * mask) / sum(mask), 6) AS sft_loss FROM sig")
def sft_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.sft_loss(_signals(spark, sf_dir)))


@query(f"""WITH {SIGNALS}, p AS (SELECT user_id, 2 * sum(logprob * mask) FILTER (WHERE winner) / sum(mask) FILTER (WHERE winner) AS w, 2 * sum(logprob * mask) FILTER (WHERE NOT winner) / sum(mask) FILTER (WHERE NOT winner) AS l FROM sig GROUP BY user_id)
SELECT round(avg(ln(1 + exp(-(w - l - 1)))), 6) AS simpo_loss, round(avg(w) / 2, 6) AS w_reward, round(avg(l) / 2, 6) AS l_reward, round(avg((w > l)::INT), 6) AS win_rate, round(avg(w - l) / 2, 6) AS margin, count(*)::BIGINT AS pairs FROM p WHERE w IS NOT NULL AND l IS NOT NULL""")
def simpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.simpo(_signals(spark, sf_dir).withColumnRenamed("user_id", "pair")))


@query(f"WITH {SIGNALS} SELECT user_id, round(exp(-sum(logprob * mask) / nullif(sum(mask), 0)), 4) AS perplexity FROM sig GROUP BY user_id")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.perplexity(_signals(spark, sf_dir), "user_id"), 4)


@query("SELECT event_type, round(avg(-log2(p + 1e-6)), 6) AS surprisal FROM (SELECT event_type, exp(-value / 50) AS p FROM events WHERE event_id % 3 = 0) GROUP BY event_type")
def surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_type", F.exp(-F.col("value") / 50).alias("p"), (F.col("event_id") % 3 == 0).cast("int").alias("target"))
    return rounded(G.surprisal(rows, "event_type"))


@query("SELECT word, round(avg(ppl), 4) AS perplexity, count(*)::BIGINT AS contexts FROM (SELECT event_type AS word, user_id, 2 ** avg(value / 50 / ln(2)) AS ppl FROM events GROUP BY event_type, user_id) GROUP BY word")
def word_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("word"), F.col("user_id").alias("context"), F.exp(-F.col("value") / 50).alias("p"))
    return rounded(G.word_perplexity(rows), 4)


@query(f"""WITH {SIGNALS}, p AS (SELECT (user_id % 5)::VARCHAR AS task, user_id, sum(logprob) FILTER (WHERE winner) AS g, sum(logprob) FILTER (WHERE NOT winner) AS b FROM sig GROUP BY user_id), t AS (SELECT task, avg((g > b)::INT) AS accuracy FROM p GROUP BY task)
SELECT task, round(accuracy, 6) AS accuracy FROM t UNION ALL SELECT 'mean', round(avg(accuracy), 6) FROM t""")
def minimal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).select((F.col("user_id") % 5).cast("string").alias("task"), F.col("user_id").alias("id"), F.col("winner").alias("good"), "logprob")
    return rounded(G.minimal_pairs(rows))


@query("""WITH x AS (SELECT toxic AS label, quality AS predicted FROM labels), l AS (SELECT label, count(*) AS support, sum((label = predicted)::INT) AS hits FROM x GROUP BY label), g AS (SELECT predicted AS label, count(*) AS guessed FROM x GROUP BY predicted)
SELECT round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(2.0 * hits / (support + coalesce(guessed, 0)) * support) / sum(support), 6) AS weighted_f1 FROM l LEFT JOIN g USING (label)""")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.classification(_read(spark, sf_dir, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("predicted"))))


@query("SELECT doc_id, round(log2(quality + 2), 6) AS log_label, round(log10(doc_id + 1), 6) AS log_id FROM labels")
def label_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_read(spark, sf_dir, "labels").select("doc_id", F.log2(F.col("quality") + 2).alias("log_label"), F.log10(F.col("doc_id") + 1).alias("log_id")))


EXP = "list_sum(list_transform({x}, lambda v: exp(v::DOUBLE)))"


@query(f"""SELECT a.vec_id, round(ln({EXP.format(x='a.embedding')}) * -1 + a.embedding[3], 4) AS logprob, round(list_sum(list_transform(range(1, 65), lambda i: exp(a.embedding[i]::DOUBLE) / {EXP.format(x='a.embedding')} * ((a.embedding[i]::DOUBLE - ln({EXP.format(x='a.embedding')})) - (b.embedding[i]::DOUBLE - ln({EXP.format(x='b.embedding')}))))), 4) AS kl, round(-list_sum(list_transform(a.embedding, lambda v: exp(v::DOUBLE) / {EXP.format(x='a.embedding')} * ln(exp(v::DOUBLE) / {EXP.format(x='a.embedding')} + 1e-10))), 4) AS entropy, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine
FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1""")
def distribution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("t"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("s")), "vec_id")
    t, s = F.col("t"), F.col("s")
    return rounded(pairs.select("vec_id", G.label_logprob(t, F.lit(2)).alias("logprob"), G.kl_divergence(t, s).alias("kl"), G.entropy(t).alias("entropy"), cosine(t, s).alias("cosine")), 4)


# --- schedules --------------------------------------------------------------------------------------------------

STEPS = "(SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS step FROM orders)"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(_read(spark, sf_dir, "orders").count()).withColumnRenamed("id", "step")


@query(f"SELECT step FROM {STEPS} WHERE step % CASE WHEN step < 20 THEN 2 WHEN step < 100 THEN 5 WHEN step < 500 THEN 10 WHEN step < 1000 THEN 50 WHEN step < 10000 THEN 500 ELSE 10000 END = 0")
def checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).where(C.save_condition(F.col("step")))


@query(f"""SELECT step, CASE WHEN step % 7 < 3 THEN 'CLM' ELSE 'PPO' END AS policy, CASE WHEN step % 7 < 4 THEN 'both' ELSE 'CLM' END AS overlay, CASE WHEN step // 100 < 3 OR step % 100 < greatest(100 - 10 * ((step // 100 - 3) // 2 + 1), 0) THEN 'CLM' ELSE 'PPO' END AS anneal FROM {STEPS}""")
def update_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("step")
    return _steps(spark, sf_dir).select("step", C.update_policy(s, 4, 3, True, None).alias("policy"), C.update_policy(s, 4, 3, False, "CLM").alias("overlay"), C.anneal_policy(s, 100, 10, 3, 2).alias("anneal"))


@query(f"""SELECT step, round(0.5 * (cos(2 * pi() / 100 * step) + 1), 6) AS wave, round((1 + cos(pi() * (step % 100) / 100)) / 2, 6) AS half, round(CASE WHEN step < 500 THEN step / 500.0::DOUBLE ELSE greatest(0, 1 - (step - 500) / 9500.0::DOUBLE) END, 6) AS warmup, round(0.001::DOUBLE + 0.0001::DOUBLE * least(step, {math.ceil((0.05 / 0.32 - 0.001) / 0.0001)}), 6) AS adaptive, (step // 8 * 3)::BIGINT AS steps, greatest(1, step // 10)::BIGINT AS every, (step * 1000 // 1000000)::VARCHAR || 'M' AS milestone FROM {STEPS}""")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("step")
    return rounded(_steps(spark, sf_dir).select("step", C.cosine_wave(s, 1.0, 100).alias("wave"), C.cosine_half(s, 1.0, 100).alias("half"), C.warmup_linear(s, 1.0, 500, 10_000).alias("warmup"), C.adaptive_lr(s, 0.001, 0.05, step=0.0001).alias("adaptive"), C.training_steps(s, 8, 3).cast("long").alias("steps"), C.checkpoint_interval(s).cast("long").alias("every"), C.word_milestone(s * 1000).alias("milestone")))


@query("SELECT user_id, event_id, running % 100000 AS place FROM (SELECT user_id, event_id, (sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM events)")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.token_usage(_read(spark, sf_dir, "events"), F.length("event_type"), "user_id", "event_id").select("user_id", "event_id", "place")


# --- sequences --------------------------------------------------------------------------------------------------

IDS = r"(SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)::BIGINT) AS ids FROM conversations)"


@query(f"""SELECT conv_id, turn, array_to_string(list_concat(ids[1:20], list_transform(range(0, greatest(20 - len(ids), 0)), lambda i: 0::BIGINT)), ',') AS padded, least(len(ids), 20)::BIGINT AS masked, coalesce((SELECT min(i) FROM range(0, len(ids) - 1) AS r(i) WHERE ids[i + 1] = 3 AND ids[i + 2] = 4), -1)::BIGINT AS found FROM {IDS}""")
def padded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(T.words(F.col("text")), lambda w: F.length(w).cast("long")).alias("ids"))
    ids = F.col("ids")
    pair = F.array(F.lit(3).cast("long"), F.lit(4).cast("long"))
    return c.select("conv_id", "turn", F.array_join(G.pad_ids(ids, 20).cast("array<string>"), ",").alias("padded"), F.aggregate(G.attention_mask(ids, 20), F.lit(0).cast("long"), lambda a, x: a + x).alias("masked"), G.find_ids(ids, pair).cast("long").alias("found"))


@query("""SELECT user_id AS seq, k AS token, round(p / t, 6) AS p FROM (SELECT user_id, k, p, sum(p) OVER (PARTITION BY user_id) AS t FROM (SELECT user_id, event_id % 10 AS k, sum(value) AS p FROM events GROUP BY ALL) WHERE k NOT IN (2, 3, 5)) WHERE t > 0
UNION ALL SELECT user_id, 99, 1.0 FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 10 NOT IN (2, 3, 5) GROUP BY user_id HAVING sum(value) > 0)""")
def banned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq"), (F.col("event_id") % 10).alias("token")).agg(F.sum("value").alias("p"))
    banned = spark.createDataFrame([(2,), (3,), (5,)], "token long")
    return rounded(G.banned_renormalised(p, banned, 99))


@query("SELECT width_bucket_ AS bucket, count(*)::BIGINT AS n FROM (SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::BIGINT AS width_bucket_ FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) GROUP BY width_bucket_")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    width = (b["hi"] - b["lo"]) / 30
    return e.select(F.least(F.floor((F.col("value") - b["lo"]) / width), F.lit(29)).cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def packed_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_type, round(avg(value), 6) AS reward_mean, round(median(value), 6) AS reward_median, round(stddev_samp(value), 6) AS reward_std, round(min(value), 6) AS reward_min, round(max(value), 6) AS reward_max FROM events GROUP BY event_type")
def reward_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "value"
    return rounded(_read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(v).alias("reward_mean"), F.median(v).alias("reward_median"), F.stddev_samp(v).alias("reward_std"), F.min(v).alias("reward_min"), F.max(v).alias("reward_max")))


# --- sets -------------------------------------------------------------------------------------------------------


@query("SELECT item_id AS id, text, 'benchmark' AS source FROM benchmark UNION ALL SELECT conv_id, text, 'conversations' FROM conversations")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "conversations")
    return b.select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("source")).unionByName(c.select(F.col("conv_id").alias("id"), "text", F.lit("conversations").alias("source")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id").exceptAll(_read(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").orderBy(F.col("n_chars").desc(), "doc_id").select("doc_id", "n_chars").limit(50)


@query(None)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_sample(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 100)


# --- composed ---------------------------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "turn", "role").alias("x"))
    return R.collate(rows, "conv_id", "turn").select("conv_id", F.array_join("x", ",").alias("turns"), F.size("x").cast("long").alias("n"))


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS mean_value FROM events GROUP BY event_type")
def weighted_epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.weighted_epoch_mean(_read(spark, sf_dir, "events"), "value", "user_id", "event_type"))


@query("SELECT event_type, round(avg((value / 100 - user_id / 1000.0::DOUBLE) ** 2), 6) AS mse FROM events GROUP BY event_type")
def squared_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("label"), (F.col("user_id") / 1000.0).alias("predicted"))
    return rounded(G.mean_squared_error(rows, "event_type"))


@query(f"SELECT label, round(-avg(embedding[label + 1] - ln({EXP.format(x='embedding')})), 4) AS cross_entropy, round(avg((list_position(embedding, list_max(embedding)) - 1 = label)::INT), 4) AS accuracy FROM embeddings GROUP BY label")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.cross_entropy(_read(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("logits"), "label"), "label"), 4)


@query("SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) - 10 FROM events) OR event_id % 100 = 0")
def last_and_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_and_periodic(_read(spark, sf_dir, "events").select("event_id"), "event_id", 10, 100)


@query("SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, round(avg(value), 6) AS mean, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def windowed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate run over the whole table."""
    return rounded(windowed(_read(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


@query("SELECT event_id, round(0.5 * value / 100 + 0.5 * user_id / 1000.0::DOUBLE, 6) AS mixed, round(0.3 * value + 0.7 * user_id, 6) AS lm_ppo, round(least(greatest(value / 100 + 0.01 * length(event_type), -1), 1), 6) AS bonus FROM events")
def mixed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")
    return rounded(_read(spark, sf_dir, "events").select("event_id", G.mixed_reward(v / 100, u / 1000.0).alias("mixed"), G.lm_ppo_loss(v, u, 0.3).alias("lm_ppo"), G.with_length_bonus(v / 100, F.length("event_type"), 0.01).alias("bonus")))


@query("SELECT vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / 2, 4) AS reward, round(least(1.0::DOUBLE / (list_max(a.embedding)::DOUBLE * 20 + 1e-6), 1), 4) AS scale FROM embeddings AS a JOIN (SELECT vec_id - 1 AS vec_id, embedding FROM embeddings) AS b USING (vec_id)")
def teacher_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("t"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("s")), "vec_id")
    return rounded(pairs.select("vec_id", G.teacher_reward(F.col("t"), F.col("s"), 2.0).alias("reward"), G.gradient_scale(F.transform("t", lambda x: x * 20), min_scale=None).alias("scale")), 4)


@query("SELECT conv_id, turn, text AS made FROM conversations")
def generated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Prompt: p Generated Text:"), "text", F.lit("Generated Text:more"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.generated_text(raw).alias("made"))
