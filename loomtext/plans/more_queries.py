"""Registered queries of sources and sinks, prompts, sequences and selections, each with DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import schedule as C
from loomtext.functions import text as T
from loomtext.functions.word_sets import SETS, masked_ids
from loomtext.operators import annotate as A
from loomtext.operators import dialogue as D
from loomtext.operators import indices as I
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as M
from loomtext.operators import prefs as P
from loomtext.operators import select as S
from loomtext.operators import signal as G
from loomtext.plans import pipelines as R
from loomtext.plans import text_queries as X
from loomtext.plans.registry import query, rounded
from loomtext.plans.table_queries import _read
from loomtext.shared import fresh_dir
from loomtext.sources import io

# --- sources and sinks ------------------------------------------------------------------------------------------


@query("SELECT doc_id || '.txt' AS filename, count(*)::BIGINT AS n_lines, sum(length(v))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents) WHERE trim(v) <> '' AND v NOT LIKE '----%' GROUP BY doc_id")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a document, read back as lines."""
    folder = fresh_dir(spark, "lines")
    io.write_files(X.texts(spark, sf_dir).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), "name", "text", folder)
    return io.read_lines(spark, folder).groupBy(F.col("file").alias("filename")).agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query("SELECT format('dialog_{:05d}.txt', row_number() OVER (ORDER BY conv_id, turn)) AS filename, text FROM conversations WHERE text <> ''")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a row, numbered in order, and a folder of files as rows."""
    folder = fresh_dir(spark, "files")
    rows = _read(spark, sf_dir, "conversations").where("text <> ''")
    io.write_files(io.numbered_names(rows, F.col("conv_id"), F.col("turn")), "filename", "text", folder)
    return io.read_folder(spark, folder)


@query("SELECT id, src, sys FROM (SELECT conv_id AS id, max(text) FILTER (WHERE turn = 0) AS src, max(text) FILTER (WHERE turn = 1) AS sys FROM conversations GROUP BY conv_id) WHERE src IS NOT NULL AND sys IS NOT NULL AND src <> '' AND sys <> ''")
def split_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, sys rows through a CSV into two folders of files, and back."""
    folder = fresh_dir(spark, "summaries")
    c = _read(spark, sf_dir, "conversations")
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(*[F.max(F.when(F.col("turn") == i, F.col("text"))).alias(n) for i, n in enumerate(("src", "sys"))]).where("src <> '' AND sys <> ''")
    io.write_csv(rows, f"{folder}/csv")
    io.split_summaries(io.read_csv(spark, f"{folder}/csv", "id long, src string, sys string"), folder)
    parts = [io.read_folder(spark, f"{folder}/{n}").select(F.regexp_replace("filename", r"\.txt$", "").cast("long").alias("id"), F.col("text").alias(n)) for n in ("src", "sys")]
    return parts[0].join(parts[1], "id")


@query("SELECT nation.n_name AS name, n_nationkey::BIGINT AS key, 2 * n_regionkey::BIGINT AS twice FROM nation")
def json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a JSON folder in two parts, read with their schema, saved as a table and read again."""
    folder = fresh_dir(spark, "json")
    rows = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("key"), (2 * F.col("n_regionkey")).cast("long").alias("twice"))
    for part in (0, 1):
        io.append_json(rows.where(F.col("key") % 2 == part), f"{folder}/rows")
    return io.save_table(io.read_json_folder(spark, f"{folder}/rows", "name string, key long, twice long").drop("task"), f"{folder}/table")


@query("SELECT kind, 2 * count(*)::BIGINT AS n, (2 * sum(r_regionkey) + 10 * count(*))::BIGINT AS steps FROM region, (SELECT unnest(['json', 'csv', 'tsv']) AS kind) GROUP BY kind")
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to each kind of log."""
    folder, found = fresh_dir(spark, "logs"), None
    rows = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("step"), F.col("r_name").alias("note"))
    for kind in ("json", "csv", "tsv"):
        for k in (0, 10):
            io.write_log(rows.withColumn("step", F.col("step") + k), f"{folder}/{kind}", kind)
        part = io.read_log(spark, f"{folder}/{kind}", "step long, note string", kind).select(F.lit(kind).alias("kind"), "step")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


@query("SELECT lower(p_name) AS word, arg_max(p_size + p_partkey % 3, p_partkey)::DOUBLE AS first, count(*)::BIGINT AS n FROM (SELECT * FROM part UNION ALL SELECT * REPLACE (p_partkey + 1000000000 AS p_partkey) FROM part WHERE p_partkey % 2 = 0) GROUP BY lower(p_name)")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector lexicon of two files, the later of which counts."""
    folder = fresh_dir(spark, "vectors")
    part = _read(spark, sf_dir, "part")
    line = lambda more: F.concat(F.col("p_name"), F.lit("\t0 "), (F.col("p_size") + (F.col("p_partkey") + more) % 3).cast("string"), F.lit(" 7")).alias("value")
    for name, rows, more in (("a", part, 0), ("b", part.where("p_partkey % 2 = 0"), 1_000_000_000)):
        rows.repartition(1).sortWithinPartitions("p_partkey").select(line(more)).write.text(f"{folder}/{name}")
    lines = io.lexicon_lines(spark, f"{folder}/a", f"{folder}/b")
    n = lines.select(F.lower(F.split("value", "\t")[0]).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return io.vector_lexicon(lines).join(n, "word").select("word", F.get("vec", F.lit(0)).alias("first"), "n")


@query(X.with_tokens(f"""SELECT doc_id, para::BIGINT AS para, place::BIGINT AS place, raw AS word, lemma, tag, CASE WHEN {X.C['cw']} THEN 'CW' WHEN {X.C['fw']} THEN 'FW' END AS kind, {X.C['noun']} AS is_noun, {X.C['pronoun']} AS is_pronoun, CASE WHEN place < size - 1 THEN NULL WHEN sent = max(sent) OVER (PARTITION BY doc_id, para) THEN 'paragraph' ELSE 'sentence' END AS ends FROM (SELECT toks.*, size FROM toks JOIN (SELECT doc_id, sent, max(place) + 1 AS size FROM toks GROUP BY doc_id, sent) USING (doc_id, sent)) AS t"""))
def tagged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostic form of the tokens: classes, CW or FW, ends of sentences and paragraphs."""
    found = A.tagged_table(A.annotate(X.texts(spark, sf_dir)), M.class_conditions(X.ADJECTIVES))
    return found.select("doc_id", F.col("para").cast("long").alias("para"), F.col("place").cast("long").alias("place"), "word", "lemma", "tag", "kind", "is_noun", "is_pronoun", "ends")


# --- rows and columns -------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role AS speaker, trim(text) AS text FROM conversations WHERE trim(text) <> ''")
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``speaker TAB text`` lines with blank lines, rulers and lines without a tab among them."""
    c = _read(spark, sf_dir, "conversations").where("trim(text) <> ''")
    line = F.concat("role", F.lit("\t"), F.col("text"))
    noise = F.array(line, F.lit("  "), F.lit("-----\t-----"), F.lit("no tab here"))
    return D.parse_lines(c.select("conv_id", "turn", F.explode(noise).alias("value")))


@query("SELECT doc_id AS id, lang AS source, source AS lang, n_chars FROM documents")
def swapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").drop("text").withColumnRenamed("doc_id", "id")
    return docs.select("id", F.col("lang").alias("source"), F.col("source").alias("lang"), "n_chars")


@query("SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r BETWEEN 11 AND 60")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.row_range(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 50, 10)


RANKED = "SELECT conv_id, turn, text AS losing, CASE WHEN turn % 4 = 1 THEN upper(left(text, 5)) END AS winning FROM conversations"


@query(f"SELECT * FROM ({RANKED}) WHERE winning IS NOT NULL AND winning <> ''")
def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without a ranking go."""
    c = _read(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    rankings = c.select("k", F.when(F.col("turn") % 4 == 1, T.upper_each(F.left("text", F.lit(5)))).alias("winning"))
    return P.ranked_only(c.select("k", F.col("text").alias("losing")), rankings, "k").select("k.conv_id", "k.turn", "losing", "winning")


@query("SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS word FROM benchmark) WHERE len(regexp_extract_all(word, '[A-Za-z0-9]+|[^A-Za-z0-9]')) = 1")
def single_token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return P.single_token_words(words.withColumn("ids", F.regexp_extract_all("word", F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]"), F.lit(0))), "ids").select("word")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY len(regexp_extract_all(text, '\\S+')) DESC, turn) - 1)::BIGINT AS place FROM conversations")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch, here a conversation, by length."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("ids"))
    return S.longest_first(c, "conv_id", "ids", "turn").select("conv_id", "turn", "place")


@query("SELECT name, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders JOIN (VALUES " + ", ".join(f"('{name}', {i})" for name, ids in SETS.items() for i in ids) + ") AS s(name, id) ON id = o_orderkey GROUP BY name")
def masked_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is in a named set; masking of kind none has no set."""
    ids = [(name, i) for name in SETS for i in masked_ids("hard", name)] + [("none", i) for i in masked_ids("none", "")]
    table = spark.createDataFrame(ids, "name string, id long")
    orders = _read(spark, sf_dir, "orders")
    return orders.join(F.broadcast(table), F.col("o_orderkey") == F.col("id")).groupBy("name").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT kind, token, count(*)::BIGINT AS n FROM (SELECT doc_id % 4 AS kind, unnest(CASE WHEN list_position(ids, 7) > 0 THEN ids[1 : list_position(ids, 7) - 1] ELSE ids END) AS token FROM (" + X.IDS_SQL + ")) GROUP BY kind, token")
def token_frequency_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four maps at once, one for each kind of sequence, up to the first pad."""
    ids = X._ids(spark, sf_dir).select((F.col("doc_id") % 4).alias("kind"), F.explode(G.until_pad(F.col("ids"), 7)).alias("token"))
    return ids.groupBy("kind", "token").agg(F.count("*").alias("n"))


# --- texts ------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace('A:: ' || left(text, 30) || ' B::x AB:: y', '\b[AB]::', '', 'g') AS cleaned, left(trim(text), 1) AS initial, list_sort(list_distinct(list_transform(string_split(left(text, 12) || '/a*/ b!?/a', '/'), lambda w: trim(w, '*!? ' || chr(9))))) AS words FROM documents""")
def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker marks stripped, the speaker by the first character, the words of a vocabulary entry."""
    docs = _read(spark, sf_dir, "documents")
    marked = F.concat(F.lit("A:: "), F.left("text", F.lit(30)), F.lit(" B::x AB:: y"))
    entry = F.concat(F.left("text", F.lit(12)), F.lit("/a*/ b!?/a"))
    return docs.select("doc_id", T.strip_markers(marked).alias("cleaned"), T.speaker_initial(F.col("text")).alias("initial"), F.array_sort(T.cdi_words(entry)).alias("words"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""SELECT conv_id, turn, {_quoted(T.CORRECTION_SYSTEM)} AS system, 'Partial Text: ' || text AS asked, 'Student Completion: ' || role AS completion, 'Partial Text: ' || text || chr(10) || ' Corrected Completion:' AS opening, 5::BIGINT AS n,
'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || 'Be kind.<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || 'Original partial dialogue:' || chr(10) || text || chr(10) || chr(10) || 'Child model''s continuation:' || chr(10) || role || chr(10) || chr(10) || {_quoted(T.TEACHER_REQUEST)} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) AS teacher,
text || chr(10) || role || '::' AS next_turn FROM conversations""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correction chat, the teacher's prompt and the prompt for a next turn."""
    text, role = F.col("text"), F.col("role")
    c = _read(spark, sf_dir, "conversations").withColumn("m", T.correction_chat(text, role))
    content = lambda i: F.col("m")[i]["content"]
    return c.select("conv_id", "turn", content(0).alias("system"), content(1).alias("asked"), content(2).alias("completion"), content(4).alias("opening"), F.size("m").cast("long").alias("n"), T.teacher_prompt(F.lit("Be kind."), text, role).alias("teacher"), T.turn_prompt(text, role).alias("next_turn"))


# --- sequences and schedules ------------------------------------------------------------------------------------


def _lengths(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [len(w) + 1 for w in t.split(" ") if w])


@query("""SELECT conv_id, turn, array_to_string(list_concat(ids[1:16], list_transform(range(0, greatest(16 - len(ids), 0)), lambda i: 0::BIGINT)), ',') AS input_ids, least(len(ids), 16)::BIGINT AS attended, (turn % 3)::DOUBLE AS labels FROM (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)::BIGINT + 1) AS ids FROM conversations)""")
def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a tokenizer, cut and padded, with mask and label; a function stands in for the tokenizer."""
    c = _read(spark, sf_dir, "conversations").withColumn("y", F.col("turn") % 3)
    found = G.tokenised(c, "text", _lengths, 16, label="y")
    return found.select("conv_id", "turn", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"), F.col("labels").cast("double").alias("labels"))


@query("SELECT doc_id, (len(ids) + len(more) + 2)::BIGINT AS n, array_to_string(list_concat([1], ids[1:3], more, [1])[1:5], ',') AS head, (len(more) + 1)::BIGINT AS answered FROM (SELECT doc_id, ids[1:3] AS ids, ids[4:10] AS more FROM (" + X.IDS_SQL + "))")
def wrapped_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and response between end marks, and the mask of the response's targets."""
    ids = X._ids(spark, sf_dir).select("doc_id", F.slice("ids", 1, 3).alias("c"), F.slice("ids", 4, 7).alias("r"))
    whole = G.eos_wrap(F.col("c"), F.col("r"), 1)
    mask = G.response_mask(F.col("c"), F.col("r"))
    return ids.select("doc_id", F.size(whole).cast("long").alias("n"), F.array_join(F.slice(whole, 1, 5).cast("array<string>"), ",").alias("head"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("answered"))


STEP = "(SELECT event_id AS step, event_id % 3 AS round, event_id % 4 AS epoch, event_id % 2 = 0 AS sft FROM events)"


@query(f"""SELECT step, CASE WHEN sft THEN round * 7 * 50 + 50 * (epoch + 1) ELSE round * 7 * 50 + 50 * (epoch + 1) + 4 * 50 END AS done,
CASE WHEN sft AND epoch = 0 AND round = 0 THEN 'checkpoint_5M' WHEN sft AND (epoch + 1) % 2 = 0 AND round < 2 THEN 'checkpoint_' || (round * 50 + (epoch + 1) * 5) || 'M' WHEN NOT sft AND (epoch + 1) % 2 = 0 AND round < 2 THEN 'checkpoint_' || ((round + 1) * 50) || 'M' END AS after_epoch,
CASE WHEN sft AND epoch < 2 AND round = 0 AND step % 12 = 0 AND step > 0 THEN 'checkpoint_' || (epoch * 5 + step // 12) || 'M' END AS within FROM {STEP}""")
def global_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("event_id") % 3).alias("round"), (F.col("event_id") % 4).alias("epoch"), (F.col("event_id") % 2 == 0).alias("sft"))
    r, k, sft = F.col("round"), F.col("epoch"), F.col("sft")
    return e.select("step", C.global_step(r, k, F.lit(50), 4, 3, sft).cast("long").alias("done"), C.epoch_checkpoint(r, k, sft).alias("after_epoch"), C.early_checkpoint(F.col("step"), k, r, sft, 12).alias("within"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS finite, round(power(0.5, (event_id % 4 > 1)::INT) * power(2.0, (event_id % 2)::INT), 6) AS scale FROM events")
def finite_and_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are none become 0; the scale of the layers that a step touches."""
    v = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 6 == 3, F.lit(float("-inf"))).otherwise(F.col("value"))
    layers = F.concat(F.when(F.col("event_id") % 4 > 1, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")), F.when(F.col("event_id") % 2 == 1, F.array(F.lit("high"))).otherwise(F.array(F.lit("other"))))
    return _read(spark, sf_dir, "events").select("event_id", G.finite_or_zero(v).alias("finite"), F.round(G.layer_scale(layers, {"low": 0.5, "high": 2.0}), 6).alias("scale"))


_ROW = "(SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS t, list_transform(embedding[5:8], lambda x: x::DOUBLE) AS s FROM embeddings)"
_SOFT = "list_transform({x}, lambda v: exp(v) / list_sum(list_transform({x}, lambda w: exp(w))))"


@query(f"""SELECT vec_id, round(entropy, 4) AS entropy, round(kl, 4) AS kl, round(mean, 4) AS mean, round(std, 4) AS std, round(least_, 4) AS least FROM (SELECT vec_id, list_sum(list_transform(q, lambda p: -p * ln(p + 1e-10))) AS entropy, list_sum(list_transform(range(1, 5), lambda i: p[i] * (ln(p[i]) - ln(q[i])))) AS kl, list_avg(s) AS mean, list_stddev_pop(s) AS std, list_min(s) AS least_ FROM (SELECT vec_id, s, {_SOFT.format(x='t')} AS p, {_SOFT.format(x='s')} AS q FROM {_ROW}))""")
def metric_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by their names."""
    v = F.col("embedding").cast("array<double>")
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 4).alias("t"), F.slice(v, 5, 4).alias("s"))
    made = rows.select("vec_id", *[G.metric(n, F.col("t"), F.col("s")).alias(n) for n in ("entropy", "kl", "reward_stats")])
    return rounded(made.select("vec_id", "entropy", "kl", F.col("reward_stats.mean").alias("mean"), F.col("reward_stats.std").alias("std"), F.col("reward_stats.min").alias("least")), 4)


@query("SELECT conv_id, (turn - first)::BIGINT AS place, coalesce(text, '[ERROR]') AS x FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE text END AS text, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)")
def reshaped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of results as rows again; missing texts are marked."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("text")).alias("x"))
    return R.uncollate(R.collate(c, "conv_id", "turn"), "conv_id", ["x"]).select("conv_id", F.col("place").cast("long").alias("place"), "x")


@query("SELECT p_name AS word, coalesce(max(CASE WHEN p_size > 25 THEN p_size END), -1)::DOUBLE AS value FROM part GROUP BY p_name")
def word_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its value, -1 where it has none."""
    part = _read(spark, sf_dir, "part")
    found = part.where("p_size > 25").groupBy(F.col("p_name").alias("word")).agg(F.max("p_size").cast("double").alias("value"))
    return R.report(part.select(F.col("p_name").alias("word")).distinct(), found)


@query(X.with_tokens("""SELECT doc_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item) AS rank, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, lemma AS item, length(lemma) * 10.0 AS score FROM toks WHERE length(lemma) % 2 = 0)) WHERE rank <= floor(n * 0.1)"""))
def keyness_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.segment_words(X.texts(spark, sf_dir), "doc").select("doc_id", F.col("word").alias("item"))
    reference = words.select("item").distinct().where(F.length("item") % 2 == 0).withColumn("per_million", F.length("item") * 10.0)
    return L.keyness_simple(words, reference).select("doc_id", "item", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, (event_id % 5)::DOUBLE AS ttr, value AS x, CASE WHEN event_id % 2 = 0 THEN round(value / 100, 6) END AS positive FROM events")
def parsed_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed dictionary as columns; the score under one label of a classifier's answer."""
    printed = F.concat(F.lit("{'ttr': "), (F.col("event_id") % 5).cast("string"), F.lit(", 'x': "), F.col("value").cast("string"), F.lit("}"))
    label = F.when(F.col("event_id") % 2 == 0, "POSITIVE").otherwise("NEUTRAL")
    answers = F.array(F.struct(F.lit("NEGATIVE").alias("label"), F.lit(0.5).alias("score")), F.struct(label.alias("label"), (F.col("value") / 100).alias("score")))
    rows = _read(spark, sf_dir, "events").select("event_id", printed.alias("m"), answers.alias("a"))
    return rows.select("event_id", io.parse_metric_struct("m", ["ttr", "x"]).alias("m"), F.round(P.positive_score(F.col("a")), 6).alias("positive")).select("event_id", "m.ttr", "m.x", "positive")
