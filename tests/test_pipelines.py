import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext import config
from loomtext.operators import signal as G
from loomtext.plans import pipelines as R


def test_settings_merge_and_reject_unknown_names():
    c = config.merged({"budget": 5, "families": ("overlap",)}, {"budget": 7})
    assert c.budget == 7 and c.families == ("overlap",)
    for bad in ({"colour": 1}, {"families": ("none",)}, {"families": ()}):
        with pytest.raises(ValueError):
            config.merged(bad)


def upper(s: pd.Series) -> pd.Series:
    return s.str.upper() + " and several more words than that"


def broken(s: pd.Series) -> pd.Series:
    raise RuntimeError("no model")


def length(s: pd.Series) -> pd.Series:
    return s.str.len().astype(float)


def test_preference_dataset_with_models(spark):
    prompts = spark.createDataFrame([(1, "tell me a story about owls"), (2, "what is rain")], "id long, prompt string")
    rows = R.preference_dataset(prompts, lambda s: s.str[:4], upper, length).orderBy("id").collect()
    assert [r.valid for r in rows] == [True, True] and rows[0].chosen.startswith("TELL ME") and rows[0].rejected == "tell"
    assert R.preference_dataset(prompts, broken, upper, length).count() == 0
    failed = R.apply_batches(prompts, "prompt", "out", broken).collect()
    assert {r.out for r in failed} == {"[ERROR]"} and len(failed) == 2


def test_retries_only_ask_for_what_is_missing(spark, tmp_path):
    prompts = spark.createDataFrame([(i,) for i in range(10)], "id long")
    asked = []

    def make(left, attempt):
        asked.append(left.count())
        return left.withColumn("valid", F.col("id") < 4 * (attempt + 1))

    out = R.with_retries(prompts, make, "id", str(tmp_path))
    assert asked == [10, 6] and out.count() == 10 and out.where("valid").count() == 8


def test_rounds_accumulate(spark, tmp_path):
    seen = []
    rows = spark.range(10)
    out = R.iterative_rounds(rows, "id", 3, lambda part, i: part.withColumn("round", F.lit(i)), lambda all_, i: seen.append(all_.count()), f"{tmp_path}/r")
    assert seen == [3, 6, 10] and out.count() == 10


def test_batches_and_samples(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "batch long, k long, x string")
    back = R.uncollate(R.collate(rows, "batch", "k"), "batch", ["x"]).orderBy("batch", "place").collect()
    assert [(r.batch, r.x) for r in back] == [(1, "a"), (1, "[ERROR]"), (2, "b")]
    chunks = spark.createDataFrame([(d, c) for d in "xy" for c in range(5)], "dataset string, chunk long")
    drawn = [tuple(r) for i in range(5) for r in R.sample_round(chunks, i).collect()]
    assert len(drawn) == len(set(drawn)) == 10
    ids = spark.createDataFrame([(i, list(range(20))) for i in range(50)], "i long, ids array<bigint>")
    sizes = {len(r.p) for r in ids.select(R.query_prefix(F.col("ids"), F.col("i")).alias("p")).collect()}
    assert sizes <= set(range(2, 9)) and len(sizes) > 3
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    assert {r.word: r.value for r in R.report(words, spark.createDataFrame([("a", 2.5)], "word string, value double")).collect()} == {"a": 2.5, "b": -1.0}


def test_rewards_and_regularised_losses(spark):
    pairs = spark.createDataFrame([(1, "the cat ran. the cat sat.", "dogs bark and birds sing. rain falls."), (2, "x", None)], "id long, child string, teacher string")
    got = {r.id: r for r in R.compute_rewards(pairs).collect()}
    assert got[1].reward == pytest.approx(got[1].child_score - got[1].teacher_score) and 0 < got[1].child_score < 1
    assert got[2].child_score == got[2].teacher_score == 0
    logits = spark.createDataFrame([([0.0, 1.0], [0.5, 0.5], 1)], "t array<double>, s array<double>, label int").withColumn("logits", F.col("t"))
    row = logits.select(G.kl_regularised_loss(F.col("t"), F.col("s"), F.lit(1.0)).alias("k"), G.entropy_regularised_loss(F.col("t"), F.col("s"), F.lit(1.0)).alias("e"), G.metric("kl", F.col("t"), F.col("s")).alias("m"), G.with_length_bonus(F.lit(0.9), F.lit(10), 0.1).alias("b")).first()
    assert row.k - 0.1 * row.m == pytest.approx(-(1.2 + 0.6065306597) / 2) and row.e == pytest.approx(-(1.2 + 0.6065306597) / 2 - 0.01 * 0.6931471806) and row.b == 1.0
    assert G.cross_entropy(logits).first().accuracy == 1.0
    with pytest.raises(ValueError):
        G.metric("other", F.col("t"), F.col("s"))
