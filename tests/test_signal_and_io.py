import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import schedule as C
from loomtext.operators import signal as G
from loomtext.operators import similarity as V
from loomtext.sources import io
from loomtext.streaming import running


def test_save_condition_and_policies(spark):
    steps = spark.range(2000)
    got = [r.x for r in steps.select("id", C.save_condition(F.col("id")).alias("x")).orderBy("id").collect()]
    want = [i % (2 if i < 20 else 5 if i < 100 else 10 if i < 500 else 50 if i < 1000 else 500) == 0 for i in range(2000)]
    assert got == want
    for total, decay, n_clm, n_ppo in ((10, 2, 3, 2), (7, 3, 0, 1), (5, 1, 1, 4), (4, 9, 2, 1)):
        left, epoch, place, want = total, 0, 0, []
        for _ in range(400):
            want.append("CLM" if epoch < n_clm or place < left else "PPO")
            place += 1
            if place >= total:
                place, epoch = 0, epoch + 1
                if epoch >= n_clm and (epoch - n_clm) % n_ppo == 0:
                    left = max(left - decay, 0)
        got = [r.x for r in spark.range(400).select("id", C.anneal_policy(F.col("id"), total, decay, n_clm, n_ppo).alias("x")).orderBy("id").collect()]
        assert got == want, (total, decay, n_clm, n_ppo)


def test_learning_rates(spark):
    lr, want = 0.001, []
    for _ in range(50):
        lr += 0.0001 if 0.0012 > 0.32 * lr else 0
        want.append(lr)
    got = [r.x for r in spark.range(1, 51).select("id", C.adaptive_lr(F.col("id"), 0.001, 0.0012, step=0.0001).alias("x")).orderBy("id").collect()]
    assert got == pytest.approx(want)
    row = spark.range(130, 131).select(C.cosine_half(F.col("id"), 2.0, 100).alias("h"), C.cosine_wave(F.col("id"), 2.0, 100, True).alias("w"), C.warmup_linear(F.col("id"), 1.0, 100, 120).alias("f"), C.warmup_linear(F.col("id"), 1.0, 100, 120, floor=False).alias("n")).first()
    assert row.h == pytest.approx(1 + math.cos(math.pi * 0.3)) and row.w == pytest.approx(math.cos(2 * math.pi * 1.3 - math.pi) + 1) and row.f == 0 and row.n == pytest.approx(-0.5)


def test_array_mathematics(spark):
    draw = np.random.default_rng(2)
    t, s = draw.normal(size=(5, 7)), draw.normal(size=(5, 7))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(t, s))], "i int, t array<double>, s array<double>")
    soft = lambda x: np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    got = df.select("i", G.kl_divergence(F.col("t"), F.col("s")).alias("kl"), G.entropy(F.col("t")).alias("h"), G.label_logprob(F.col("t"), F.lit(2)).alias("lp"), V.cosine(F.col("t"), F.col("s")).alias("c"), G.ppo_array_loss(F.col("t"), F.col("s"), F.lit(0.7)).alias("p")).orderBy("i").collect()
    assert [r.kl for r in got] == pytest.approx((soft(t) * (np.log(soft(t)) - np.log(soft(s)))).sum(axis=1))
    assert [r.h for r in got] == pytest.approx(-(soft(t) * np.log(soft(t) + 1e-10)).sum(axis=1))
    assert [r.lp for r in got] == pytest.approx(np.log(soft(t))[:, 2])
    assert [r.c for r in got] == pytest.approx((t * s).sum(axis=1) / np.linalg.norm(t, axis=1) / np.linalg.norm(s, axis=1))
    ratio = np.exp(s - t)
    assert np.allclose([r.p for r in got], -np.minimum(ratio * 0.7, np.clip(ratio, 0.8, 1.2) * 0.7))
    one = df.limit(1).select(G.gradient_scale(F.array(F.lit(5.0), F.lit(2.0))).alias("g"), G.gradient_scale(F.expr("CAST(array() AS array<double>)")).alias("e"), G.layer_scale(F.array(F.lit("a"), F.lit("b"), F.lit("z")), {"a": 0.5, "b": 0.4}).alias("l"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("n"), G.finite_or_zero(F.lit(float("inf"))).alias("f")).first()
    assert one.g == pytest.approx(0.2, abs=1e-6) and one.e == 1 and one.l == pytest.approx(0.2) and one.n is None and one.f == 0


def divergence(a, b, dims=300):
    """The index by its long form: positions over each side's norm, then 1 - Jensen-Shannon."""
    p = np.array([x / a if a else 0.0 for x in range(dims)])
    q = np.array([x / b if b else 0.0 for x in range(dims)])
    m = 0.5 * (p + q)
    with np.errstate(all="ignore"):
        kl = lambda u: np.nansum(u * np.log2(u / m))
        value = 1 - 0.5 * (kl(p) + kl(q))
    return value if value >= 0 else None


def test_divergence_closed_form(spark):
    cases = [(40_000.0, 44_000.0), (1e6, 9e5), (30.0, 900.0), (5e5, 5e5)]
    df = spark.createDataFrame([(i, [a], [b]) for i, (a, b) in enumerate(cases)], "i int, a array<double>, b array<double>")
    got = [r.x for r in df.select("i", V.divergence_index(F.col("a"), F.lit(1), F.col("b"), F.lit(1)).alias("x")).orderBy("i").collect()]
    for x, (a, b) in zip(got, cases):
        want = divergence(a, b)
        assert (x is None) == (want is None) and (x is None or x == pytest.approx(want))


def test_sequences(spark):
    row = spark.createDataFrame([([5, 6, 7, 6, 7], [6, 7])], "a array<bigint>, b array<bigint>").select(
        G.find_ids(F.col("a"), F.col("b")).alias("f"), G.find_ids(F.col("b"), F.col("a")).alias("n"), G.pad_ids(F.col("b"), 4, 9).alias("r"), G.pad_ids(F.col("b"), 4, 9, left=True).alias("l"), G.pad_ids(F.col("a"), 3).alias("c"), G.attention_mask(F.col("b"), 4).alias("m"), G.eos_wrap(F.col("b"), F.col("a"), 1).alias("w"), G.response_mask(F.col("b"), F.col("a")).alias("k"), G.until_pad(F.col("a"), 7).alias("u")
    ).first()
    assert (row.f, row.n, row.r, row.l, row.c, row.m) == (1, -1, [6, 7, 9, 9], [9, 9, 6, 7], [5, 6, 7], [1, 1, 0, 0])
    assert row.w == [1, 6, 7, 5, 6, 7, 6, 7, 1] and row.k == [0, 0, 1, 1, 1, 1, 1, 1] and row.u == [5, 6]


def test_banned_tokens_and_pairs(spark):
    p = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (1, 3, 0.25), (2, 2, 1.0)], "seq long, token long, p double")
    got = {(r.seq, r.token): r.p for r in G.banned_renormalised(p, spark.createDataFrame([(2,)], "token long"), 0).collect()}
    assert got == {(1, 1): pytest.approx(2 / 3), (1, 3): pytest.approx(1 / 3), (2, 0): 1.0}


def test_files_and_lexicons(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A:\tx\n\n----\nB:\ty z\n")
    (tmp_path / "b.txt").write_text("whole\ntext")
    assert [r.value for r in io.read_lines(spark, f"{tmp_path}/a.txt").orderBy("line").collect()] == ["A:\tx", "B:\ty z"]
    assert {(r.filename, r.text) for r in io.read_folder(spark, str(tmp_path)).collect()} >= {("b.txt", "whole\ntext")}
    df = spark.createDataFrame([("k1", 'say "hi",\nthen'), ("k2", "plain")], "key string, text string")
    io.write_csv(df, f"{tmp_path}/csv")
    assert {tuple(r) for r in io.read_csv(spark, f"{tmp_path}/csv", "key string, text string").collect()} == {tuple(r) for r in df.collect()}
    io.write_text_by_key(df, "key", "text", f"{tmp_path}/keyed")
    assert (tmp_path / "keyed" / "key=k2").exists()
    io.append_json(df, f"{tmp_path}/json")
    io.append_json(df, f"{tmp_path}/json")
    assert io.read_json_folder(spark, f"{tmp_path}/json", "key string, text string").count() == 4
    assert io.save_table(df, f"{tmp_path}/table").count() == 2
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(["# c", "", "dog\thound\tpup", "Dog\tcur", "dog\tbeast", "lone"])], "line long, value string")
    assert {r.word: r.syns for r in io.list_lexicon(lines).collect()} == {"dog": ["beast"], "Dog": ["cur"]}
    vectors = spark.createDataFrame([(0, "Dog\t9 1.5 2"), (1, "cat\t1"), (2, "dog\t0 3 4")], "line long, value string")
    assert {r.word: r.vec for r in io.vector_lexicon(vectors).collect()} == {"dog": [3.0, 4.0]}
    numbers = spark.createDataFrame([(0, "A\t5\t100"), (1, "b\t5\t0")], "line long, value string")
    assert {r.word: r.value for r in io.number_lexicon(numbers, 2, log=True).collect()} == {"a": 2.0}
    packed = spark.createDataFrame([("{'ttr': 0.5, 'x': 1}",)], "m string")
    assert packed.select(io.parse_metric_struct("m", ["ttr", "x"]).alias("m")).first().m.ttr == 0.5


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a b a",), ("b",)], "text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    q = running.token_frequencies(stream).writeStream.format("memory").queryName("freq").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.word: r["count"] for r in spark.table("freq").collect()} == {"a": 2, "b": 2}
    q = running.append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(f"{tmp_path}/out").count() == 2
