"""Folds over groups that fill several partitions, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import dialogue as D
from loomtext.operators import select as S
from loomtext.operators import signal as G
from loomtext.operators.scan import running_sums


@pytest.fixture()
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def utterances(seed, n=400):
    """A third of the rows and more belong to one group; runs of one speaker, some long."""
    draw, rows, speaker = random.Random(seed), [], "A"
    for k in range(n):
        group = draw.choice([1, 1, 1, 2, 3, 4, None])
        if draw.random() < 0.6:
            speaker = draw.choice(["A", "B", "C", None])
        rows.append((group, k, speaker, f"u{k}"))
    return rows


def by_group(rows):
    groups = {}
    for g, k, s, t in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((k, s, t))
    return groups


@pytest.mark.parametrize("seed", range(4))
def test_turns_and_dialogues(many_partitions, seed):
    rows = utterances(seed)
    df = many_partitions.createDataFrame(rows, "g long, k long, speaker string, text string").repartition(5)
    turns, dialogues = {}, {}
    for g, own in by_group(rows).items():
        merged, open_, done = [], [], []
        for _, s, t in own:
            if merged and merged[-1][0] == s:
                merged[-1][1].append(t)
            else:
                merged.append((s, [t]))
            if open_ and open_[-1][0] == s:
                open_[-1][1].append(t)
            else:
                open_.append((s, [t]))
            if len(open_) == 5:
                done.append([(a, " ".join(b)) for a, b in open_])
                open_ = []
        turns[g] = [(a, " ".join(b)) for a, b in merged]
        dialogues[g] = done
    got = {}
    for r in D.merge_turns(df, "g", "k").orderBy("turn").collect():
        got.setdefault(r.g, []).append((r.speaker, r.text))
        assert len(got[r.g]) == r.turn
    assert got == turns
    found = {g: [] for g in dialogues}
    for r in D.chunk_dialogues(df, "g", "k").orderBy("dialogue").collect():
        assert r.dialogue == len(found[r.g])
        found[r.g].append([(t.speaker, t.text) for t in r.turns])
    assert found == dialogues


def test_running_sums_and_normalisation(many_partitions):
    draw = random.Random(5)
    rows = [(draw.choice([7, 7, 7, 8, 9]), k, draw.choice([None, 1.0, 2.5, 10.0, -3.0])) for k in range(500)]
    df = many_partitions.createDataFrame(rows, "g long, k long, x double").repartition(3)
    sums, want, scaled = {}, {}, {}
    for g, k, x in rows:
        own = sums.setdefault(g, [])
        own += [x] if x is not None else []
        want[k] = sum(own)
        if x is not None:
            mean = sum(own) / len(own)
            sd = (sum((y - mean) ** 2 for y in own) / len(own)) ** 0.5
            scaled[k] = 0.0 if sd < 1e-9 else max(-3.0, min(3.0, (x - mean) / sd))
        else:
            scaled[k] = None
    assert {r.k: r.s for r in running_sums(df, "g", "k", {"s": F.col("x")}).collect()} == pytest.approx(want)
    got = {r.k: r.normalised for r in G.running_normalised(df, "x", "g", "k").collect()}
    assert {k for k, v in got.items() if v is None} == {k for k, v in scaled.items() if v is None}
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in scaled.items() if v is not None)
    empty = df.limit(0)
    assert G.running_normalised(empty, "x", "g", "k").count() == 0 and running_sums(empty, "g", "k", {"s": F.col("x")}).columns == ["g", "k", "x", "s"]


def test_row_numbers_over_many_partitions(many_partitions):
    df = many_partitions.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)))
    rows = sorted((r.x, r.id, r.row) for r in S.row_index(df, F.col("x"), F.col("id")).collect())
    assert [r[2] for r in rows] == list(range(1000))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from loomtext.shared import shared_dir

    named: list[str] = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: named[-1] if named else None, setCheckpointDir=named.append)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
    session.conf = SimpleNamespace(get=lambda name, default: "hdfs://host/shared/")
    assert shared_dir(session) == "hdfs://host/shared" and named == ["hdfs://host/shared/"]
