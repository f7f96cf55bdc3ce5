"""Queries that SQL cannot express, against plain Python: choices by hash, and the sequence matcher."""

import difflib
import os
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from loomtext.operators import lexicon as L
from loomtext.operators import prefs as P
from loomtext.operators import select as S
from loomtext.plans import cohesion, pipelines

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


def spark_hash(key: int, seed: int) -> int:
    """xxhash64(key, seed literal): the hash of the first column is the seed of the second."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", seed), first)))[0]


@needs_tables
def test_hash_sample(spark):
    rows = duckdb.sql(f"SELECT doc_id, n_chars FROM '{TABLES}/documents.parquet'").fetchall()
    want = sorted(rows, key=lambda r: (spark_hash(r[0], 42), r[0]))[:100]
    assert sorted(map(tuple, __spark_entry__.queries()["q_hash_sample"](spark, TABLES).collect())) == sorted(want)


def test_hash_split_and_seeded_take(spark):
    df = spark.range(3000)
    chosen = {r.id for r in df.where(S.hash_split(F.col("id"), 0.01)).collect()}
    assert chosen == {i for i in range(3000) if spark_hash(i, 42) % 1_000_000 < 10_000} and 10 < len(chosen) < 60
    order = sorted(range(3000), key=lambda i: (spark_hash(i, 7), i))[:200]
    assert [r.id for r in S.seeded_take(df, "id", 200, 7).orderBy("place").collect()] == order


def test_query_prefix(spark):
    rows = [(k, list(range(k % 12))) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, ids array<long>")
    got = {r.k: r.p for r in df.select("k", pipelines.query_prefix(F.col("ids"), F.col("k")).alias("p")).collect()}
    for k, ids in rows:
        first = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", k), 42)))[0]
        assert got[k] == ids[: first % 7 + 2]


def test_word_contexts_are_limited_by_hash(spark):
    sentences = spark.createDataFrame([(i, f"the {'cat' if i % 3 else 'dog'} sat") for i in range(900)], "sentence_id long, text string")
    found = L.contexts(spark.createDataFrame([("the",), ("cat",), ("cow",)], "word string"), sentences, limit=50).collect()
    for word, own in (("the", range(900)), ("cat", [i for i in range(900) if i % 3])):
        assert {r.sentence_id for r in found if r.word == word} == set(sorted(own, key=lambda i: (spark_hash(i, 42), i))[:50])
    assert not [r for r in found if r.word == "cow"]


@needs_tables
def test_repetition_by_the_matcher(spark):
    rows = duckdb.sql(f"""SELECT p.conv_id, p.turn, p.text, c.text FROM '{TABLES}/conversations.parquet' AS p JOIN '{TABLES}/conversations.parquet' AS c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1 AND c.role = 'assistant'
JOIN '{TABLES}/conversations.parquet' AS r ON r.conv_id = p.conv_id + 1 AND r.turn = p.turn + 1 AND r.role = 'assistant' WHERE p.role = 'user'""").fetchall()

    def repetitive(prompt, response):
        p, r = prompt.split(), response.split()
        if len(response.strip()) < 10 or len(r) < 5 or " ".join(p[-50:]) in response:
            return True
        return len(r[:20]) >= 10 and difflib.SequenceMatcher(None, p[-20:], r[:20]).ratio() > 0.8

    got = {(r.conv_id, r.turn): r.repetitive for r in __spark_entry__.queries()["q_repetitive"](spark, TABLES).collect()}
    assert got == {(c, t): repetitive(p, r) for c, t, p, r in rows}


def test_matcher_sees_near_repeats(spark):
    prompt = " ".join(f"w{i}" for i in range(30))
    near = " ".join([*[f"w{i}" for i in range(10, 28)], "other", "words", "follow"])
    far = " ".join(f"v{i}" for i in range(20))
    df = spark.createDataFrame([(prompt, near), (prompt, far), (None, far), (prompt, None)], "p string, r string")
    assert [r.x for r in df.select(P.repetitive(F.col("p"), F.col("r")).alias("x")).collect()] == [True, False, True, True]


def test_families_need_their_lexicons(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The dogs run. The dogs sleep."), (2, "word"), (3, None)], "doc_id long, text string")
    for families in (("unknown",), ("synonyms",), ("lsa",), ("source_keywords",)):
        with pytest.raises(ValueError):
            cohesion.process_texts(docs, families=families)
    assert {r.doc_id: r.status for r in cohesion.process_texts(docs).collect()} == {1: "ok", 2: "text too short", 3: "text too short"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("The dogs run. The dogs sleep.")
    (tmp_path / "source.txt").write_text("The dogs run and the cats run.")
    vectors = spark.createDataFrame([("dog", [1.0, 0.0]), ("run", [0.0, 1.0]), ("cat", [1.0, 1.0])], "word string, vec array<double>")
    found = cohesion.run_folder(spark, str(tmp_path / "in"), f"{tmp_path}/out", cohesion.Lexicons(lsa=vectors, dims=2), ("diversity", "lsa", "source_similarity"), str(tmp_path / "source.txt"), tagged=True, counts=True).collect()
    assert len(found) == 1 and found[0].Filename == "a.txt" and found[0].status == "ok"
    # dog twice and run once against dog, run twice and cat once
    assert found[0].source_similarity_lsa == pytest.approx((2 * 2 + 1 * 3) / (5**0.5 * 13**0.5))
    assert spark.read.csv(f"{tmp_path}/out/tagged", header=True).count() == 6
