"""Queries against their SQL on small tables made for it."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from loomtext.operators import indices as I
from loomtext.operators import similarity as V
from loomtext.plans import cohesion as CO
from loomtext.plans.registry import rounded
from loomtext.sources import io


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables given as SQL selects."""
    con = duckdb.connect()
    for table, select in tables.items():
        path = f"{folder}/{table}.parquet"
        con.execute(f"COPY ({select}) TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    return sorted(map(tuple, df.select(*columns).collect()), key=str), sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_scales_below_a_tenth(spark, tmp_path):
    got, want = both(spark, tmp_path, "q_teacher_rewards", embeddings="SELECT i::BIGINT AS vec_id, [i / 3, 0.5, 0.1]::FLOAT[] AS embedding FROM range(6) AS t(i)")
    assert got == want and min(r[1] for r in got) < 0.1


def test_capitals_keep_the_length(spark, tmp_path):
    texts = ["äß bc", "größe", "ΐᾳﬁnis", "plain", "", "İıŉxy"]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS conv_id, 1::BIGINT AS turn, 'user' AS role, '{t}' AS text" for i, t in enumerate(texts))
    got, want = both(spark, tmp_path, "q_ranked_pairs", conversations=rows + " UNION ALL SELECT 9, 1, 'user', NULL")
    assert got == want and len(got) == 5


def test_moving_ratio_adds_windows_in_order():
    draw = np.random.default_rng(5)
    docs = [draw.integers(0, 40, n) for n in (0, 3, 50, 51, 130, 700, 64)]
    doc, ids = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
    want = []
    for d in docs:
        shares = [len(set(d[i : i + 50])) / 50 for i in range(len(d) - 49)] if len(d) > 50 else [len(set(d)) / max(len(d), 1)]
        total = 0.0
        for x in shares:
            total += x
        want.append(total / len(shares))
    assert I.moving_ratio(doc, ids, len(docs)).tolist() == want


def test_rounding_follows_sql(spark):
    values = [0.1234565, 0.8984375, 2.0000005, -0.1053125, 1.0000015, 0.0, 123.4567895, None]
    con = duckdb.connect()
    got = [r.v for r in rounded(spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)).collect()]
    assert got == [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


TEXTS = "SELECT i::BIGINT AS doc_id, CASE i % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'One.' ELSE 'The dogs run to ' || i || '. A dog sat here!' || chr(10) || 'Then dogs ' || (i % 3) || ' ran. It was the house. No.' || chr(10) || chr(10) || 'So the end' END AS text FROM range(30) AS t(i)"
VECTORS = "SELECT i::BIGINT AS vec_id, list_transform(range(64), lambda j: sin(i * 7 + j)::FLOAT) AS embedding FROM range(12) AS t(i)"


def test_similarity_in_one_pass_needs_no_shuffle(spark, tmp_path):
    for name in ("q_vector_similarity", "q_vector_similarity_paragraphs", "q_source_similarity"):
        got, want = both(spark, tmp_path, name, documents=TEXTS, embeddings=VECTORS)
        assert got == want and len({r[1:] for r in got}) > 1
    vectors = spark.createDataFrame([("dog", [1.0, 0.5]), ("the", [0.25, 1.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "The dogs. The dog the.")], "doc_id long, text string")
    found = CO.vector_indices(docs, vectors, ("lsa",), dims=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_large_lexicons_meet_words_in_a_join(spark, monkeypatch):
    vectors = spark.createDataFrame([("dog", [1.0, 0.5]), ("the", [0.25, 1.0]), ("run", [-0.5, 0.125])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "The dogs run. The dog.\nA cat. The runs the"), (2, None), (3, "dog"), (4, "x. y. z")], "doc_id long, text string")
    sources = docs.selectExpr("5 - doc_id AS doc_id", "text")

    def made() -> list:
        parts = [CO.vector_indices(docs, vectors, ("lsa", "lda"), dims=2), CO.source_similarity(docs, sources, {"lsa": vectors, "lda": vectors}, dims=2)]
        return [sorted(tuple(r) for r in rounded(p).collect()) for p in parts]

    small = made()
    monkeypatch.setattr(V, "NUMBERS", 4)
    assert V.lookup(vectors, 2) is None and made() == small


def test_spread_files_are_listed_by_tasks(spark, tmp_path):
    rows = [(f"{i}.txt", f"text {i}\nä" if i % 5 else None) for i in range(60)]
    folder = f"{tmp_path}/texts"
    assert io.write_files(spark.createDataFrame(rows, "name string, text string"), "name", "text", folder, 7) == 60
    found = io.read_spread(spark, folder, 7)
    assert sorted(map(tuple, found.collect())) == sorted((n, t or "") for n, t in rows)
    assert "Scan text" not in found._jdf.queryExecution().executedPlan().toString()
