import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from loomtext.llm import tokens, toxicity
from loomtext.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import tables
from tests.llm.test_dedup import brute
from tests.llm.test_near_copies import kept


def test_stages_against_plain_code(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        results.append((docs.collect(), after.collect()))
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs = after
    (before, after) = results[0]
    grammar = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert grammar.weights and {r.doc_id for r in after} == {r.doc_id for r in before if r.doc_id % 6}
    (before, after) = results[1]
    rows = [(r.doc_id, r.text) for r in before]
    assert {r.doc_id for r in after} == {rows[i][0] for i in kept(rows)}
    (before, after) = results[2]
    want = {d: h for d, n, gone, _, h in brute([(r.doc_id, r.text) for r in before], lambda b: b, bytes, 100) if gone < n or not n}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == want
    (before, after) = results[3]
    words = {r.doc_id: len(r.text.split()) for r in before}
    taken = {d: sum(len(r.text.split()) for r in after if r.doc_id == d) for d in words}
    assert all(taken[d] <= 2 * n for d, n in words.items()) and abs(sum(taken.values()) - 1.5 * sum(words.values())) <= 4
    (before, after) = results[4]
    own = tokens.encoder(tokens.default_vocabulary())
    ids = {}
    for r in before:
        ids.setdefault(r.doc_id, []).append(np.array([*own.plain(r.text), 0], "<u4"))
    assert sum(p.length for p in after) == sum(len(x) for lists in ids.values() for x in lists)
    assert all(any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id]) for p in after)
    whole = sorted(map(str, QUERIES["pipeline"](spark, folder).drop("sequence_id").collect()))
    assert len(whole) > 0 and sum(p.length for p in after) == sum(r.length for r in QUERIES["pipeline"](spark, folder).collect())


def test_registered_queries():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 11)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect()) == sorted(found.fetchall())
