"""Each stage of the pipeline, and all of them, on tables of odd rows with columns of the operators' own names."""

import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from loomtext.llm import tokens, toxicity
from tests.llm.fixtures import KINDS, frame, odd
from tests.llm.test_dedup import brute
from tests.llm.test_near_copies import kept


@pytest.mark.parametrize("kind", KINDS)
def test_stages_on_odd_rows(spark, tmp_path, kind):
    folder, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    rows = [(d, f"{t or ''} {'you are a zorgel' if i % 5 == 0 else ''}" if i % 4 else t, *rest) for i, (d, t, *rest) in enumerate(odd(kind))]
    frame(spark, rows, extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int("zorgel" in (t or ""))) for d, t, *_ in rows if d is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def run(name, before):
        out = stages[name](spark, before, folder)
        out.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert after.columns == before.columns and after.dtypes == before.dtypes
            assert after.where("__key <> 'x' OR __row <> 'x' OR __taken <> 'x' OR shard <> 'x' OR __others <> 'x'").count() == 0
        return after

    pair = lambda table: [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    grammar = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = run("toxicity", docs)
    scores = {(d, t): toxicity.clause_scores(t or "", grammar.weights)[0] for d, t in pair(docs)}
    logits = {k: grammar.bias + grammar.slope * math.log1p(v) for k, v in scores.items()}
    assert sorted(pair(clean), key=str) == sorted((r for r in pair(docs) if logits[r] < 0), key=str)
    unlike = run("simhash", clean)
    before = pair(clean)
    assert sorted(pair(unlike), key=str) == sorted((before[i] for i in kept(before)), key=str)
    left = run("suffix_dedup", unlike)
    want = [(d, h) for d, n, gone, _, h in brute(pair(unlike), lambda b: b, bytes, 100) if gone < n or not n]
    assert sorted(((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pair(left)), key=str) == sorted(want, key=str)
    mixed = run("mixing", left)
    words = lambda table: sum(len((t or "").split()) for _, t in pair(table))
    assert abs(words(mixed) - 1.5 * words(left)) <= 4
    assert {d for d, _ in pair(mixed)} <= {d for d, _ in pair(left)} and max(Counter(d for d, _ in pair(mixed) if d is not None).values(), default=0) <= 2 * max(Counter(d for d, _ in pair(left) if d is not None).values(), default=1)
    packed = run("packing", mixed).collect()
    own = tokens.encoder(tokens.default_vocabulary())
    assert sum(r.length for r in packed) == sum(len(own.plain(t or "")) + 1 for _, t in pair(mixed))
    whole = corpus_pipeline.run(spark, folder)
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in packed)
