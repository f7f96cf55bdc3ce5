import hashlib

import numpy as np
import pytest

import corpus_pipeline
from loomtext.llm.near_copies import band_prints, drop_near_copies, links
from tests.llm.fixtures import KINDS, documents, frame, odd, tables
from tests.llm.test_dedup import brute, in_order


def shingles(text, size=5):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def kept(rows, similarity=0.8):
    """Positions of the rows that stay, by all pairs."""
    order = in_order(rows)
    sets = [shingles(rows[i][1]) for i in order]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [order[i] for i in range(len(rows)) if root[i] == i]


@pytest.mark.parametrize("kind", ["plain", *KINDS])
def test_near_copies_equal_brute_force(spark, kind):
    rows = documents() if kind == "plain" else odd(kind)
    found = drop_near_copies(frame(spark, rows, extra=kind == "plain"))
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted((rows[i][:2] for i in kept(rows)), key=str)


def test_near_copies_in_sliced_buckets(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join([*words, f"own{d}"] if d % 3 else [f"own{d}", *words[: 40 + d % 20]]), "en", "s1", 1) for d in range(90)]
    found = drop_near_copies(frame(spark, rows), room=200, crowd=4)
    assert {r.doc_id for r in found.collect()} == {rows[i][0] for i in kept(rows)}


def test_links_and_bands_at_the_threshold():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 100, dtype=np.uint64)
    other = draw.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.sort(base), np.sort(base[:80]), np.sort(base[:79]), np.sort(other)]
    assert sorted(links(sets[:2])) == [(0, 1)] and links([sets[0], sets[2]]) == [] and links([sets[0], sets[3]]) == []
    met = 0
    for _ in range(300):
        own = draw.integers(0, 1 << 63, 100, dtype=np.uint64)
        met += (np.equal(*band_prints([np.sort(own), np.sort(own[:80])]))).any()
    assert met == 300


def test_pipeline_drops_near_copies(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs, results = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [] if name == "packing" else docs.collect()
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        results.append((before, docs.collect()))
    (before, after) = results[1]
    rows = [(r.doc_id, r.text) for r in before]
    assert {r.doc_id for r in after} == {rows[i][0] for i in kept(rows)}
    (before, after) = results[2]
    want = {d: h for d, n, gone, _, h in brute([(r.doc_id, r.text) for r in before], lambda b: b, bytes, 100) if gone < n or not n}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == want
    (before, after) = results[3]
    assert abs(sum(len(r.text.split()) for r in after) - 1.5 * sum(len(r.text.split()) for r in before)) <= 4
    whole = corpus_pipeline.run(spark, folder).collect()
    assert whole and sum(r.length for r in whole) == sum(r.length for r in results[4][1])
