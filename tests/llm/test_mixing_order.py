from collections import Counter

from loomtext.llm import mixing
from tests.llm.fixtures import documents, frame


def test_mix_is_shuffled_within_output_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_A_SHARD", 8)
    docs = frame(spark, documents(), extra=True).repartition(3)
    shards = {r.doc_id: r.shards for r in mixing.mix(docs).collect()}
    every = [s for own in shards.values() for s in own]
    assert set(every) == set(range(max(every) + 1)) and len(set(every)) in (8, 16)
    rows = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    # some order of the shards explains the rows: each shard's rows stand together, with as many copies as it has
    assert sorted(rows) == sorted(d for d, own in shards.items() for _ in own)
    left, waiting = [Counter(d for d, own in shards.items() for k in own if k == s) for s in sorted(set(every))], list(rows)
    while waiting:
        fits = [own for own in left if Counter(waiting[: own.total()]) == own]
        assert fits
        left.remove(fits[0])
        waiting = waiting[fits[0].total() :]
    assert rows != sorted(rows) and any(a != b for a, b in zip(rows, sorted(rows)))
    assert rows == [r.doc_id for r in mixing.mixed_documents(docs.repartition(5)).collect()]
