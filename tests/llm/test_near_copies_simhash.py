from loomtext.llm import near_copies as N
from tests.llm.fixtures import frame
from tests.llm.test_near_copies import kept


def test_simhash_alone_retrieves_close_copies(spark, monkeypatch):
    """With bands that never meet, copies whose fingerprints lie within four bits are found by the index and checked exactly."""
    monkeypatch.setattr(N, "band_prints", lambda sets: (N.np.arange(len(sets) * N.BANDS, dtype=N.np.uint64) + N.np.uint64(len(sets[0]) << 32)).reshape(len(sets), N.BANDS))
    words = [f"w{i}" for i in range(400)]
    rows = [(d, " ".join([*words, *[f"t{d}"] * (d > 1)]), "en", "s1", 1) for d in range(1, 6)]
    rows += [(10, " ".join(f"other{i}" for i in range(300)), "en", "s1", 1), (11, "", "en", "s1", 1), (12, None, "en", "s1", 1)]
    found = N.drop_near_copies(frame(spark, rows).coalesce(1))
    assert {r.doc_id for r in found.collect()} == {rows[i][0] for i in kept(rows)}
