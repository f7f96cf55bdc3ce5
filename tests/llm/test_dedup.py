import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomtext.llm.components import components
from loomtext.llm.extend import byte_symbols, first_windows
from loomtext.llm.seeds import seed_runs
from loomtext.llm.simhash import drop_near_duplicates, fingerprint, forest, gray_rank, linked, near_duplicates
from loomtext.llm.substring_dedup import substring_dedup
from loomtext.llm.suffix_dedup import suffix_dedup
from loomtext.llm.units import Spans
from tests.llm.fixtures import KINDS, documents, frame, odd


def in_order(rows):
    """Positions of rows by doc_id, nulls last, ties by text, nulls last."""
    return sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is None, rows[i][1] or ""))


def brute(rows, split, join, window):
    """What the contract asks for, unit by unit: a sorted list of (doc_id, units, removed, spans, hash)."""
    seen, out = {}, []
    units = {i: split((rows[i][1] or "").encode()) for i in in_order(rows)}
    for i in in_order(rows):
        for k in range(len(units[i]) - window + 1):
            seen.setdefault(tuple(units[i][k : k + window]), (i, k))
    for i in in_order(rows):
        own, gone = units[i], [False] * len(units[i])
        for k in range(len(own) - window + 1):
            if seen[tuple(own[k : k + window])] != (i, k):
                gone[k : k + window] = [True] * window
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = join([u for u, g in zip(own, gone) if not g])
        out.append((rows[i][0], len(own), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words_of(rows, window):
    return [(d, n, r, h) for d, n, r, _, h in brute(rows, bytes.split, b" ".join, window)]


CASES = [("plain", 1, 1 << 18), ("plain", 3, 500), *[(kind, 1 << 14, 1 << 18) for kind in ("plain", *KINDS)], *[(kind, 1, 700) for kind in KINDS]]


@pytest.mark.parametrize("kind,crowd,stretch", CASES)
def test_substring_dedup_equals_brute_force(spark, kind, crowd, stretch):
    rows = documents() if kind == "plain" else odd(kind)
    found = substring_dedup(frame(spark, rows, extra=kind == "plain"), window=20, crowd=crowd, stretch=stretch)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()), key=str)
    assert got == sorted(words_of(rows, 20), key=str)


@pytest.mark.parametrize("kind,crowd,stretch", CASES)
def test_suffix_dedup_equals_brute_force(spark, kind, crowd, stretch):
    rows = documents() if kind == "plain" else odd(kind)
    found = suffix_dedup(frame(spark, rows, extra=kind == "plain"), window=100, crowd=crowd, stretch=stretch)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=str)
    assert got == brute(rows, lambda b: b, bytes, 100)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_patterned_words_are_told_apart(spark):
    """Words, and sequences of words, whose polynomial hashes modulo 2**64 would be equal."""
    one, two = ("".join("ab"[b ^ flip] for b in thue_morse(2048)) for flip in (0, 1))
    head, tail = [f"h{i}" for i in range(12)], [f"t{i}" for i in range(12)]
    rows = [(k, " ".join([*head, w, *tail]), "en", "s", 1) for k, w in enumerate((one, two))]
    rows += [(k + 2, " ".join("xy"[b ^ flip] for b in thue_morse(4096)), "en", "s", 1) for k, flip in enumerate((0, 1))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, rows)).collect())
    assert got == sorted(words_of(rows, 20)) and got[1][2] == 0


def test_windows_of_one_anchor_are_compared_themselves():
    draw = np.random.default_rng(8)
    texts = [bytes(draw.choice(list(b"ab"), int(draw.integers(12, 20))).astype(np.uint8)) for _ in range(300)]
    symbols, bounds, units = byte_symbols(pa.array(texts, pa.binary()))
    window, gram = 9, 4
    runs, _ = seed_runs(units, bounds, window, gram)
    rows = [symbols[s : s + c + window - 1] for s, c in zip(runs.start, runs.count)]
    own = pa.array([(r - 1).astype(np.uint8).tobytes() for r in rows], pa.binary())
    symbols, bounds, units = byte_symbols(own)
    row, nth = first_windows(symbols, bounds, units, runs.count, window, gram)
    seen, want = set(), []
    for i, text in enumerate(own.to_pylist()):
        for k in range(int(runs.count[i])):
            if text[k : k + window] not in seen:
                seen.add(text[k : k + window])
                want.append((i, k))
    assert list(zip(row.tolist(), nth.tolist())) == want


def test_span_hashes_depend_on_the_span_alone():
    draw = np.random.default_rng(3)
    units = draw.integers(0, 3, 5000).astype(np.uint8)
    start = draw.integers(0, 4000, 3000)
    size = draw.integers(1, 12, 3000) ** 2
    whole = Spans(units).hash(start, start + size)
    by_content = {}
    for s, n, h in zip(start.tolist(), size.tolist(), whole.tolist()):
        content = units[s : s + n].tobytes()
        assert by_content.setdefault(content, h) == h == Spans(units[s : s + n]).hash(np.array([0]), np.array([n]))[0]
    assert len(set(by_content.values())) == len(by_content)


def test_runs_cover_each_window_once():
    raw = np.frombuffer(b"the quick brown fox " * 30 + b"jumps over lazy dogs" * 9, np.uint8)
    bounds = np.array([0, 333, 333, 400, len(raw)])
    runs, _ = seed_runs(raw, bounds, 50, 10)
    covered = np.concatenate([np.arange(s, s + c) for s, c in zip(runs.start, runs.count)])
    want = np.concatenate([np.arange(a, max(a, b - 49)) for a, b in zip(bounds[:-1], bounds[1:])])
    assert sorted(covered.tolist()) == want.tolist()


def fingerprint_by_bits(text):
    own = text.encode().lower().split()
    shingles = [b" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("kind", ["plain", *KINDS])
def test_near_duplicates_equal_brute_force(spark, kind):
    rows = documents() if kind == "plain" else odd(kind)
    order = in_order(rows)
    ids = [rows[i][0] for i in order]
    prints = [fingerprint_by_bits(rows[i][1] or "") for i in order]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), groups(ids, prints)), key=str)
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows, extra=kind == "plain")).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == want
    kept = drop_near_duplicates(frame(spark, rows, extra=True))
    assert kept.count() == len(set(groups(list(range(len(ids))), prints)))


def test_fingerprint_of_long_text():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert fingerprint(text.encode()) == fingerprint_by_bits(text)


@pytest.mark.parametrize("crowd", [20, 1 << 16])
def test_links_in_crowded_nodes(spark, crowd):
    draw = np.random.default_rng(4)
    centres = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = sorted({int(c) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False)) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in linked(df, crowd=crowd).collect()}
    want = groups(prints, prints)
    by_root = {}
    for p, g in zip(prints, want):
        s = p - (1 << 64) if p >> 63 else p
        by_root.setdefault(g, set()).add(roots.get(s, s))
    assert all(len(v) == 1 for v in by_root.values())
    assert len({next(iter(v)) for v in by_root.values()}) == len(by_root)


def test_forest_equals_all_pairs():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 40, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)) for _ in range(10)]))
    order = np.argsort(gray_rank(prints))
    prints = prints[order]
    a, b = forest(np.zeros(len(prints), np.int64), prints, 4)
    root = list(range(len(prints)))
    for x, y in zip(a, b):
        root[x] = y
    ids = list(range(len(prints)))
    want = groups(ids, [int(p) for p in prints])
    assert root == want


def test_gray_rank_inverts_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_odd_edges(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (9, 7), (7, 8), (None, 4), (10, 11), (11, 12), (12, 13), (13, 14)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
