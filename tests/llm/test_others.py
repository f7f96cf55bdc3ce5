import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import ann, grammar, license_scan, media, mixing, packing, tokens, toxicity
from tests.llm.fixtures import KINDS, documents, frame, odd

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def rows_of(kind):
    return documents() if kind == "plain" else odd(kind)


# --- tokens -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", *KINDS])
def test_token_counts_equal_the_library(spark, kind):
    rows = [*rows_of(kind), *([(900, "a <|endoftext|> b<|endoftext|>", "en", "s", 1), (901, "日本語 текст 🙂🙂  \n\n x’s 12345", "en", "s", 1)] if kind != "empty" else [])]
    got = sorted((tuple(r) for r in tokens.token_counts(frame(spark, rows, extra=True), chunk=5_000, overlap=64).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), n := len(library_ids(t)), n > 1024) for d, t, *_ in rows), key=str)
    assert got == want


def test_every_character_gives_the_library_ids():
    own = tokens.encoder(tokens.default_vocabulary())
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}" for c in points]
    for k in range(0, len(texts), 4000):
        part = texts[k : k + 4000]
        assert [own.plain(t) for t in part] == [e.ids for e in LIBRARY.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a" * 9_000, " " * 4_000 + "word " * 3_000, "x\n\n  y " * 2_000, "don't stop 12 34! " * 900, "é" * 3_000 + " z" * 3_000])
def test_spliced_parts_equal_the_whole(text):
    own = tokens.encoder(tokens.default_vocabulary())
    for chunk, overlap in ((64, 4), (500, 16), (4_000, 100)):
        assert np.concatenate(list(own.parts(text, chunk, overlap))).tolist() == library_ids(text)


BLANK = {"spaces": " " * 10**6, "newlines": "\n" * 10**6, "tabs": "\t" * 10**6, "mixed": " \n\t\u3000\xa0" * 200_000}


@pytest.mark.parametrize("kind", BLANK)
def test_long_white_space_gives_the_library_ids(kind):
    own = tokens.encoder(tokens.default_vocabulary())
    for text in (BLANK[kind], f"word{BLANK[kind]}", f"{BLANK[kind]}word", f"a {BLANK[kind]}b<|endoftext|>{BLANK[kind]} c"):
        want = library_ids(text)
        assert own.plain(text) == want and np.concatenate(list(own.parts(text))).tolist() == want


def test_long_white_space_in_tables(spark):
    rows = [(i, f"a{t}b", "en", "s", 1) for i, t in enumerate(BLANK.values())]
    want = {d: len(library_ids(t)) for d, t, *_ in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(frame(spark, rows)).collect()} == want
    found = packing.pack_documents(frame(spark, rows)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in found} == want


def test_files_of_another_kind_are_refused(tmp_path):
    model = json.load(open(tokens.default_vocabulary(), encoding="utf-8"))
    model["model"]["merges"][5], model["model"]["merges"][900] = model["model"]["merges"][900], model["model"]["merges"][5]
    (tmp_path / "swapped.json").write_text(json.dumps(model))
    with pytest.raises(ValueError, match="order"):
        tokens.Encoder(str(tmp_path / "swapped.json"))


# --- packing ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", *KINDS])
def test_packing_round_trip(spark, kind):
    rows = rows_of(kind)
    pieces = packing.pack_documents(frame(spark, rows, extra=True), window=64, stretch=3_000).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        size = sum(p.length for p in own)
        assert size == 64 or size < 64 and size & (size - 1) == 0
    want = defaultdict(list)
    for d, t, *_ in rows:
        want[d].append(np.array([*library_ids(t), 0], "<u4"))
    assert sum(p.length for p in pieces) == sum(len(x) for ids in want.values() for x in ids)
    for p in pieces:
        assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in want[p.doc_id])


def nnls(a, b):
    """Lawson and Hanson's active set: least squares over x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    while True:
        w = a.T @ (b - a @ x)
        if passive.all() or w[~passive].max(initial=0) < 1e-9:
            return x
        passive[np.argmax(np.where(passive, -np.inf, w))] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                x = z
                break
            low = passive & (z <= 0)
            x += (x[low] / (x[low] - z[low])).min() * (z - x)
            passive &= x > 1e-12


def test_repeat_counts_come_near_least_squares():
    draw = np.random.default_rng(7)
    for window in (16, 24):
        counts = np.zeros(window + 1, np.int64)
        counts[1:window] = draw.integers(0, 60, window - 1)
        combos = packing.combinations_of(counts, window)
        a = np.zeros((window + 1, len(combos)))
        for j, row in enumerate(combos):
            for v in row[row > 0]:
                a[v, j] += 1
        error = lambda x: float(((a @ x - counts) ** 2).sum())
        own, best = packing.repeat_counts(combos, counts), nnls(a, counts.astype(float))
        assert (own >= 0).all() and error(own) <= error(best) + 0.02 * float((counts**2).sum())


def test_patterns_fill_windows():
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 3000, 4000)
    sequences = packing.pack(lengths, 1024)
    seen = defaultdict(int)
    for s in sequences:
        assert sum(p[2] for p in s) == 1024 or len(sequences) - sequences.index(s) < 12
        for i, _, n in s:
            seen[i] += n
    assert all(seen[i] == n for i, n in enumerate(lengths))
    pieces, least = sum(map(len, sequences)), int(np.ceil(lengths / 1024).sum())
    assert pieces <= 1.35 * least  # most rests are placed uncut
    combos = packing.combinations_of(np.bincount(lengths % 1024, minlength=1025), 1024)
    assert (combos.sum(axis=1) == 1024).all()


# --- mixing -----------------------------------------------------------------------------------------------------


def test_targets_follow_weights_and_caps():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1], 450, 2) == [200, pytest.approx(166.6667, abs=1e-3), pytest.approx(83.3333, abs=1e-3)]
    assert mixing.fill_targets([0, 10], [5, 2], 15, 2) == [0, 15]
    assert mixing.fill_targets([0, 0], [5, 2], 0, 2) == [0, 0]


@pytest.mark.parametrize("kind", ["plain", *KINDS])
def test_mix_meets_targets(spark, kind):
    rows = rows_of(kind)
    found = mixing.mix(frame(spark, rows, extra=kind == "plain"))
    got = found.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows)).collect())) and len(got) == len(rows)
    sizes = defaultdict(int)
    for d, t, _, source, _ in rows:
        sizes[source] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.fill_targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)))
    assert sum(r.taken for r in got) == pytest.approx(sum(targets.values()), abs=len(names))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(sizes[n], round(targets[n], 6)) for n in names}


def water_level(sizes, weights, budget, cap):
    """Targets by bisection for the level at which sources, filled by weight up to their caps, hold the budget."""
    low, high = 0.0, 1e15
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(w * level, cap * n) for n, w in zip(sizes, weights)) < budget:
            low = level
        else:
            high = level
    return [min(w * low, cap * n) for n, w in zip(sizes, weights)]


def test_targets_equal_a_water_level():
    draw = np.random.default_rng(13)
    for _ in range(200):
        sizes = draw.integers(0, 1000, int(draw.integers(1, 9))).tolist()
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert mixing.fill_targets(sizes, weights, 1.5 * sum(sizes), 2) == pytest.approx(water_level(sizes, weights, 1.5 * sum(sizes), 2), abs=1e-6)


def test_what_is_taken_follows_the_order_of_hashes(spark):
    """Without the operator's own sums: each source's documents in the order of their places, filled up to the quota."""
    rows = [(i, " ".join("w" * (1 + i % 7)), "en", f"s{i % 4 if i % 3 else 0}", 1) for i in range(500)]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    sizes, by_source = defaultdict(int), defaultdict(list)
    for d, t, _, source, _ in rows:
        sizes[source] += len(t.split())
        by_source[source].append((d, len(t.split())))
    names = sorted(sizes)
    targets = water_level([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    for name, target in zip(names, targets):
        taken = sorted(got[d].taken for d, _ in by_source[name])
        quota = sum(taken)
        assert abs(quota - target) <= 1
        passes, rest = divmod(quota, sizes[name])
        extra = [got[d].taken - passes * n for d, n in by_source[name]]
        # whole documents of one more pass, none of the others, and one in part at most
        assert sum(extra) == rest and sum(0 < e < n for e, (_, n) in zip(extra, by_source[name])) <= 1
        assert all(e in (0, n) or 0 < e < n for e, (_, n) in zip(extra, by_source[name]))
    assert all(len(r.shards) == -(-r.taken // r.size) for r in got.values())


def test_leaves_hold_exact_and_fair_quotas():
    blocks = np.array([100, 0, 50, 1000, 3, 7, 400, 41])
    total = np.zeros((8, len(blocks)))
    for seed in range(300):
        leaves = list(mixing.leaf_blocks(blocks, 3, 0, 8, seed))
        own = np.stack([n for _, _, n in leaves])
        assert [k for k, _, _ in leaves] == list(range(8)) and (own.sum(axis=0) == blocks).all() and (own >= 0).all()
        assert (np.stack([s for _, s, _ in leaves]) == np.cumsum(own, axis=0) - own).all() and np.ptp(own.sum(axis=1)) <= 1
        part = list(mixing.leaf_blocks(blocks, 3, 4, 2, seed))
        assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(part, leaves[4:6]))
        total += own
    assert np.allclose(total / 300, blocks / 8, rtol=0.12, atol=1)


def test_blocks_beyond_the_generators_bound(spark):
    rows = documents()
    fine = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()}
    coarse = mixing.mix(frame(spark, rows), blocks=64, max_slots=2).collect()
    by_source = lambda taken: {s: sum(taken[d] for d, _, _, t, _ in rows if t == s) for s in (None, "s0", "s1", "s2")}
    assert by_source({r.doc_id: r.taken for r in coarse}) == by_source(fine)


def test_mixed_documents_hold_what_is_taken(spark):
    rows = documents()
    taken = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()}
    words = defaultdict(int)
    out = mixing.mixed_documents(frame(spark, rows, extra=True))
    assert out.columns == frame(spark, rows, extra=True).columns
    for r in out.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words == {d: n for d, n in taken.items() if n}


# --- media ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", *KINDS])
def test_media_round_trip(spark, kind):
    rows = rows_of(kind)
    got = media.media_features(frame(spark, rows, extra=True)).collect()
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        stored = media.png_of(payload)
        assert media.payload_of(stored) == payload
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(np.frombuffer(payload, np.uint8))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def decoded(png):
    """The samples of an RGB image, read without the operator's own code."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, body = 8, b""
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        assert int.from_bytes(png[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + data)
        if kind == b"IHDR":
            width, height = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
            assert data[8:] == bytes([8, 2, 0, 0, 0])
        body += data if kind == b"IDAT" else b""
        at += 12 + size
    raw = zlib.decompress(body)
    lines = [raw[i * (3 * width + 1) :][: 3 * width + 1] for i in range(height)]
    assert all(line[0] == 0 for line in lines)
    return b"".join(line[1:] for line in lines)


def plain_feature(samples):
    n = len(samples)
    mean = sum(samples) / n
    edges = [n * i // 64 for i in range(65)]
    cells = [sum(samples[a:b]) / (b - a) for a, b in zip(edges, edges[1:])]
    level = sum(cells) / 64
    bits = sum(1 << (63 - i) for i, c in enumerate(cells) if c > level)
    return f"{mean:.4f}:{(sum((x - mean) ** 2 for x in samples) / n) ** 0.5:.4f}:{bits:016x}"


def test_members_decode_and_describe_as_plain_code_says(spark, tmp_path):
    rows = documents()
    manifest = media.write_archives(frame(spark, rows).repartition(3), str(tmp_path))
    stored = media.read_archives(spark, str(tmp_path), manifest).collect()
    digests = {r.doc_id: r for r in media.media_features(frame(spark, rows)).collect()}
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    for r in stored:
        samples = decoded(bytes(r.media))
        assert samples.rstrip(b" ") == texts[r.doc_id].rstrip(b" ") and len(samples) % 192 == 0
        assert digests[r.doc_id].feature == plain_feature(samples) and digests[r.doc_id].payload_sha256 == hashlib.sha256(samples).hexdigest()
        assert digests[r.doc_id].media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()


def test_archives_of_failed_attempts_are_not_read(spark, tmp_path):
    manifest = media.write_archives(frame(spark, documents()).repartition(3), str(tmp_path))
    media.write_archives(frame(spark, documents()), str(tmp_path / "other"))
    for path in (tmp_path / "other" / "archives").glob("*.zip"):
        path.rename(tmp_path / "archives" / path.name)
    assert media.read_archives(spark, str(tmp_path), manifest).count() == len(documents())
    assert media.read_archives(spark, str(tmp_path)).count() == 2 * len(documents())


def test_byte_ranges_cover_members_and_reads_are_retried(spark, tmp_path):
    df = frame(spark, documents())
    media.write_archives(df.repartition(3), str(tmp_path))
    reader = media.MediaReader({"folder": f"{tmp_path}/archives", "range_bytes": "2000"})
    parts = reader.partitions()
    assert len(parts) > 5
    seen = [(b.column(0)[i].as_py(), b.column(1)[i].as_py()) for p in parts for b in reader.read(p) for i in range(len(b))]
    assert len(seen) == len(set(seen)) == df.count()
    calls, first = [], media.MediaReader._member

    def flaky(fs, path, info):
        calls.append(info.filename)
        if len(calls) % 2:
            raise OSError("read failed")
        return first(fs, path, info)

    reader._member = flaky
    assert sum(len(b) for p in parts for b in reader.read(p)) == df.count() and len(calls) == 2 * df.count()


def test_damaged_members_are_noticed(spark, tmp_path):
    media.write_archives(frame(spark, documents()[:4]).coalesce(1), str(tmp_path))
    path = next((tmp_path / "archives").glob("*.zip"))
    raw = bytearray(path.read_bytes())
    raw[120] ^= 255
    path.write_bytes(raw)
    reader = media.MediaReader({"folder": f"{tmp_path}/archives", "attempts": "2"})
    with pytest.raises(Exception, match="damaged"):
        [b for p in reader.partitions() for b in reader.read(p)]


# --- nearest neighbours -----------------------------------------------------------------------------------------


def vectors(n=1500, d=24, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) * draw.uniform(0.5, 1.5, (n, 1))
    x[100:400] = x[100]  # many copies of one vector
    rows = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]
    rows[5] = (5, None, 0)
    rows[6] = (6, [0.0] * d, 0)
    rows[7] = (7, [1.0] * (d - 1) + [float("nan")], 0)
    rows[8] = (8, [1.0] * (d - 1) + [float("inf")], 0)
    rows[9] = (9, [1.0] * (d - 1) + [None], 0)
    rows[10] = (None, rows[11][1], 0)
    rows[12] = (12, [1.0], 0)
    return rows


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def test_neighbours_recall_and_ties(spark):
    rows = vectors()
    got = defaultdict(list)
    for r in ann.nearest_neighbours(spark.createDataFrame(rows, EMBEDDINGS).selectExpr("*", "1 AS v", "2 AS q", "3 AS shard")).collect():
        got[r.query_id].append(r)
    used = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and i not in (5, 6, 7, 8, 9, 12)]
    ids, x = np.array([i for i, _ in used]), np.stack([v for _, v in used])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, own in got.items():
        own.sort(key=lambda r: r.rank)
        scores = (x * x[ids == q][0]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == pytest.approx(scores[ids == r.vec_id][0], abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({int(ids[k]) for k in order} & {r.vec_id for r in own})
    assert hits / (20 * len(got)) >= 0.95


def exact_neighbours(rows, k=20):
    """(query, rank, id) by all inner products, ties to smaller ids; of integers, so no rounding."""
    out = []
    for q, v in rows:
        if q % 20 == 0:
            order = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out += [(q, n + 1, i) for n, (_, i) in enumerate(order[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [1 << 16, 40])
def test_neighbours_ties_go_to_smaller_ids(spark, shard_rows):
    draw = np.random.default_rng(6)
    rows = [(i, [1.0, *map(float, draw.integers(-3, 4, 5))] if i % 20 else [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]
    table = spark.createDataFrame([(i, v, 0) for i, v in draw.permutation(np.array(rows, object)).tolist()], EMBEDDINGS)
    got = ann.nearest_neighbours(table, shard_rows=shard_rows, query_rows=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == exact_neighbours(rows)


def test_recall_of_the_table_scan_over_blocks():
    """Normally distributed vectors, the hardest kind, by the sizes that production blocks have."""
    draw = np.random.default_rng(12)
    for n, d in ((16_384, 64), (65_536, 64), (16_384, 256)):
        x = draw.normal(size=(n, d)).astype(np.float32)
        book = ann.fit(x[:4096])
        codes = ann.packed_codes(ann.encode(x, book))
        queries = draw.normal(size=(40, d))
        k = round(ann.RERANK * max(1.0, n / ann.RERANK_OF) ** 0.25)
        hits = sum(len(set(rows.tolist()) & set(np.argsort(-(x @ queries[q]))[:20].tolist())) for q, rows, _ in ann.scan(queries, codes, np.arange(n), book, k))
        print(n, d, k, hits / 800)
        assert hits / 800 >= 0.95


def test_few_or_no_vectors(spark):
    few = ann.nearest_neighbours(spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(20, 26)], EMBEDDINGS)).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few)] == [(1, 25), (2, 24), (3, 23), (4, 22), (5, 21)]
    assert ann.nearest_neighbours(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([(20, [1.0], 0)], EMBEDDINGS)).count() == 0


def test_tables_hold_the_inner_product_of_centres():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(300, 7))
    book = ann.fit(x)
    codes = ann.encode(x, book)
    near = np.stack([book.centres[m][codes[:, m]] for m in range(4)], axis=1).reshape(300, 8)[:, :7]
    packed = ann.packed_codes(codes)
    table = ann.tables(x[:5], book)
    scores = sum(table[m][packed[:, m]] for m in range(packed.shape[1]))
    assert np.allclose(scores, near @ x[:5].T, atol=1e-4)
    plain = ann.encode(x, book._replace(eta=1.0))
    parallel = lambda c: ((((x - np.stack([book.centres[m][c[:, m]] for m in range(4)], axis=1).reshape(300, 8)[:, :7]) * x).sum(axis=1)) ** 2).mean()
    assert parallel(codes) <= parallel(plain)


# --- licenses ---------------------------------------------------------------------------------------------------


def test_license_scan_equals_brute_force(spark):
    rows = documents()
    notices = license_scan.NOTICES
    mit, gpl = notices["MIT"][2], notices["GPL-3.0"][1]
    words = gpl.split()
    words[7] = "shall"
    rows += [(200, f"{rows[1][1]} {mit} {rows[2][1]}", "en", "s", 1), (201, f"# {' '.join(words)}", "en", "s", 1), (202, " ".join(mit.split()[:8]), "en", "s", 1), (203, "LICENSED under the apache license, version 2.0", "en", "s", 1), (204, ("x y z " * 30_000) + mit, "en", "s", 1), (None, notices["CC-BY-NC-4.0"][0], None, None, None)]
    got = {(r.doc_id, r.license) for r in license_scan.license_scan(frame(spark, rows, extra=True)).collect()}
    want = set()
    for d, t, *_ in rows:
        own = set(license_scan.shingles_of(license_scan.words_of((t or "").encode())))
        for name, texts in notices.items():
            for text in texts:
                shingles = set(license_scan.shingles_of(license_scan.words_of(text.encode())))
                if len(own & shingles) >= 0.8 * len(shingles):
                    want.add((d, name))
    assert got == want and {(200, "MIT"), (201, "GPL-3.0"), (203, "Apache-2.0"), (204, "MIT"), (None, "CC-BY-NC-4.0")} <= got and 202 not in {d for d, _ in got}


@pytest.mark.parametrize("kind", KINDS)
def test_license_scan_of_odd_rows(spark, kind):
    assert license_scan.license_scan(frame(spark, odd(kind))).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------------------

WEIGHTS = {"idiot": 6.0, "blor*": 5.0}


def test_clauses_not_words():
    score = lambda t: toxicity.clause_scores(t, WEIGHTS)[0]
    assert score("the weather is fine") == 0
    assert score("you are an idiot") > score("an idiot") > score("not an idiot") > 0
    assert score("he said an idiot was here") < score("an idiot was here")
    assert score("blorfish") == 5.0 and score("blor") == 0
    assert score("I will kill you") > 0 and score("I will kill time") == 0
    assert toxicity.clause_scores("idiot. idiot, idiot", WEIGHTS)[1] == 3


def test_quotations_and_reports_count():
    score = lambda t: toxicity.clause_scores(t, WEIGHTS)[0]
    assert score('Ann wrote "an idiot was here. an idiot" again') == 6.0 and score('an "idiot" was here') == 4.5
    assert score('"what an idiot," said Ann') < score("what an idiot")
    assert score("what an idiot, Ann said") == 3.0 and score("what an idiot. Ann said") == 6.0
    assert score("an idiot like you") == score("you are an idiot") == 7.5
    assert score("not an idiot\nan idiot") == 9.0 and score("do not kill you") == 0.5


def test_lines_without_entries_may_be_skipped():
    draw = np.random.default_rng(4)
    pieces = ["idiot", "Idiots", "blorp", "xblorp", "x_blorp", "kill", "killer", "you", "not", "said", "a", "'", "\"", ",", ".", "\n", " ", " ", " ", "é", "don't"]
    reader = toxicity.Reader(WEIGHTS)
    for _ in range(500):
        text = "".join(draw.choice(pieces, 30))
        want = [0.0, 0]
        for line in text.lower().split("\n"):
            found = [toxicity.word_class(t, WEIGHTS) for t in toxicity.TOKEN.findall(line)]
            score, n = grammar.line_scores([c for c, _ in found], [w for _, w in found])
            want = [want[0] + score, want[1] + n]
        assert list(reader.scores(text)) == pytest.approx(want)


def test_composition_equals_each_machine_by_itself():
    """All machines walked one by one over random classes, their factors multiplied place by place."""
    draw = np.random.default_rng(21)
    forwards, backwards = grammar.machines()
    for _ in range(400):
        classes = draw.choice(10, int(draw.integers(1, 25)), p=[0.3, 0.2, 0.08, 0.1, 0.08, 0.08, 0.07, 0.05, 0.04, 0.0]).tolist()
        weights = [round(float(w), 3) if c == grammar.O else 0.0 for c, w in zip(classes, draw.uniform(1, 6, len(classes)))]
        factor, gives = [1.0] * len(classes), [0] * len(classes)
        for machine, order in [*[(m, range(len(classes))) for m in forwards], *[(m, range(len(classes) - 1, -1, -1)) for m in backwards]]:
            state = machine.start
            for i in order:
                state, own, given = machine.arcs[state, classes[i]]
                factor[i] *= own
                gives[i] = max(gives[i], given)
        values = [f * (w if g == grammar.OFFENCE else 1.0) if g else 0.0 for f, g, w in zip(factor, gives, weights)]
        clauses = [[]]
        for c, v in zip(classes, values):
            clauses.append([]) if c in (grammar.C, grammar.S) else clauses[-1].append(v)
        got = grammar.line_scores(classes, weights)
        assert got[0] == pytest.approx(sum(values)) and got[1] == sum(sum(c) > 0 for c in clauses)


def test_short_texts_and_both_labels_teach(spark):
    docs, labels = [], []
    for d in range(400):
        toxic = d % 3 == 0
        docs.append((d, f"{'zorgel' if toxic else 'friend'} {'abcdefghijklmnop'[d % 16]}{d}", "en", "s", 1))
        labels.append((d, 1, int(toxic)))
    schema = "doc_id long, quality int, toxic int"
    learnt = toxicity.learn(frame(spark, docs), spark.createDataFrame(labels, schema))
    assert "zorgel" in learnt.weights
    found = toxicity.score_toxicity(frame(spark, docs), learnt).collect()
    assert {r.doc_id for r in found if r.predicted} == {d for d, _, t in labels if t}


def toxic_rows(n=600):
    rows, labels = [], []
    for d, t, *rest in documents(seed=9, n=n):
        toxic = d % 6 == 0
        rows.append((d, f"{t or 'text'} {'what a zorgel you are, vexitan and vexomir' if toxic else 'what a fine day'}", *rest))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_learnt_grammar_separates_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows, extra=True)
    marked = spark.createDataFrame([*labels, (None, 0, 1), (10_000, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(docs, marked)
    assert grammar.weights and grammar.bias < 0
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, grammar).collect()}
    assert len(got) == len(rows)
    for d, _, toxic in labels:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d].score <= 1
        assert got[d].predicted == toxic == int(got[d].score >= 0.5)
    assert {r.doc_id for r in toxicity.drop_toxic(docs, grammar).collect()} == {d for d, _, t in labels if not t}


def test_held_out_labels_are_not_used(spark):
    rows, labels = toxic_rows(200)
    docs = frame(spark, rows)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    assert toxicity.learn(docs, spark.createDataFrame(labels, schema)) == toxicity.learn(docs, spark.createDataFrame(flipped, schema))


@pytest.mark.parametrize("kind", KINDS)
def test_toxicity_of_odd_rows(spark, kind):
    docs = frame(spark, odd(kind))
    for labels in ([], [(d, 1, d % 2) for d in range(30)]):
        grammar = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = toxicity.score_toxicity(docs, grammar).collect()
        assert len(got) == len(odd(kind)) and all(r.score is not None for r in got)
