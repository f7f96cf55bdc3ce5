"""Approximate nearest neighbours by largest inner product: score-aware anisotropic quantisation.

A vector is quantised in pairs of dimensions with 16 centres each, four bits a pair. Centres and
codes minimise a loss that weighs the part of the residual parallel to the vector more than the rest:
for a query with a large inner product it is the parallel error that moves the score. A search scans the
codes through tables (two codes, one byte, one look-up in a table of 256 sums), and the best by table are
reranked by exact inner products in double precision.

Centres are fitted on a bounded sample. Every row is encoded and searched, in blocks: codes are dealt by
hash to shards of a bounded size, queries to groups of a bounded size, and each (query group,
shard) is a task; vectors themselves are not replicated. Of all shards' best by table each query keeps
``rerank`` vectors for each 16,384, growing with the fourth root of their number, which holds the recall of normally
distributed vectors; only these are fetched. Equal vectors are searched as one; of their rows those with the least ids, as many
as the answer can hold, take its place in the result.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows with a null vec_id; rows with one vec_id are rows of their own, and a query
for each different vector among them; ties go to smaller ids; an empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.runtime import cut, hot_join

SAMPLE = 16_384
#: Distinct vectors that a task scans, and queries that it scans them for.
SHARD_ROWS, QUERY_ROWS = 65_536, 4_096
#: Vectors reranked for a query: RERANK among RERANK_OF, more in proportion to the fourth root of their number.
RERANK, RERANK_OF = 400, 16_384
#: Queries whose vectors are reranked at once.
TOGETHER = 64
#: The inner product, as a share of the vectors' length, from which scores matter: sets the weight of parallel error.
THRESHOLD = 0.2
CENTRES = 16
SLICE = 128


class Codebook(NamedTuple):
    centres: np.ndarray  # pairs of dimensions x 16 x 2
    eta: float
    dimensions: int


def _pairs(x: np.ndarray) -> np.ndarray:
    """Vectors as pairs of dimensions; an odd last dimension is paired with zero."""
    if x.shape[1] % 2:
        x = np.pad(x, ((0, 0), (0, 1)))
    return x.reshape(len(x), -1, 2)


def encode(x: np.ndarray, book: Codebook, passes: int = 2) -> np.ndarray:
    """Codes that minimise |r|^2 + (eta - 1) (r . x)^2 / |x|^2, a pair at a time with the others held."""
    p = _pairs(x.astype(np.float64))
    norm = np.maximum((p**2).sum(axis=(1, 2)), 1e-30)
    codes = np.zeros(p.shape[:2], np.uint8)
    parallel = np.zeros(p.shape[:2])
    for m in range(p.shape[1]):
        codes[:, m] = ((p[:, m, None] - book.centres[m]) ** 2).sum(axis=2).argmin(axis=1)
        parallel[:, m] = ((p[:, m] - book.centres[m][codes[:, m]]) * p[:, m]).sum(axis=1)
    total = parallel.sum(axis=1)
    for _ in range(passes):
        for m in range(p.shape[1]):
            residual = p[:, m, None] - book.centres[m]
            own = (residual * p[:, m, None]).sum(axis=2)
            loss = (residual**2).sum(axis=2) + (book.eta - 1) * ((total - parallel[:, m])[:, None] + own) ** 2 / norm[:, None]
            codes[:, m] = loss.argmin(axis=1)
            now = np.take_along_axis(own, codes[:, m, None].astype(np.int64), axis=1)[:, 0]
            total += now - parallel[:, m]
            parallel[:, m] = now
    return codes


def fit(sample: np.ndarray, rounds: int = 6, threshold: float = THRESHOLD, seed: int = 5) -> Codebook:
    """Alternates assigning codes and solving for centres under the same loss."""
    draw = np.random.default_rng(seed)
    n, d = sample.shape
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    p = _pairs(sample.astype(np.float64))
    norm = np.maximum((p**2).sum(axis=(1, 2)), 1e-30)
    centres = np.stack([p[draw.choice(n, CENTRES, replace=n < CENTRES), m] for m in range(p.shape[1])])
    book = Codebook(centres, 1.0, d)
    for step in range(rounds):
        codes = encode(sample, book, passes=1 if step else 0)
        residuals = p - np.take_along_axis(book.centres[None].repeat(1, 0)[0], codes.T[:, :, None].astype(np.int64), axis=1).transpose(1, 0, 2)
        parallel = (residuals * p).sum(axis=2)
        total = parallel.sum(axis=1)
        for m in range(p.shape[1]):
            x = p[:, m]
            rest = total - parallel[:, m]
            scale = (eta - 1) / norm
            outer = x[:, :, None] * x[:, None, :] * scale[:, None, None] + np.eye(2)
            goal = x + x * (scale * (rest + (x * x).sum(axis=1)))[:, None]
            for k in range(CENTRES):
                mine = codes[:, m] == k
                if mine.any():
                    book.centres[m, k] = np.linalg.solve(outer[mine].sum(axis=0) + 1e-12 * np.eye(2), goal[mine].sum(axis=0))
        book = book._replace(eta=eta)
    return book


def packed_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def tables(queries: np.ndarray, book: Codebook) -> np.ndarray:
    """(bytes, 256, queries): the part of the inner product that a byte of two codes stands for."""
    parts = np.einsum("qmd,mkd->mkq", _pairs(queries.astype(np.float64)), book.centres).astype(np.float32)
    if len(parts) % 2:
        parts = np.concatenate([parts, np.zeros_like(parts[:1])])
    return (parts[1::2, :, None] + parts[::2, None, :]).reshape(len(parts) // 2, 256, -1)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows with the k largest scores, best first, ties to smaller ids."""
    if k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def scan(queries: np.ndarray, codes: np.ndarray, ids: np.ndarray, book: Codebook, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores): by tables the k best rows of a shard for each query."""
    for at in range(0, len(queries), SLICE):
        part = queries[at : at + SLICE].astype(np.float64)
        table = tables(part, book)
        scores = np.zeros((len(codes), len(part)), np.float32)
        for m in range(codes.shape[1]):
            scores += table[m][codes[:, m]]
        for q, own in enumerate(np.ascontiguousarray(scores.T)):
            rows = best_rows(own, ids, k)
            yield at + q, rows, own[rows]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _encoded(book: Codebook) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = packed_codes(encode(_matrix(batch.column(2)), book))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["rep", "h", "codes"])

    return rows


SCANNED = "query_id long, qh long, rep long, h long, near float"
RERANKED = "query_id long, qh long, rep long, h long, score double"


def _scanned(book: Codebook, k: int) -> Callable:
    def block(rows: pa.Table, asked: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(rows) and len(asked):
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(rows), -1)
            rep, h = rows.column("rep").to_numpy(), rows.column("h").to_numpy()
            query_id, qh = asked.column("query_id").to_numpy(), asked.column("qh").to_numpy()
            for q, found, near in scan(_matrix(asked.column("q")), codes, rep, book, k):
                for column, values in zip(columns, (np.full(len(found), query_id[q]), np.full(len(found), qh[q]), rep[found], h[found], near), strict=True):
                    column.append(values)
        kinds = [np.int64] * 4 + [np.float32]
        return pa.table([np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(columns, kinds, strict=True)], names=["query_id", "qh", "rep", "h", "near"])

    return block


def _reranked(k: int) -> Callable:
    """Cogrouped candidates with their vectors and queries -> each query's k best by the exact inner product."""

    def block(rows: pa.Table, asked: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(rows) and len(asked):
            rep, h, v = rows.column("rep").to_numpy(), rows.column("h").to_numpy(), _matrix(rows.column("v"))
            of_id, of_hash = rows.column("query_id").to_numpy(), rows.column("qh").to_numpy()
            order = np.lexsort((of_hash, of_id))
            new = np.append(True, (of_id[order[1:]] != of_id[order[:-1]]) | (of_hash[order[1:]] != of_hash[order[:-1]]))
            vectors = {(i, own): q for i, own, q in zip(asked.column("query_id").to_pylist(), asked.column("qh").to_pylist(), _matrix(asked.column("q")), strict=True)}
            for mine in np.split(order, np.flatnonzero(new)[1:]):
                i, own = int(of_id[mine[0]]), int(of_hash[mine[0]])
                score = (v[mine].astype(np.float64) * vectors[i, own]).sum(axis=1)
                best = best_rows(score, rep[mine], k)
                for column, values in zip(columns, (np.full(len(best), i), np.full(len(best), own), rep[mine[best]], h[mine[best]], score[best]), strict=True):
                    column.append(values)
        kinds = [np.int64] * 4 + [np.float64]
        return pa.table([np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(columns, kinds, strict=True)], names=["query_id", "qh", "rep", "h", "score"])

    return block


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id long, v array<float> or array<double>) of the rows that take part, and their dimension, the most frequent one."""
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"  # half the bytes to move
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def distinct_vectors(table: DataFrame, copies: int) -> DataFrame:
    """(rep, h, vec_id, v, n): for each different vector its ``copies`` rows with the least ids, numbered by n; rep is the
    least id. The limit is applied before the shuffle, so a vector of any number of rows fills no task."""
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    few = table.select("vec_id", "v", F.xxhash64("v").alias("h")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= copies)
    return cut(few.withColumn("rep", F.first("vec_id").over(same)).select("rep", "h", "vec_id", "v", "n"))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` (query_id, q) the k nearest rows of ``table`` (vec_id, v)
    found, without the row of the query's own id."""
    spark = table.sparkSession
    every = distinct_vectors(table, k + 1)
    reps = every.where("n = 1").select("rep", "h", "v")
    n = reps.count()
    asked = cut(queries.select("query_id", "q", F.xxhash64("q").alias("qh")).dropDuplicates(["query_id", "qh"]))
    n_queries = asked.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a bounded sample, by hash, a little larger than asked for and then cut
    share = min(1.0, 1.1 * sample / n)
    chosen = reps.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).select("v").toArrow()
    chosen = _matrix(chosen.column("v")) if len(chosen) else _matrix(reps.limit(sample).select("v").toArrow().column("v"))
    book = fit(chosen)
    wanted = max(k + 1, round(rerank * max(1.0, n / RERANK_OF) ** 0.25))
    shards, groups = -(-n // shard_rows), -(-n_queries // query_rows)
    rows = reps.mapInArrow(_encoded(book), "rep long, h long, codes binary").withColumn("shard", F.pmod(F.xxhash64("rep", "h"), F.lit(shards)).cast("int"))
    rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    group = F.pmod(F.xxhash64("query_id", "qh", F.lit(1)), F.lit(groups)).cast("int")
    meets = asked.withColumn("group", group).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = rows.groupBy("shard", "group").cogroup(meets.groupBy("shard", "group")).applyInArrow(_scanned(book, wanted), SCANNED)
    if shards > 1:
        by_table = Window.partitionBy("query_id", "qh").orderBy(F.col("near").desc(), "rep", "h")
        found = found.withColumn("place", F.row_number().over(by_table)).where(F.col("place") <= wanted)
    found = cut(found.select("query_id", "qh", F.struct("rep", "h").alias("key")))
    fetched = reps.select(F.struct("rep", "h").alias("key"), "v").join(found.groupBy("key").agg(F.count("key").alias("uses")), "key")
    bucket = F.pmod(F.xxhash64("query_id", "qh", F.lit(2)), F.lit(-(-n_queries // TOGETHER))).cast("int").alias("bucket")
    with_vectors = hot_join(found, fetched, "key", "uses", found.count()).select("query_id", "qh", "key.rep", "key.h", "v", bucket)
    exact = with_vectors.groupBy("bucket").cogroup(asked.select("*", bucket).groupBy("bucket")).applyInArrow(_reranked(k + 1), RERANKED)
    # the first k + 1 vectors hold the first k rows: each of them gives a row before those of the next
    ids = every.groupBy("rep", "h").agg(F.collect_list("vec_id").alias("ids")).where("size(ids) > 1")
    each = exact.join(ids, ["rep", "h"], "left").select("query_id", "qh", "score", F.explode(F.coalesce("ids", F.array("rep"))).alias("vec_id")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, **options) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``, among all rows but its own."""
    rows, _ = usable(embeddings)
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return nearest(rows, queries, k, **options)
