"""Vector similarity of adjacent segments and of whole texts: cosine of summed word vectors, and the divergence index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators import indices as I
from loomtext.operators.joins import frequent_join


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero or null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(squares(a)) * F.sqrt(squares(b))
    return F.when(norm != 0, dot / norm)


def squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


#: Words, at most, whose vectors are broadcast because they stand in many segments.
FREQUENT = 1_000


def segment_sums(words: DataFrame, vectors: DataFrame, keys: list[str], frequent: DataFrame | None = None) -> DataFrame:
    """(keys, n, sums array): the sum of the vectors of a segment's words; words without a vector are left out.

    ``words`` have a column k of occurrences in the segment, or are counted first. They meet their vectors in an equi-join on the
    word; the vectors of the ``frequent`` words, the FREQUENT with most rows if not given, are broadcast, so that a
    word of every segment fills no task. Sums are partial before the shuffle."""
    counted = words if "k" in words.columns else words.groupBy(*keys, "word").agg(F.count("*").alias("k"))
    if frequent is None:
        frequent = counted.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(FREQUENT).select("word")
    hits = frequent_join(counted.select(*keys, "word", "k"), vectors.select("word", array_to_vector("vec").alias("v")), "word", frequent)
    summed = hits.groupBy(*keys).agg(F.sum("k").alias("n"), Summarizer.metrics("sum").summary(F.col("v"), F.col("k").cast("double")).alias("s"))
    return summed.select(*keys, "n", vector_to_array("s.sum").alias("sums"))


def divergence_index(s1: Column, n1: Column, s2: Column, n2: Column, dims: int = 300) -> Column:
    """The topic index in closed form: each side's profile is its positions over the L1 norm of its mean vector, so only
    the norms matter. Null where it would be negative."""
    def scale(s: Column, n: Column) -> Column:
        norm = F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.abs(x)), n)
        return F.when(F.coalesce(norm, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.lit(1.0) / norm)

    a, b = scale(s1, n1), scale(s2, n2)
    total = dims * (dims - 1) / 2.0
    term = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x * F.log2(F.try_divide(2 * x, a + b)))
    index = 1.0 - 0.5 * total * (term(a) + term(b))
    return F.when(index >= 0, index)


def adjacent_similarity(sums: DataFrame, counts: DataFrame, doc: str, seg: str, width: int = 1, kind: str = "cosine", dims: int = 300) -> DataFrame:
    """(doc, similarity): the mean over adjacent segments of the similarity of one to the next one or two.

    ``counts`` (doc, n_segments) says how many segments a document has; segments without a vector are zero. Nulls
    are left out of the mean; documents with too few segments get 0."""
    every = counts.select(doc, F.col("n_segments")).where(F.col("n_segments") > 0).withColumn(seg, F.explode(F.sequence(F.lit(0), (F.col("n_segments") - 1).cast("int"))))
    full = every.join(sums, [doc, seg], "left")
    order = Window.partitionBy(doc).orderBy(seg)
    nxt, nxt2 = F.lead("sums", 1).over(order), F.lead("sums", 2).over(order)
    n1, n2 = F.lead("n", 1).over(order), F.lead("n", 2).over(order)
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    other, m = (nxt, n1) if width == 1 else (both(nxt, nxt2), F.coalesce(n1, F.lit(0)) + F.coalesce(n2, F.lit(0)))
    paired = full.withColumn("o", other).withColumn("m", m).where(F.col(seg) < F.col("n_segments") - width)
    value = cosine(F.col("sums"), F.col("o")) if kind == "cosine" else divergence_index(F.coalesce("sums", F.array()), F.col("n"), F.coalesce("o", F.array()), F.col("m"), dims)
    means = paired.groupBy(doc).agg(F.avg(value).alias("similarity"))
    return counts.select(doc).join(means, doc, "left").select(doc, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def text_similarity(targets: DataFrame, sources: DataFrame, key: str, kind: str = "cosine", dims: int = 300) -> DataFrame:
    """(key, similarity) of whole texts to their sources, both as (key, sums, n); null where there is none."""
    return text_similarities(targets, sources, key, {"similarity": kind}, dims)


def text_similarities(targets: DataFrame, sources: DataFrame, key: str, kinds: dict[str, str], dims: int = 300) -> DataFrame:
    """(key, a column for each name: kind) of whole texts to their sources, met once."""
    both = targets.select(key, F.col("sums").alias("a"), F.col("n").alias("m")).join(sources.select(key, F.col("sums").alias("b"), F.col("n").alias("k")), key)
    value = {"cosine": cosine(F.col("a"), F.col("b")), "divergence": divergence_index(F.col("a"), F.col("m"), F.col("b"), F.col("k"), dims)}
    return both.select(key, *[value[kind].alias(name) for name, kind in kinds.items()])


# --- one pass over the texts, for lexicons that fit a task ------------------------------------------------------

#: Numbers, at most, of a vector lexicon that every task may hold; larger ones meet the words in a join.
NUMBERS = 1 << 24


def lookup(vectors: DataFrame, dims: int) -> Broadcast | None:
    """The words and vectors of (word, vec) as arrays for every task, or None if they are more than ``NUMBERS``."""
    most = NUMBERS // max(dims, 1)
    table = vectors.select("word", "vec").where("word IS NOT NULL AND vec IS NOT NULL").limit(most + 1).toArrow()
    if table.num_rows > most:
        return None
    words, column = table.column("word").combine_chunks(), table.column("vec").combine_chunks()
    numbers = column.flatten().to_numpy(zero_copy_only=False).reshape(len(words), -1) if len(words) else np.zeros((0, dims))
    small = numbers.astype(np.float32)
    return vectors.sparkSession.sparkContext.broadcast((words, (small if (small == numbers).all() else numbers).T.copy()))


def _rows_of(flat: I.Flat, words: pa.Array) -> np.ndarray:
    """The line of each token's lemma in the lexicon, -1 where it has none."""
    if not len(flat.lemma):
        return np.zeros(0, np.int64)
    found = pc.index_in(pa.array(flat.words, pa.string()), value_set=words.cast(pa.string()))
    return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[flat.lemma]


def _divergences(l1: np.ndarray, n1: np.ndarray, l2: np.ndarray, n2: np.ndarray, dims: int) -> np.ndarray:
    """``divergence_index`` over arrays of L1 norms of sums and of numbers of words; nan where it would be negative."""
    a, b = (np.divide(n, norm, out=np.zeros(len(n)), where=norm != 0) for norm, n in ((l1, n1), (l2, n2)))
    term = lambda x: x * np.log2(np.divide(2 * x, a + b, out=np.ones(len(x)), where=x != 0))
    index = 1.0 - 0.5 * (dims * (dims - 1) / 2.0) * (term(a) + term(b))
    return np.where(index >= 0, index, np.nan)


def adjacent_family(known: Broadcast, spaces: dict[str, str], levels: tuple[str, ...], dims: int) -> Callable:
    """A family of indices for ``indices.indices``: ``adjacent_similarity`` of each space (name: kind), level and width, one dimension at
    a time, so that no vector of a segment is held."""

    def family(flat: I.Flat, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        words, numbers = known.value
        row = _rows_of(flat, words)
        out = {}
        for level in levels:
            of_token, bounds = (flat.sent, flat.doc_sents) if level == "sent" else (flat.para, flat.docs)
            total = int(bounds[-1])
            doc = np.repeat(np.arange(flat.n), np.diff(bounds))
            seg, at = of_token[row >= 0], row[row >= 0]
            n = np.bincount(seg, minlength=total)
            ahead = lambda x, k: np.append(x[k:], np.zeros(min(k, len(x)), x.dtype))
            size, norm = np.zeros(total), np.zeros(total)
            dot, size2, norm2 = ({w: np.zeros(total) for w in (1, 2)} for _ in range(3))
            for line in numbers:
                s = np.bincount(seg, line[at], total)
                size, norm = size + s * s, norm + np.abs(s)
                for w, o in ((1, ahead(s, 1)), (2, ahead(s, 1) + ahead(s, 2))):
                    dot[w] += s * o
                    size2[w] += o * o
                    norm2[w] += np.abs(o)
            for space, kind in spaces.items():
                for w in (1, 2):
                    m = ahead(n, 1) if w == 1 else ahead(n, 1) + ahead(n, 2)
                    pairs = np.flatnonzero(ahead(doc + 1, w) == doc + 1)
                    if kind == "cosine":
                        length = np.sqrt(size[pairs]) * np.sqrt(size2[w][pairs])
                        value = np.divide(dot[w][pairs], length, out=np.full(len(pairs), np.nan), where=length != 0)
                    else:
                        value = _divergences(norm[pairs], n[pairs], norm2[w][pairs], m[pairs], dims)
                    kept = ~np.isnan(value)
                    held = doc[pairs[kept]]
                    out[f"{space}_{w}_all_{level}"] = I.ratio(np.bincount(held, value[kept], flat.n), np.bincount(held, minlength=flat.n))
        return out

    return family


def text_sums(docs: DataFrame, known: Broadcast, key: str) -> DataFrame:
    """(key, n, sums) of whole texts, those with a word in the lexicon, as ``segment_sums`` gives them, without a shuffle."""

    def make(flat: I.Flat) -> list[tuple[np.ndarray, list[pa.Array]]]:
        words, numbers = known.value
        row = _rows_of(flat, words)
        doc, at = flat.doc[row >= 0], row[row >= 0]
        n = np.bincount(doc, minlength=flat.n)
        found = np.flatnonzero(n)
        sums = np.empty((len(found), len(numbers)))
        for j, line in enumerate(numbers):
            sums[:, j] = np.bincount(doc, line[at], flat.n)[found]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(numbers), pa.int32()), pa.array(sums.ravel()))
        return [(found, [pa.array(n[found], pa.int64()), lists])]

    return I._rows(docs, key, "n long, sums array<double>", make)
