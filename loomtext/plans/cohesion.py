"""All indices of a table or a folder of texts, by options: the entry point that joins readers, families, lexicons, sources and sinks.

Families that need no lexicon come from one pass over the texts; each of the others looks up words in its lexicon, and is made only
if asked for. Texts that several families read are annotated once (``held.py``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import annotate as A
from loomtext.operators import indices as I
from loomtext.operators import metrics as M
from loomtext.operators import similarity as V
from loomtext.operators import synonyms as Y
from loomtext.operators.held import hold
from loomtext.operators.keywords import keyword_shares
from loomtext.shared import fresh_dir
from loomtext.sources import io

PLAIN = ("diversity", "overlap", "connectives", "givenness")
SPACES = {"lsa": "cosine", "lda": "divergence", "word2vec": "cosine"}
FAMILIES = (*PLAIN, "synonyms", *SPACES, "source_keywords", "source_similarity")
SEGMENTS = {"sent": "nsents", "para": "nparas"}
SYNONYM_TAGS = {"noun": I.NOUN_TAGS, "verb": I.VERB_TAGS}


class Lexicons(NamedTuple):
    """What the families look up; a family whose lexicon is missing cannot be asked for."""

    synonyms: DataFrame | None = None  # (word, syns)
    lsa: DataFrame | None = None  # (word, vec)
    lda: DataFrame | None = None
    word2vec: DataFrame | None = None
    references: DataFrame | None = None  # (family, item, per_million)
    adjectives: tuple[str, ...] = ()
    dims: int = 300


def side_by_side(parts: list[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "left")
    return out


def segments(docs: DataFrame, level: str, key: str = "doc_id") -> DataFrame:
    return M.basic_counts(docs, key).select(key, F.col(SEGMENTS[level]).alias("n_segments"))


def synonym_indices(docs: DataFrame, synonyms: DataFrame, key: str = "doc_id") -> DataFrame:
    """The four synonym indices: sentences and paragraphs, nouns and verbs."""
    return Y.synonym_overlaps(docs, synonyms, SYNONYM_TAGS, key)


def vector_indices(docs: DataFrame, vectors: DataFrame, spaces: tuple[str, ...], key: str = "doc_id", dims: int = 300, levels: tuple[str, ...] = tuple(SEGMENTS)) -> DataFrame:
    """The similarity of a segment to the next one and the next two, for each level, for spaces that share their vectors: one pass over
    the texts; with a lexicon too large for a task by joins, a level's sums being made once."""
    known = V.lookup(vectors, dims)
    if known is not None:
        return I.indices(docs, {"vectors": V.adjacent_family(known, {s: SPACES[s] for s in spaces}, levels, dims)}, key=key)
    parts = []
    for level in levels:
        sums = V.segment_sums(I.segment_words(docs, level, key=key), vectors, [key, "seg"])
        counts = segments(docs, level, key)
        for space in spaces:
            for width in (1, 2):
                found = V.adjacent_similarity(sums, counts, key, "seg", width, SPACES[space], dims)
                parts.append(found.withColumnRenamed("similarity", f"{space}_{width}_all_{level}"))
    return side_by_side(parts, key)


def source_keywords(docs: DataFrame, sources: DataFrame, references: DataFrame, key: str = "doc_id", share: float = 0.1) -> DataFrame:
    """The 23 keyword shares of texts whose sources are (key, text): of a text's items those that are keywords of its source."""
    return keyword_shares(docs, sources, references, key, share)


def source_similarity(docs: DataFrame, sources: DataFrame, spaces: dict[str, DataFrame], key: str = "doc_id", dims: int = 300) -> DataFrame:
    """Whole texts against their sources in each space."""
    parts = [I.keys_of(docs, key)]
    shared: dict[int, tuple[DataFrame, list[str]]] = {}
    for space, vectors in spaces.items():
        shared.setdefault(id(vectors), (vectors, []))[1].append(space)
    for vectors, names in shared.values():
        known = V.lookup(vectors, dims)
        own, other = (V.text_sums(t, known, key) if known is not None else V.segment_sums(I.segment_words(t, "doc", key=key).drop("seg"), vectors, [key]) for t in (docs, sources))
        parts.append(V.text_similarities(own, other, key, {f"source_similarity_{s}": SPACES[s] for s in names}, dims))
    return side_by_side(parts, key).select(key, *[f"source_similarity_{s}" for s in spaces])


def process_texts(docs: DataFrame, lexicons: Lexicons = Lexicons(), families: tuple[str, ...] = PLAIN, sources: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) or held texts -> one row a text: status and the indices of the families. A text of fewer than two words has a status and
    no indices, a null text likewise."""
    if unknown := set(families) - set(FAMILIES):
        raise ValueError(f"families are {', '.join(FAMILIES)}; got {', '.join(sorted(unknown))}")
    if "flat" not in docs.columns:
        docs = docs.select(key, "text")
        docs = hold(docs, key) if set(families) - set(PLAIN) else docs
    more, parts = {}, []
    if "synonyms" in families:
        synonyms = _given(lexicons.synonyms, "synonyms")
        known = Y.lookup(synonyms)
        if known is not None:
            more["synonyms"] = Y.overlap_family(known, SYNONYM_TAGS)
        else:
            parts.append(synonym_indices(docs, synonyms, key))
    shared: dict[int, tuple[DataFrame, list[str]]] = {}
    for s in SPACES:
        if s in families:
            vectors = _given(getattr(lexicons, s), s)
            shared.setdefault(id(vectors), (vectors, []))[1].append(s)
    for vectors, own in shared.values():
        known = V.lookup(vectors, lexicons.dims)
        if known is not None:
            more[",".join(own)] = V.adjacent_family(known, {s: SPACES[s] for s in own}, tuple(SEGMENTS), lexicons.dims)
        else:
            parts.append(vector_indices(docs, vectors, tuple(own), key, lexicons.dims))
    parts.insert(0, M.all_families(docs, tuple(f for f in PLAIN if f in families), list(lexicons.adjectives), key, more))
    if "source_keywords" in families:
        parts.append(source_keywords(docs, _given(sources, "sources"), _given(lexicons.references, "references"), key))
    if "source_similarity" in families:
        known = {s: getattr(lexicons, s) for s in SPACES if getattr(lexicons, s) is not None}
        parts.append(source_similarity(docs, _given(sources, "sources"), known, key, lexicons.dims))
    wide = side_by_side(parts, key)
    return wide.select(key, "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in wide.columns if c not in (key, "status")])


def _given(table: DataFrame | None, name: str) -> DataFrame:
    if table is None:
        raise ValueError(f"this family needs {name}")
    return table


def run_folder(spark: SparkSession, indir: str, outdir: str | None = None, lexicons: Lexicons = Lexicons(), families: tuple[str, ...] = PLAIN, source: str | None = None, tagged: bool = False, counts: bool = False, spread: int | None = None, groups: int = 1, compression: str | None = None, consume: bool = False) -> DataFrame:
    """Every text file of a folder -> a CSV of indices by filename under ``outdir``, read back; on demand the tagged tokens and
    the basic counts beside it. ``source`` is a file to which all texts are compared. Files in ``spread`` sub-folders are
    listed by the tasks, those of a plain folder by the driver.

    Sub-folders may be taken in ``groups``, one after the other; with ``consume`` a group's texts are removed once all is written that was asked
    of them. ``compression`` (gzip, for instance) is that of the tagged tokens, about ten times the size of the texts without it."""
    if spread is None and (groups > 1 or consume):
        raise ValueError("only files in sub-folders can be taken in groups or consumed")
    out = outdir or fresh_dir(spark, "indices")
    text = io.read_folder(spark, source).select(F.col("text").alias("t")) if source is not None else None
    for group in range(groups):
        parts = None if spread is None else range(spread * group // groups, spread * (group + 1) // groups)
        docs = io.read_folder(spark, indir) if parts is None else io.read_spread(spark, indir, parts)
        sources = None
        if text is not None:
            sources = docs.select("filename").join(F.broadcast(text), F.lit(True)).select("filename", F.col("t").alias("text"))  # one row
        found = process_texts(docs, lexicons, families, sources, "filename").withColumnRenamed("filename", "Filename")
        mode = "append" if group else "overwrite"
        io.write_csv(found, f"{out}/results", mode)
        if tagged:
            io.write_csv(A.tagged_table(A.annotate(docs), M.class_conditions(list(lexicons.adjectives)), "filename"), f"{out}/tagged", mode, compression)
        if counts:
            io.write_csv(M.basic_counts(docs, "filename"), f"{out}/counts", mode)
        if consume:
            io.remove_spread(spark, indir, parts)
    return io.read_csv(spark, f"{out}/results", found.schema)
