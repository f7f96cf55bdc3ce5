"""Lexicon joins: normalised means, synonym overlap, keyness, keyword shares, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalised_mean(words: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, score): the mean of the values of a document's words, scaled by the lexicon's least and largest; null
    where nothing is found or the sum is not positive. The first of repeated lexicon words counts."""
    first = lexicon.groupBy("word").agg(F.min_by("value", "line").alias("value"))
    bounds = lexicon.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    means = words.join(first, "word").groupBy(key).agg(F.sum("value").alias("s"), F.avg("value").alias("m"))
    span = F.lit(float((bounds["hi"] or 0) - (bounds["lo"] or 0)))
    score = F.when(F.col("s") > 0, F.coalesce(F.try_divide(F.col("m") - F.lit(float(bounds["lo"] or 0)), span), F.lit(0.0)))
    return words.select(key).distinct().join(means, key, "left").select(key, score.alias("score"))


def synonym_overlap(words: DataFrame, synonyms: DataFrame, counts: DataFrame, doc: str = "doc_id", seg: str = "seg") -> DataFrame:
    """(doc, syn_overlap): for each distinct word of a segment the tokens of the next whose synonyms hold it, by
    segments less one. A word without an entry is its own synonym. ``words`` have a column k of occurrences in the
    segment, or are counted first."""
    counted = words if "k" in words.columns else words.groupBy(doc, seg, "word").agg(F.count("*").alias("k"))
    spread = counted.join(synonyms, "word", "left").select(doc, seg, "k", F.explode(F.array_distinct(F.coalesce("syns", F.array("word")))).alias("syn"))
    hits = spread.groupBy(doc, seg, "syn").agg(F.sum("k").alias("k")).select(doc, (F.col(seg) - 1).alias(seg), F.col("syn").alias("word"), "k")
    found = counted.select(doc, seg, "word").join(hits, [doc, seg, "word"]).groupBy(doc).agg(F.sum("k").alias("k"))
    joined = counts.join(found, doc, "left")
    return joined.select(doc, F.when(F.col("n_segments") < 2, F.lit(0.0)).otherwise(F.coalesce("k", F.lit(0)) / F.greatest(F.col("n_segments") - 1, F.lit(1))).alias("syn_overlap"))


PLACEHOLDERS = ("x x", "x x x", "x x x x")


def keyness(items: DataFrame, reference: DataFrame, share: float = 0.1, key: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """(key, item, diff, tf, rank): a document's items of frequency two and more by their difference in per cent from the
    reference (per million; a million where it has none), cut at a share of its distinct items. All-placeholder
    n-grams go after the cut. ``key`` may be several columns, those that the reference has too (a family) among them; ``items``
    have a column k of occurrences, or are counted first. Totals come from a window over the key's counted
    items, no join of the table with itself; a reference of bounded size is broadcast by the optimizer."""
    keys = [key] if isinstance(key, str) else list(key)
    counted = items.select(*keys, "item", F.col("k").alias("n")) if "k" in items.columns else items.groupBy(*keys, "item").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*keys)
    sized = counted.withColumn("total", F.sum("n").over(own)).withColumn("types", F.count("*").over(own))
    both = [c for c in keys if c in reference.columns]
    ref = reference.select(F.col("item").alias("ref"), "per_million", *[F.col(c).alias(f"__{c}") for c in both])
    met = F.lower("item") == F.col("ref")
    for c in both:
        met = met & (F.col(c) == F.col(f"__{c}"))
    scored = sized.where((F.col("n") >= 2) & (F.col("item") != "")).withColumn("tf", F.col("n") / F.col("total")).join(ref, met, "left")
    rate = F.col("per_million") / 1_000_000
    diff = F.when(F.col("per_million").isNull(), F.lit(1_000_000.0)).otherwise((F.col("tf") - rate) * 100 / rate)
    ranked = scored.withColumn("diff", diff).withColumn("rank", F.row_number().over(own.orderBy(F.col("diff").desc(), F.col("tf").desc(), "item")))
    return ranked.where((F.col("rank") <= F.floor(F.col("types") * share)) & ~F.col("item").isin(*PLACEHOLDERS)).select(*keys, "item", "diff", "tf", "rank")


def keyness_simple(items: DataFrame, reference: DataFrame, share: float = 0.1, key: str = "doc_id") -> DataFrame:
    """(key, item, score, rank): a document's distinct items that the reference has, by its frequency; the first share."""
    found = items.select(key, "item").distinct().join(reference, "item")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("per_million").desc(), "item"))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return ranked.where(F.col("rank") <= F.floor(F.col("n") * share)).select(key, "item", F.col("per_million").alias("score"), "rank")


def keyword_share(words: DataFrame, keywords: DataFrame, key: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """(key, share, odds): of a document's words (or items, ``word`` or ``item``) those among its own keywords, by all and by the
    others. ``key`` may be several columns; a column k says how often a word stands there."""
    keys = [key] if isinstance(key, str) else list(key)
    name = "word" if "word" in words.columns else "item"
    marked = words.join(keywords.select(*keys, name).distinct().withColumn("hit", F.lit(1)), [*keys, name], "left")
    k = F.col("k") if "k" in words.columns else F.lit(1)
    n, hits = F.sum(k), F.sum(F.when(F.col("hit") == 1, k).otherwise(0))
    return marked.groupBy(*keys).agg((hits / n).alias("share"), F.coalesce(F.try_divide(hits.cast("double"), (n - hits).cast("double")), F.lit(0.0)).alias("odds"))


def contexts(targets: DataFrame, sentences: DataFrame, limit: int = 512, seed: int = 42) -> DataFrame:
    """(word, sentence_id): sentences that hold a word between spaces, at most ``limit`` a word, chosen by hash. An
    equi-join on the sentence's words, not a scan of all pairs."""
    spread = sentences.select("sentence_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    found = spread.join(targets.select("word").distinct(), "word")
    order = Window.partitionBy("word").orderBy(F.xxhash64("sentence_id", F.lit(seed)), "sentence_id")
    # the limit is taken in every task before the shuffle too, so a common word's sentences never meet in one
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("word", "sentence_id")


def proportion(target: Column, ref: Column, kind: str) -> Column:
    """Word or character counts of one array by the other's."""
    size = (lambda a: F.size(a).cast("double")) if kind == "word" else (lambda a: F.length(F.array_join(a, "")).cast("double"))
    return F.coalesce(F.try_divide(size(target), size(ref)), F.lit(0.0))
