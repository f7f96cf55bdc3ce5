from pyspark.sql import functions as F

from loomtext.operators import indices as I
from loomtext.operators import lexicon as L
from loomtext.plans import cohesion as CO

TEXTS = ["A cat sees dogs. Felines see dogs and cats cat. Nothing.\nCats run. A feline runs", "one two", "", None, "dogs. dogs dogs. dogs"]


def test_synonyms_shuffle_the_words_of_portions_only(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    lexicon = spark.createDataFrame([("feline", ["cat", "cat", "feline"]), ("feline", ["cat"]), ("dog", ["cat"]), ("cat", None), ("nothing", [None, "dog"])], "word string, syns array<string>")
    found = CO.synonym_indices(docs, lexicon)
    assert found.columns == ["doc_id", "syn_overlap_sent_noun", "syn_overlap_sent_verb", "syn_overlap_para_noun", "syn_overlap_para_verb"]
    for level in ("sent", "para"):
        for c, tags in CO.SYNONYM_TAGS.items():
            joined = L.synonym_overlap(I.segment_words(docs, level, tags), lexicon, CO.segments(docs, level))
            want = {r.doc_id: r.syn_overlap for r in joined.collect()}
            assert {r.doc_id: r[f"syn_overlap_{level}_{c}"] for r in found.collect()} == want and (c == "verb" or want[0] > 0)
    words = spark.range(4000).select((F.col("id") % 7).alias("doc_id"), F.lit("cats dogs. cats dogs.").alias("text")).groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    plan = CO.synonym_indices(words, lexicon)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 2 and "Window" not in plan
