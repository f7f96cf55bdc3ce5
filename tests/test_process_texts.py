import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from loomtext.operators import indices as I
from loomtext.operators import keywords as K
from loomtext.operators import synonyms as Y
from loomtext.operators.held import hold
from loomtext.plans import cohesion as CO
from loomtext.plans.registry import rounded
from tests.test_against_sql import VECTORS, both
from tests.test_keywords import ROWS, TEXTS
from tests.test_synonyms import TEXTS as SYNONYM_TEXTS


def test_texts_are_annotated_once(spark, tmp_path):
    got, want = both(spark, tmp_path, "q_process_texts", documents=ROWS, embeddings=VECTORS)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    plan = __spark_entry__.queries()["q_process_texts"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "documents.parquet" not in plan


def test_held_texts_give_what_texts_give(spark):
    docs = spark.createDataFrame([*[(f"t{i}", t) for i, t in enumerate(TEXTS)], ("t0", "dogs run. dogs run"), (None, "The dog. The dog")], "name string, text string")
    sources = docs.where("name IS NOT NULL").dropDuplicates(["name"]).withColumn("name", docs.name.substr(1, 2))
    references = spark.createDataFrame([("bi", "dog x", 5.0), ("bi", "dog x", 9.0), ("uni", "dog", None), ("tri", "x dog x", 0.0)], "family string, item string, per_million double")
    rows = lambda df: sorted(map(str, rounded(df).collect()))
    assert rows(CO.source_keywords(hold(docs, "name"), hold(sources, "name"), references, "name", 0.5)) == rows(CO.source_keywords(docs, sources, references, "name", 0.5))
    assert rows(I.segment_words(hold(docs, "name"), "para", key="name")) == rows(I.segment_words(docs, "para", key="name"))
    assert len(rows(CO.process_texts(docs, CO.Lexicons(references=references), ("givenness", "source_keywords"), sources, "name"))) >= docs.count()


@pytest.mark.parametrize("text", [[], [None], [[""]], [["the dogs ran. a dog", "one. dogs ran"], None, ["x"]]])
def test_frames_give_arrays_back(text):
    flat = I.flat_of_paragraphs(pa.array(text, pa.list_(pa.string())))
    if len(flat.raw):
        flat.tag = np.array([f"T{i % 3}" for i in range(len(flat.raw))])  # a tagger that looks at more than the word
    again = I.unpacked(I.packed(flat))
    for name in ("words", "raw", "lemma", "tag", "aux", "dep", "sents", "paras", "docs"):
        assert np.array_equal(getattr(again, name), getattr(flat, name)), name


def test_numbers_too_long_are_made_anew():
    draw = np.random.default_rng(3)
    texts = [[" ".join(f"w{i}" for i in draw.integers(0, 6, 80)) + ". x x w1 x x"] for _ in range(9)]
    flat = I.flat_of_paragraphs(pa.array(texts, pa.list_(pa.string())))
    short, long = K._Own(flat), K._Own(flat)
    long.most = 1 << 30
    for family in I.ITEM_FAMILIES:
        (doc, *grams), k = I._distinct(*I.grams_of(flat, family, "sent"))
        want = sorted(zip(doc[k >= 2].tolist(), k[k >= 2].tolist(), *[g[k >= 2].tolist() for g in grams], strict=True))
        for own in (short, long):
            total, types, at, n, words = K._repeated(own, family)
            assert sorted(zip(at.tolist(), n.tolist(), *[w.tolist() for w in words], strict=True)) == want
            assert total.tolist() == np.bincount(doc, k, flat.n).tolist() and types.tolist() == np.bincount(doc, minlength=flat.n).tolist()


def test_small_lexicons_of_synonyms_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(SYNONYM_TEXTS)), "doc_id long, text string")
    lexicon = spark.createDataFrame([("feline", ["cat", "cat", "feline"]), ("feline", ["cat"]), ("dog", ["cat"]), ("cat", None), (None, ["dog"]), ("nothing", [None, "dog"])], "word string, syns array<string>")
    made = lambda: CO.process_texts(docs, CO.Lexicons(lexicon), ("synonyms",))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    small = made()
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Y, "BYTES", 8)
    assert Y.lookup(lexicon) is None and rows(made()) == rows(small) and any(v for r in rows(small) for v in r if isinstance(v, float))
