import pytest

import __spark_entry__
from loomtext.operators import corpus_items as C
from tests.test_against_sql import both
from tests.test_keywords import ROWS

MORE = ROWS + " UNION ALL SELECT 6 + i, 'The running dogs were x. x x x x. Dogs is cats are big. ' || repeat('dogs of the cat ran ', i::INT) || chr(10) || 'cat' FROM range(9) AS r(i)"


@pytest.mark.parametrize("tokens, portion", [(1 << 21, 1 << 22), (16, 64)])
def test_ngrams_are_added_up_without_a_shuffle(spark, tmp_path, monkeypatch, tokens, portion):
    monkeypatch.setattr(C, "TOKENS", tokens)
    monkeypatch.setattr(C, "PORTION", portion)
    got, want = both(spark, tmp_path, "q_masked_ngrams", documents=MORE)
    assert got == want and len(got) > 300
    found = __spark_entry__.queries()["q_masked_ngrams"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and (found.rdd.getNumPartitions() > 20) == (tokens == 16)


def test_texts_without_words_have_no_ngrams(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word. x"), (4, "...")], "doc_id long, text string")
    assert C.corpus_items(docs).collect() == [] and C.corpus_items(docs.where("false")).collect() == []
