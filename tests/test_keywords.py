from loomtext.plans import cohesion as CO
from loomtext.plans import text_queries as X
from tests.test_against_sql import both

TEXTS = ["x dog x dogs run. x dog x. The x dog and the cat x x x.", "the dog x. dog x x cat the dog x dog. x dog and cat and dog and", "", "word", "dog dog dog dog dog dog dog dog dog dog cat the x"]
ROWS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, '{t} {t if i != 3 else ''}' AS text" for i, t in enumerate(TEXTS)) + " UNION ALL SELECT 5, NULL"


def test_a_word_x_and_a_masked_word_are_one(spark, tmp_path):
    got, want = both(spark, tmp_path, "q_masked_ngrams", documents=ROWS)
    assert got == want and len(got) > 100


def test_shares_follow_sql_and_shuffle_no_items(spark, tmp_path):
    got, want = both(spark, tmp_path, "q_source_keyword_shares", documents=ROWS)
    assert got == want and any(v > 0 for r in got for v in r if isinstance(v, float))
    docs = X.texts(spark, str(tmp_path))
    plan = CO.source_keywords(docs, X.next_texts(docs), X._family_reference(docs))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "family" in plan
