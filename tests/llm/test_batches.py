import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm.runtime import BATCH, BATCH_CONF


def test_stages_bound_what_a_worker_gets_at_once(spark):
    before = spark.conf.get(BATCH_CONF)
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 100_000).alias("text")).repartition(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 2 * BATCH
        spark.conf.set(BATCH_CONF, "1000")
        dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        assert spark.conf.get(BATCH_CONF).rstrip("b") == "1000"
    finally:
        spark.conf.set(BATCH_CONF, before)
