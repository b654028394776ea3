"""The toxicity stage keeps texts that tell its model nothing."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from hourwise.llm.queries import table


def test_texts_without_inputs_pass_the_stage(spark, sf001):
    docs = table(spark, sf001, "documents")
    texts = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "qqxz zzqj"), (-5, None), (-5, None)]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    kept = cp.toxicity_stage(spark, both, sf001)
    assert sorted(r.doc_id for r in kept.where("doc_id < 0").collect()) == [-5, -5, -4, -3, -2, -1]
    assert 0 < kept.where(F.col("doc_id") >= 0).count() < docs.count()
