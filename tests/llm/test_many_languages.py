"""Languages beyond two hundred are learned."""

from pyspark.sql import functions as F

from sqlscope.llm import langid


def test_every_language_is_learned(spark):
    names = [f"x{k:03}" for k in range(230)]
    rows = [(3 * k + i, f"{name} {name[::-1]} word{k}", name) for k, name in enumerate(names) for i in range(3 if k < 200 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, F.lit(True))["names"] == names
