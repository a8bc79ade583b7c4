"""Each stage of the pipeline against brute force on its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from test_llm_models import brute_components
from test_llm_text import brute_hits, fill

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_000, None, None, "src1", 0), (900_001, "12 34 -- !!", "en", None, 11), (900_002, "", "en", "src2", 0)], docs.schema)
    docs, items = docs.unionAll(odd), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "shards":
            assert docs.columns == names
        kept[name] = (before, after)

    before, after = kept["language"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and re.search(r"[^\W\d_]", r.text)}
    before, after = kept["near_duplicates"]
    before.sort(key=lambda r: r.doc_id)
    labels = brute_components([r.text for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({before[c].doc_id for _, c in labels})
    assert len(after) < len(before)
    before, after = kept["decontamination"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not brute_hits(r.text, items)[4])
    assert len(after) < len(before)
    before, after = kept["mixture"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    largest = max(words(r.text) for r in before)
    for source, target in fill(sizes).items():
        assert abs(sum(words(r.text) for r in after if r.source == source) - target) <= largest / 2 + 1
    before, after = kept["shards"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    counts = [sum(r.shard == k for r in after) for k in range(24)]
    assert max(counts) - min(counts) <= 1 and len({(r.shard, r.slot) for r in after}) == len(after)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns)
    assert out.count() == out.select("shard", "slot").distinct().count() > 0
    assert out.filter(F.col("text").isNull()).count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids, repeated rows and columns with clashing names go through every stage; an empty table gives none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    nameless = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionAll(docs.limit(10)).unionAll(nameless)
    clash = ["n", "cls", "d1", "fp", "spans", "cut", "key", "part", "nth", "shard", "slot", "lang_pred", "score", "size", "tie", "body", "copies"]
    docs = docs.withColumns({c: F.lit(c) for c in clash})
    names, empty = docs.columns, docs.filter("false")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert stage(spark, empty, SF).count() == 0
        left = docs.count()
        assert 0 < left and (left <= before or name == "mixture")
        before = left
        kept = [c for c in clash if name != "shards" or c not in ("shard", "slot")]
        assert set(docs.columns) == set(names) and all(docs.filter(F.col(c) != c).count() == 0 for c in kept)
        if name == "near_duplicates":
            assert docs.filter("doc_id is null").count() > 0
    assert docs.select("shard", "slot").distinct().count() == before
