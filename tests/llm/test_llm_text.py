"""Decontamination, mixing, sharding and chat formatting on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlscope.llm import chat, common, decontaminate, mixing, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(k, t, "en", sources[k] if sources else f"s{k % 3}", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ITEM = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    "x " + ITEM.upper() + " y",
    "one two three four five six seven eight nine",
    "one, two; three four five six seven eight nine ten -- eleven",
    None, "", "...", "short item", "a Short! item b short item", "short  no item",
    ITEM + " " + ITEM, "É" + ITEM, "w " * 30000 + ITEM, ITEM.replace("six", "six\x7f"),
]
ITEMS = [(1, ITEM), (20, "short item"), (3, None), (4, "!!"), (None, "nine ten eleven"), (1, ITEM), (5, ITEM + " thirteen")]


def brute_hits(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, covered, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(len(b), width)
        runs = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in runs:
                covered |= set(range(i, i + k))
                if item is not None:
                    ids.add(str(item))
    ids = sorted(ids)
    return len(w), len(covered), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(covered)


def test_decontaminate_matches_brute_force(spark):
    docs = documents(spark, TEXTS).withColumn("words", F.lit(1)).withColumn("hits", F.lit("x"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("clash"))
    for limit in (1 << 20, 0):  # with and without the broadcast
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_hits(docs, bench, broadcast_bytes=limit).collect()}
        assert got == {k: brute_hits(t, ITEMS) for k, t in enumerate(TEXTS)}


def test_decontaminate_empty_and_repeated(spark):
    docs, bench = documents(spark, TEXTS[:3]), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not decontaminate.find_hits(docs, bench.filter("false")).filter("contaminated").count()
    assert decontaminate.find_hits(docs.filter("false"), bench).count() == 0
    assert decontaminate.find_hits(docs.unionAll(docs), bench).count() == 6


def test_decontaminate_removal(spark):
    docs, bench = documents(spark, TEXTS).withColumn("fp", F.lit("mine")), spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = {k for k, t in enumerate(TEXTS) if not brute_hits(t, ITEMS)[4]}
    kept = decontaminate.remove(docs, bench)
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, mode="spans").collect()}
    assert set(cut) == set(range(len(TEXTS)))
    assert all(cut[k] == TEXTS[k] for k in clean)
    assert all(not brute_hits(t, ITEMS)[4] for t in cut.values())
    assert cut[0].split() == ["x", "y"] and "!" in cut[7]


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: cap * sizes[s] for s in capped} | {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "B", "é", None, "zz", ""]
    texts = [None if rng.random() < 0.05 else "w " * int(rng.integers(0, 40)) for _ in range(600)]
    sources = [names[int(k)] for k in rng.choice(len(names), 600, p=[0.6, 0.2, 0.1, 0.05, 0.04, 0.01])]
    docs = documents(spark, texts, sources).withColumn("size", F.lit("clash")).withColumn("u", F.lit(None).cast("string"))
    rows = mixing.mix(mixing.sized(docs), (1, 2, 3), 3).collect()
    assert len(rows) == 600
    sizes = {s: 0 for s in set(sources)}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 40
    again = mixing.mix(mixing.sized(docs.repartition(7)), (1, 2, 3), 3).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in rows if r.copies}


@pytest.mark.parametrize("ids", ["null", "shared", "own", "repeated"])
def test_mixing_takes_ties_row_by_row(spark, ids):
    """1,000 rows of ten words that tie, or don't: the same words are taken."""
    own = {"null": lambda k: None, "shared": lambda k: 7, "own": lambda k: k, "repeated": lambda k: k % 20}[ids]
    rows = [(own(k), "w " * 10, "a") for k in range(1000)] + [(10_000 + k, "w " * 10, "b") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = common.materialize(mixing.sized(docs), "sized")
    got = mixing.mix(sized, (1, 3), 3).collect()
    assert len(got) == 2000
    for source, target in (("a", 5000), ("b", 15_000)):
        mine = [r for r in got if r.source == source]
        assert {r.target for r in mine} == {target} and sum(r.taken for r in mine) == target
    out = mixing.mix_documents(docs, (1, 3), 3)
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {"a": 500, "b": 1500}


def test_mixing_includes_in_proportion(spark):
    """Documents come in as often as their weights say, the largest for certain; where the target is beyond the size, all come in."""
    sizes = [1, 4, 16, 400, 10_000]
    rows = [(k, "w " * sizes[k % 5 if k % 500 == 4 else k % 4], "a") for k in range(8000)] 
    words = sum(len(t) // 2 for _, t, _ in rows)
    rows += [(9000 + k, "w " * (words // 50), "z") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(mixing.sized(docs), (1, 3), 3).collect()
    assert {r.copies for r in got if r.source == "z"} == {1, 2}
    by: dict = {}
    for r in got:
        if r.source == "a":
            by.setdefault(r.size, []).append((r.expected, r.copies))
    rates = {n: (np.mean([e for e, _ in v]), np.mean([c for _, c in v])) for n, v in by.items()}
    assert all(abs(e - c) < 0.06 for e, c in rates.values()), rates
    assert rates[4][0] == pytest.approx(2 * rates[1][0]) and rates[400][0] == pytest.approx(20 * rates[1][0])
    assert rates[10_000] == (1, 1) and 0 < rates[1][0] and rates[400][0] < 1


def test_mixing_empty(spark):
    docs = documents(spark, [None, "a"])
    assert mixing.mix(mixing.sized(docs.filter("false"))).count() == 0
    assert mixing.mix(mixing.sized(docs.filter("doc_id = 0"))).first().taken == 0


def test_communication_matrix():
    rows = np.array([5, 0, 7, 100, 3])
    for seed in range(20):
        m = sharding.communication_matrix(rows, 8, seed)
        assert (m.sum(axis=1) == rows).all() and m.min() >= 0
        assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    # exact margins, and the mean of the uniform law
    mean = np.mean([sharding.communication_matrix(rows, 5, s)[3] for s in range(300)])
    assert mean == pytest.approx(20)


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 16)
    texts = [None, "", "é", "same"] + ["same"] * 200 + [f"t{k}" for k in range(296)]
    docs = documents(spark, texts).withColumn("shard", F.lit("clash")).withColumn("size", F.lit(1))
    docs = docs.unionAll(docs.filter("doc_id < 5"))
    rows = sharding.assign(docs, 24).collect()
    assert len(rows) == 505
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.assign(docs.repartition(9), 24).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in again)
    whole = sharding.shard_documents(docs, 24)
    assert whole.count() == 505 and whole.select("shard", "slot").distinct().count() == 505
    assert sharding.assign(docs.filter("false"), 24).count() == 0


def test_sharding_of_null_ids_long_texts_and_many_repeats(spark):
    rows = [(None, "n")] * 30 + [(1, "r")] * 5000 + [(None, None)] * 3 + [(2, "x" * 3_000_000), (3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("nth", F.lit("clash"))
    whole = sharding.shard_documents(docs, 24)
    assert set(whole.columns) == {"doc_id", "text", "part", "nth", "shard", "slot"}
    got = whole.select("doc_id", F.xxhash64("text").alias("t"), "shard", "slot").collect()
    assert len(got) == len(rows) == len({(r.shard, r.slot) for r in got})
    counts = [sum(r.shard == k for r in got) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    many = {}
    for r in got:
        many[r.doc_id, r.t] = many.get((r.doc_id, r.t), 0) + 1
    assert sorted(many.values()) == [1, 1, 3, 30, 5000]


def test_sharding_is_uniform(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign(docs, 4).collect()
    low = [r for r in rows if r.doc_id < 1000]
    assert all(abs(sum(r.shard == s for r in low) - 250) < 60 for s in range(4))
    assert abs(np.corrcoef([r.doc_id for r in rows], [r.slot for r in rows])[0, 1]) < 0.08


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "more"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 5, "system", None), (2, 7, None, "a"), (3, 5, "system", ""), (3, 7, None, "a"), (3, 9, "assistant", "zé"),
        (4, 0, "user", "alone"), (None, 0, "user", "lost"), (6, 0, "user", "q"), (6, 0, "user", "q"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash")).withColumn("pair_id", F.lit("clash"))
    rows = {r.pair_id: r for r in chat.preferences(chat.paired(df)).collect()}
    r = rows[0]
    assert (r.n_prefix, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\nyo<|end|>\n<|user|>\nmore<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n"
    a, z = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:z] == "yo"
    r = rows[1]
    assert r.n_prefix == 2 and r.chosen == "" and r.chosen_mask == ""
    a, z = map(int, r.rejected_mask.split("-"))
    assert r.rejected[a:z] == "zé"
    assert rows[2].prompt == "" and rows[2].rejected == "" and rows[2].chosen.startswith("<|user|>")
    assert rows[3].chosen.count("q") == 2 and None not in rows  # rows without an id belong to no conversation
    assert chat.preferences(chat.paired(df.filter("false"))).count() == 0


def test_preferences_of_large_and_null_ids(spark):
    """Neighbouring ids beyond 2**53 make one pair; many rows without an id make none; negative ids pair as well."""
    big = 2**53 + 2
    turns = [(c, 0, "user", "q") for c in (big, big + 1, -2, -1)] + [(big, 1, "assistant", "x" * 500_000), (big + 1, 1, "assistant", "no")] + [(None, k, "user", "lost") for k in range(500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r.pair_id: r for r in chat.preferences(chat.paired(df)).collect()}
    assert set(rows) == {big // 2, -1} and rows[big // 2].n_prefix == rows[-1].n_prefix == 1
    assert len(rows[big // 2].chosen) > 500_000 and "no" in rows[big // 2].rejected


def test_decontaminate_removes_from_repeated_rows_with_null_ids(spark):
    rows = [(None, ITEM), (None, "clean"), (None, None), (1, ITEM), (1, ITEM), (1, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w_key", F.lit("clash")).withColumn("hit", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.remove(docs, bench)
    assert sorted((r.doc_id, r.text) for r in kept.fillna(-1, "doc_id").fillna("", "text").collect()) == [(-1, ""), (-1, "clean"), (1, "clean")]
    for limit in (1 << 20, 0):
        assert decontaminate.find_hits(docs, bench, broadcast_bytes=limit).filter("contaminated").count() == 3
