"""WARC and token files as round trips, classifiers on held-out rows, the n-gram join and the search against brute force."""

import base64
import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from sqlscope.llm import ann, common, langid, ngram_join, tokens, toxicity, warc

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "ü", "é" * 70000), (None, "n", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (7, "z", None)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))
    warc.write_archive(pages, str(tmp_path / "w"))
    read = spark.read.format("warc").load(str(tmp_path / "w"))
    rows = read.collect()
    assert len(rows) == len(PAGES)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    x = digest(b"<p>x</p>")
    by = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    empty = digest(b"")
    assert by == sorted(
        [(1, "revisit", 2, 8, x), (2, "response", None, 8, x), (2, "response", None, 8, x), (0, "revisit", 2, 8, x), (3, "revisit", 7, 0, empty), (4, "revisit", 7, 0, empty), (7, "response", None, 0, empty), (5, "response", None, 140000, digest(("é" * 70000).encode()))]
    )
    assert next(r for r in rows if r.page_id == 5).payload == bytearray(("é" * 70000).encode())
    assert read.filter("record_type = 'revisit'").count() == 4
    assert read.filter("page_id in (1, 5)").count() == 2
    # the members are plain gzip, the records plain WARC
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(PAGES) and b"\r\nX: y" not in data
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(data)
    (tmp_path / "plain" / "b.warc.gz").write_bytes(gzip.compress(data[: data.find(b"WARC/1.1", 10)]))
    assert spark.read.format("warc").load(str(tmp_path / "plain")).count() == len(PAGES) + 1


def test_warc_pushdown_skips_payloads():
    reader = warc.WarcReader({"path": "/nowhere", "payload": "full"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("page_id",), 3), GreaterThan(("page_id",), 1)]))
    assert len(left) == 1 and isinstance(left[0], GreaterThan)
    data = b"".join(warc.member(warc.build_record("response", f"u{k}", "d", k, None, b"p" * 50_000, warc.digest32(b"p" * 50_000)), 6) for k in range(6))

    import io

    class File(io.BytesIO):
        def size(self):
            return len(data)

    rows = list(reader.records(warc._Stream(File(data), 0, None)))
    assert [r[4] for r in rows] == [3] and reader.inflated == 1
    assert list(warc.WarcReader({"path": "x"}).records(warc._Stream(File(b""), 0, None))) == []


def test_warc_of_others(spark, tmp_path):
    """Many records in one gzip member, several such members, ids with leading zeros or none that are numbers, blank lines, trailing bytes."""
    def record(k, page_id, size):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + bytes([97 + k]) * size
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: " + page_id + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    one = b"".join(record(k, b"%02d" % k, 10 + 300_000 * (k == 3)) for k in range(5))
    two = b"\r\n\r\n" + record(5, b"x7", 20) + record(7, b"07", 0)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(record(8, b"8", 5) + b"no archive")
    warc.register(spark)
    read = spark.read.format("warc").load(str(tmp_path))
    rows = {(r.page_id, len(r.payload)) for r in read.collect()}
    assert rows == {(0, 10), (1, 10), (2, 10), (3, 300_010), (4, 10), (None, 20), (7, 0), (8, 5)}
    assert [r.payload_bytes for r in read.filter("page_id = 3").collect()] == [300_010]
    assert read.filter("page_id = 7").count() == 1 and read.filter("page_id in (7, 8)").count() == 2


def test_warc_streams_hold_little(tmp_path):
    """Of a large member only what is wanted is kept."""
    import io

    block = b"p" * 3_000_000
    record = lambda k: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: %d\r\nContent-Length: %d\r\n\r\n" % (k, len(block)) + block + b"\r\n\r\n"
    data = gzip.compress(b"".join(map(record, range(20))), 1)

    class File(io.BytesIO):
        def size(self):
            return len(data)

    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo

    assert not list(reader.pushFilters([EqualTo(("page_id",), 17)]))
    stream = warc._Inflated(warc._Stream(File(data), 0, None))
    most = 0
    real = stream.fill

    def fill():
        nonlocal most
        most = max(most, len(stream.held))
        return real()

    stream.fill = fill
    assert [r[4] for r in reader.listed(stream)] == [17] and most < 4_000_000


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 49408, (1 << 32) - 1])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(high, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    for percentile in (0.0, 0.5, 0.9, 1.0):
        blocks = tokens.pack_blocks(ids, percentile)
        assert len(blocks) == -(-n // 1024)
        assert (np.concatenate([tokens.unpack_block(b) for b in blocks] or [ids]) == ids).all()


ODD = [None, "", " ", "a<|endoftext|>b don't I'M 42nd x1 Ünï ́x", "tab\tnew\r\nline nbsp　wide", "😀👍🏽", "A.B,C..d, ß ÿ µ ªº İstanbul ΣΑΣ", "x!!! 's 't ...", "ﬁ Å Å", "w" * 5000, "the " * 40_000]


def test_tokens_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()[:300]]
    docs = docs_of(spark, texts).withColumn("start", F.lit("clash")).repartition(5)
    got = {r.doc_id: r for r in tokens.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)


def test_tokens_that_carry_blanks(spark):
    """A byte-level vocabulary is encoded by whole texts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert not tokens.Encoder(path).by_word and tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).direct
    texts = [t for t in ODD if t is None or len(t) < 10_000]
    got = {r.doc_id: r for r in tokens.tokenized(docs_of(spark, texts), path, end_id=50256).collect()}
    for k, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 50256], "<u4")
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), t


def test_tokens_empty_repeated_and_null_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = docs_of(spark, ["a b", "c"])
    assert tokens.tokenized(docs.filter("false"), path).count() == 0
    twice = docs.unionAll(docs).unionAll(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = tokens.tokenized(twice, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 0, 0, 1, 1]
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows[:-1]]))


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    rows = toxicity.score(docs.withColumn("toxic", F.lit(1)).withColumn("label", F.lit("x")), labels).join(labels, "doc_id").filter("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def plain_ftrl(examples, labels, epochs):
    """FTRL-proximal, coordinate by coordinate."""
    z, n = {}, {}
    bias = 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            w = {i: weight(i) for i in [*x.tolist(), bias]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i, v in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * v
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_and_scores_match_plain_code(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(30)] + ["vile", "slur"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(300)] + [None, ""]
    y = [int("vile" in (t or "")) for t in texts]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, 0, v) for k, v in enumerate(y)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs.unionAll(docs.limit(50)), labels).collect()}

    import pyarrow as pa

    def features(t):
        return np.unique(np.concatenate([f for _, _, _, f in toxicity.features(pa.array([t], pa.string()))] or [np.zeros(0, np.int64)]))

    order = {r.doc_id: r.o for r in labels.selectExpr("doc_id", "xxhash64(doc_id) o").collect()}
    learned = sorted((k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 != 2), key=order.get)
    model = plain_ftrl([features(texts[k]) for k in learned], [y[k] for k in learned], toxicity.EPOCHS)
    want = {k: 1 / (1 + np.exp(-(model.get(1 << toxicity.BITS, 0.0) + sum(model.get(i, 0.0) for i in features(t).tolist())))) for k, t in enumerate(texts)}
    assert got == pytest.approx(want, abs=1e-9)
    assert len(model) >= 3  # the bias, the word and a pair


def test_toxicity_edges(spark):
    docs = docs_of(spark, [None, "", "x" * 400_000, "bad word " * 50_000])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(0, None, 1), (1, 0, None), (3, 1, 0), (3, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs.unionAll(docs), labels).count() == 8
    assert toxicity.score(docs.filter("false"), labels).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def plain_language(model, text):
    """Family by largest linear value, then the votes of the pairs, from trigrams counted one by one."""
    data = bytes(b if (97 <= b <= 122 or b >= 128) else 32 for b in f" {text.lower()} ".encode())
    many: dict = {}
    for k in range(1, len(data) - 1):
        a, b, c = data[k - 1], data[k], data[k + 1]
        if b != 32 or (a != 32 and c != 32):
            g = ((a | b << 8 | c << 16) * 0x9E3779B1 % 2**32) >> (32 - langid.BITS)
            many[g] = many.get(g, 0) + 1
    s = sum(n * model["w"][g].astype(float) for g, n in many.items()) / max(1, sum(many.values())) * langid._SCALE
    nf = len(model["families"])
    best = int(np.argmax(s[:nf]))
    votes = {k: 0.0 for k, f in enumerate(model["family_of"]) if f == best}
    for k, (p, q) in enumerate(model["pairs"]):
        if p in votes:
            m = 1 / (1 + np.exp(-2 * s[nf + k]))
            votes[p] += (m > 0.5) + m / (len(model["names"]) + 1)
            votes[q] += (m <= 0.5) + (1 - m) / (len(model["names"]) + 1)
    return model["names"][max(votes, key=lambda k: (votes[k], -k))]


def test_language_matches_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(docs.filter("doc_id < 40"))  # repeated rows are learned from once
    model = langid.train(docs, common.bucket_of(F.col("doc_id"), 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    for k in list(texts)[:150]:
        if got[k] != "und":
            assert got[k] == plain_language(model, texts[k])
    once = langid.train(docs.dropDuplicates(), common.bucket_of(F.col("doc_id"), 3) != 1)
    assert once["names"] == model["names"] and len(model["pairs"]) > 0


def test_language_edges(spark):
    train = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", F.lit("clash")).withColumn("score", F.lit(1))
    odd = docs_of(spark, [None, "", "123 !!", "你好", "the and of " * 60_000]).withColumn("doc_id", F.col("doc_id") + 10_000_000).withColumn("held_out", F.lit("c")).withColumn("score", F.lit(1)).withColumn("lang", F.lit(None).cast("string"))
    both = train.unionByName(odd)
    got = {r.doc_id - 10_000_000: r.lang_pred for r in langid.identify(both).filter("doc_id >= 10000000").collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und" and got[4] == "en"
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}
    assert langid.identify(odd.filter("false")).count() == 0
    kept = langid.keep_identified(both)
    assert kept.columns == both.columns and kept.count() == both.count() - 3


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[ \t-\r]+", (t or "").translate(LOWER)) if x]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(texts)))
    linked = [[100 * len(a & b) >= percent * len(a | b) and bool(a) and bool(b) for b in sets] for a in sets]
    for k in range(len(texts)):
        stack, seen = [k], {k}
        while stack:
            x = stack.pop()
            for y in range(len(texts)):
                if linked[x][y] and y not in seen:
                    seen.add(y)
                    stack.append(y)
        label[k] = min(seen)
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


def near_copies(seed, n=120):
    """Chains of edits: neighbours link, the ends don't; plus odd texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", "  ", "a", "A", "a b c", "A\tb  C", "a b c d", "x" * 3000]
    for _ in range(6):
        words = list(rng.choice(vocabulary, int(rng.integers(30, 200))))
        for _ in range(n // 8):
            texts.append(" ".join(words))
            if rng.random() < 0.7:
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
    common_line = " ".join(rng.choice(vocabulary, 12))
    texts += [f"{common_line} " + " ".join(rng.choice(vocabulary, int(rng.integers(5, 60)))) for _ in range(40)]
    texts.append(" ".join(rng.choice(vocabulary, 20_000)))
    return texts


@pytest.mark.parametrize(("seed", "size", "percent", "block"), [(1, 4, 85, 50_000), (2, 5, 80, 3)])
def test_ngram_join(spark, seed, size, percent, block):
    texts = near_copies(seed)
    docs = docs_of(spark, texts).withColumn("n", F.lit("clash")).withColumn("cls", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs, size, percent, block).collect()}
    want = brute_components(texts, size, percent)
    assert [got[k] for k in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts) - 20


def test_ngram_join_empty_and_repeated(spark):
    docs = docs_of(spark, ["a b c d e", "A b c d e", None])
    assert ngram_join.join_components(docs.filter("false")).count() == 0
    rows = ngram_join.join_components(docs.unionAll(docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    kept = ngram_join.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and kept.columns == docs.columns


def test_ngram_join_of_a_large_group(spark):
    """Near copies of one text that link with it, and near misses of another that link with nothing; blocks smaller than either."""
    rng = np.random.default_rng(5)
    base, other = [f"b{k}" for k in range(60)], [f"o{k}" for k in range(60)]
    texts = [" ".join(base)]
    for k in range(150):
        near, miss = base.copy(), other.copy()
        near[int(rng.integers(60))] = f"n{k}"
        for at in rng.permutation(15)[:2]:
            miss[int(at) * 4] = f"m{k}.{at}"
        texts += [" ".join(near), " ".join(miss)]
    want = brute_components(texts, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs_of(spark, texts), block=16).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert sum(c == 0 for _, c in want) > 100


def test_ngram_join_long_words_and_null_ids(spark):
    """Words that a polynomial modulo 2**64 takes for equal (Thue-Morse and its complement) don't link; null ids inside a group do."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(5, f"x {one} y z"), (6, f"x {two} y z"), (None, "p q r s t"), (9, "p q r s t"), (8, "P q r s t"), (8, "p q r s t"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()), key=str)
    assert got == sorted([(5, 1, 5), (6, 1, 6), (None, 2, 8), (9, 2, 8), (8, 2, 8), (8, 2, 8), (None, 0, None)], key=str)


def test_fragments_cut_the_global_order():
    levels = np.random.default_rng(0).integers(0, 60, 1 << 18).astype(np.uint8)
    borders = ngram_join.fragment_borders(levels, 4)
    s = np.unique(common.mix(np.arange(200_000, dtype=np.uint64)))
    at = ngram_join.place(s, levels, 18)
    order = np.argsort(levels[(s >> np.uint64(46)).astype(np.int64)], kind="stable")
    assert (np.diff(at[order].astype(object)) >= 0).all() and (np.diff(borders.astype(object)) > 0).all()
    weight = np.expm1(levels[(s >> np.uint64(46)).astype(np.int64)] / 10)
    shares = [weight[(at >= a) & (at < z)].sum() for a, z in zip([0, *borders], [*borders, 1 << 63], strict=True)]
    assert max(shares) < 1.2 * min(shares)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26)]
    for per_task in (1_000_000, 2):  # in one task, and by stars
        got = {r.cls: r.comp for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), per_task).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {k: 20 for k in range(20, 27)}


def test_word_hashes_do_not_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "é"], int(n))) for n in rng.integers(0, 50, 200)] + ["z " * 400_000]
    fold, word = ngram_join._FOLD, ngram_join._WORD

    def all_of(column):
        return [w for _, _, words, at in common.hashed_words(column, fold, word) for k in range(len(at) - 1) for w in [tuple(words[at[k] : at[k + 1]])]]

    whole = all_of(pa.array(texts))
    single = [w for t in texts for w in all_of(pa.array([t]))]
    assert whole == single and [len(w) for w in whole] == [len(t.split()) for t in texts]


def test_search(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    odd = [(100_000, None), (100_020, [0.0] * 64), (100_040, [float("nan")] * 64), (100_060, [None] * 64), (100_080, [1.0, 2.0]), (100_100, list(rows[0].embedding)), (100_101, list(rows[0].embedding))]
    both = e.select("vec_id", "embedding").unionAll(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("score", F.lit("clash")).withColumn("codes", F.lit(1))
    got: dict = {}
    for r in ann.search(both).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows} | {k: np.array(v, float) for k, v in odd[-2:]}
    assert set(got) == {k for k in vectors if k % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        want = sorted((-float(v @ vectors[q]), k) for k, v in vectors.items() if k != q)[:20]
        hit += len({k for _, k in want} & {k for _, k, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(vectors[k] @ vectors[q]), abs=1e-12) for _, k, s in found)
        assert [(-s, k) for _, k, s in found] == sorted((-s, k) for _, k, s in found)
    assert hit / (20 * len(got)) >= 0.95


def test_search_small(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(three).collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]


def test_search_ties_at_the_last_rank_and_repeated_ids(spark):
    """Equal scores at rank 20 go to the smaller ids; a query id that is there twice asks once."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(k, [2.0, float(k % 2)]) for k in range(1, 60)] + [(20, [0.0, 1.0]), (7, [3.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert [v for _, v, _ in mine] == [7, *[k for k in range(1, 60) if k != 7][:19]] and mine[0][2] == 3.0 and mine[-1][2] == 2.0
    assert sorted({r.query_id for r in got}) == [0, 20, 40] and sum(r.query_id == 20 for r in got) == 20


def test_search_by_distance(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in e.collect() if r.embedding is not None}
    hit, got = 0, {}
    for r in ann.search(e, metric="l2").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, found in got.items():
        want = sorted((float(((v - vectors[q]) ** 2).sum()), k) for k, v in vectors.items() if k != q)[:20]
        hit += len({k for _, k in want} & {k for _, k, _ in found})
        assert all(s == pytest.approx(-float(((vectors[k] - vectors[q]) ** 2).sum())) for _, k, s in found)
    assert hit / (20 * len(got)) >= 0.95
