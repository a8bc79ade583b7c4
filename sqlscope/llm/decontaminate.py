"""Benchmark decontamination with DataFrame functions only.

Every run of ``width`` item words (an item of fewer, but not none, as one run)
is a window. A document is cut into blocks of half a window: wherever a window
occurs, it holds a whole block. So a block's hash probes the hashes of all
half-window runs inside windows and tells where the window would start; there the
hash of the whole window must agree, and last its words. The hash table holds
four numbers a run, and the windows their words once; both are broadcast when
their values have at most ``broadcast_bytes``. Beyond that only (document,
position, hash) is shuffled, and words are compared for what is left.

Defined results: a null or empty text has no words and is clean; a null item
text has no windows; items with a null id mark hits but are not listed; very long
texts are read whole; repeated document rows give one row each, and repeated items
count once; an empty benchmark leaves all clean; an empty table gives no rows;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscope.llm.common import materialize, small

#: Bytes of the hash table, and of the windows, that are broadcast at most.
BROADCAST = 16 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(w_len, w_words, w_items) of each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    n, size = F.size("words"), F.least(F.size("words"), F.lit(width))
    starts = items.filter(n > 0).select("item", "words", size.alias("w_len"), F.explode(F.sequence(F.lit(1), n - size + 1)).alias("at"))
    runs = starts.select("item", "w_len", F.slice("words", F.col("at"), F.col("w_len")).alias("w_words"))
    return runs.groupBy("w_words", "w_len").agg(F.collect_set("item").alias("w_items"))


def block_of(width: int) -> int:
    """Words of a block: the largest so that any ``width`` words in a row hold an aligned one."""
    return (width + 1) // 2


def _run(words: Column, at: Column, n: Column) -> Column:
    return F.slice(words, F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)).cast("int"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))


def block_hashes(words: Column, k: int) -> Column:
    """Hashes of the aligned blocks of ``k`` words; there is one at least."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / k).cast("int") - 1), lambda j: F.xxhash64(F.slice(words, j * k + 1, k)))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    ``spans``: word ranges [from, to) that hits cover, merged, counted from 1.
    """
    key = F.xxhash64(F.lit("window"), "w_words")
    words = F.aggregate("w_words", F.lit(0), lambda acc, w: acc + F.octet_length(w) + 16)
    windows = materialize(benchmark_windows(benchmark, width).withColumn("w_key", key), "windows", words=F.sum(words))
    lengths = sorted((r.w_len for r in windows.select("w_len").distinct().collect()), reverse=True)  # at most ``width`` numbers
    block = F.floor((F.col("w_len") + 1) / 2).cast("int")
    runs = windows.withColumn("w_at", F.explode(F.sequence(F.lit(0), F.col("w_len") - block))).select("w_key", "w_len", "w_at", F.xxhash64(F.slice("w_words", F.col("w_at") + 1, block)).alias("w_hash"))
    runs = materialize(runs.distinct(), "runs")

    base = docs.select("doc_id", F.xxhash64("text").alias("fp"), F.length("text").alias("chars"), words_of(F.col("text")).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    # position 0 stands for the document itself, so one pass gives both the document and its hits
    probes = [F.array(F.lit(None).cast("long"))]
    size, first, upto = F.lit(0), F.lit(1), F.lit(1)
    for n in lengths:
        k = block_of(n)
        probes.append(F.when(F.col("n_words") >= n, block_hashes(F.col("words"), k)).otherwise(F.array().cast("array<bigint>")))
        size = F.when(F.col("idx") >= upto, F.lit(n)).otherwise(size)
        first = F.when(F.col("idx") >= upto, (F.col("idx") - upto) * k + 1).otherwise(first)
        upto = upto + F.when(F.col("n_words") >= n, F.floor(F.col("n_words") / k)).otherwise(0)
    doc = ["doc_id", "fp", "chars", "n_words"]
    flat = base.select(*doc, "words", F.posexplode(F.concat(*probes)).alias("idx", "hash"))
    placed = flat.withColumn("len", size).withColumn("first", first)
    at = F.col("first") - F.col("w_at")
    found = (F.col("hash") == F.col("w_hash")) & (F.col("len") == F.col("w_len"))
    whole = (at >= 1) & (F.xxhash64(F.lit("window"), _run(F.col("words"), at, F.col("w_len"))) == F.col("w_key"))
    fits = runs.facts["bytes"] <= broadcast_bytes and windows.facts["bytes"] + windows.facts["words"] <= broadcast_bytes
    if fits:
        hits = placed.join(F.broadcast(runs), found & whole, "left_outer").withColumn("at", at.cast("int")).drop("hash", "w_len", "w_at", "w_hash", "first")
        text = F.broadcast(windows.select(F.col("w_key").alias("v_key"), "w_words", "w_items"))
        equal = (F.col("w_key") == F.col("v_key")) & (_run(F.col("words"), F.col("at"), F.col("len")) == F.col("w_words"))
        every = hits.join(text, equal, "left_outer").filter((F.col("idx") == 0) | F.col("w_items").isNotNull())
        rows = every.select(*doc, (F.col("idx") == 0).alias("own"), F.when(F.col("idx") > 0, F.struct("at", "len")).alias("hit"), "w_items")
    else:
        # documents stay out of the probing join, and only those with a candidate meet the windows' words
        told = placed.filter("idx > 0").select(*doc, "len", "first", "hash").join(runs, found).filter(at >= 1).select(*doc, "len", at.cast("int").alias("at"), "w_key").distinct()
        cands = told.groupBy(*[F.col(c).alias(f"c_{c}") for c in doc]).agg(F.collect_set(F.struct("at", "len", "w_key")).alias("cands"))
        same = F.lit(True)
        for c in doc:
            same &= F.col(c).eqNullSafe(F.col(f"c_{c}"))
        met = base.join(cands, same).select(*doc, "words", F.explode("cands").alias("c")).select(*doc, "words", "c.*")
        met = met.withColumn("own_words", _run(F.col("words"), F.col("at"), F.col("len"))).drop("words").distinct()
        met = met.join(windows.select("w_key", "w_words", "w_items"), "w_key").filter(F.col("own_words") == F.col("w_words"))
        rows = base.select(*doc, F.lit(True).alias("own"), F.lit(None).cast("struct<at:int,len:int>").alias("hit"), F.lit(None).cast("array<string>").alias("w_items"))
        rows = rows.unionByName(met.select(*doc, F.lit(False).alias("own"), F.struct("at", "len").alias("hit"), "w_items"))
    per_doc = rows.groupBy(*doc).agg(
        F.count_if("own").alias("copies"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("items"),
    )
    empty = F.array().cast("array<struct<a:int,z:int>>")

    def merge(acc: Column, h: Column) -> Column:
        a, z = h["at"], h["at"] + h["len"]
        last = F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (a > F.try_element_at(acc, F.lit(-1))["z"])
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["z"], z).alias("z"))))
        return F.when(apart, F.concat(acc, F.array(F.struct(a.alias("a"), z.alias("z"))))).otherwise(grown)

    per_doc = per_doc.withColumn("spans", F.aggregate("hits", empty, merge))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + (s["z"] - s["a"]))
    return per_doc.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
        "spans",
        "fp",
        "chars",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = 10) -> DataFrame:
    """``docs`` without its contaminated documents, or (mode "spans") with the hit words cut from their texts.

    The decisions are a narrow table; it is broadcast if its size allows, so clean texts are not shuffled.
    """
    names = docs.columns
    # a flag column name that no column of docs has
    fp, chars, spans = (next(c for c in (f"{x}{'_' * i}" for i in range(len(names) + 1)) if c not in names) for x in ("fp", "chars", "spans"))
    hits = find_hits(docs, benchmark, width).filter("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("fp").alias(fp), F.col("chars").alias(chars), F.col("spans").alias(spans))
    hits = small(materialize(hits.dropDuplicates(["hit_id", fp, chars]), "contaminated"))
    same = docs["doc_id"].eqNullSafe(hits["hit_id"]) & (F.xxhash64(docs["text"]) == hits[fp]) & (F.length(docs["text"]) == hits[chars])
    if mode == "documents":
        return docs.join(hits, same, "left_anti")
    joined = docs.join(hits, same, "left_outer")
    text, cased = F.col("text"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces, gaps = F.regexp_extract_all(text, F.lit(cased), F.lit(0)), F.split(text, cased)
    kept = F.transform(pieces, lambda w, i: F.when(F.exists(F.col(spans), lambda s: (i + 1 >= s["a"]) & (i + 1 < s["z"])), F.lit("")).otherwise(w))
    cut = F.concat(F.array_join(F.transform(kept, lambda w, i: F.concat(F.get(gaps, i), w)), ""), F.get(gaps, F.size(pieces)))
    return joined.withColumn("text", F.when(F.col(spans).isNotNull(), cut).otherwise(text)).select(*names)
