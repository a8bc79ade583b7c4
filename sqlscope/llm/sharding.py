"""Uniform sharding by a hypergeometric communication matrix.

Rows lie in P source partitions (a hash of id and text). The number of rows that
partition p sends to shard s is drawn exactly: the matrix with the partitions'
row counts and the shards' sizes (at most one apart) as margins follows the
multivariate hypergeometric law, so the shuffle is uniform. Each partition
permutes its rows (order of a seeded hash), deals them out by its matrix row,
and each shard permutes what it received, range by range of a second hash, so
no task holds a shard.

Defined results: a null text has no bytes; a very long text moves as one row, once;
repeated rows each get a slot of their own (which of them gets which is
undetermined, as they are equal); a null id is an id; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.llm.common import materialize, numbered, small

#: Rows that a source partition, or a range of a shard, holds on average; numbers of the matrix at most.
#: Beyond that many the partitions hold more rows, so the driver and the matrix stay bounded.
PART_ROWS, MAX_CELLS = 2048, 1_500_000
#: Equal rows whose slots are handed out in one task at most; more are numbered in parts.
EQUAL_ROWS = 4096


def communication_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by source partition and shard, drawn uniformly with exact margins."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = int(rows.sum())
    room = np.full(shards, total // shards, dtype=np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        # the colours of n balls drawn from what the shards have room for
        out[p] = _draw(room, int(n), rng)
        room -= out[p]
    return out


def _draw(room: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric counts, margin by margin; numpy's own draw is limited to 1e9 in all."""
    out, left = np.zeros_like(room), int(room.sum())
    for s, r in enumerate(room):
        other = left - int(r)
        if n == 0:
            break
        if other == 0:
            out[s] = n
        elif max(int(r), other) < 10**9:
            out[s] = rng.hypergeometric(int(r), other, n)
        else:
            out[s] = _invert(int(r), other, n, rng)
        n -= int(out[s])
        left = other
    return out


def _invert(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` balls are good: inversion of the exact law. What lies 12 deviations and 64 from the mode is less than a double can tell."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = 64 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1)
    x = k[:-1]
    log_p = np.concatenate([[0.0], np.cumsum(np.log(((good - x) / (x + 1)) * ((n - x) / (bad - n + x + 1))))])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[min(np.searchsorted(p, rng.random() * p[-1], side="right"), len(k) - 1)])


def assign(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, law, shard, slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("r1", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).withColumn("r2", F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"))
    rows = materialize(rows, "shard-rows")
    total = rows.facts["rows"]
    parts = max(1, min(-(-total // PART_ROWS), MAX_CELLS // shards))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "r1"), F.lit(parts)).cast("int"))
    counts = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # MAX_CELLS / shards numbers at most
    matrix = communication_matrix(np.array([counts.get(p, 0) for p in range(parts)], dtype=np.int64), shards, seed)
    start = np.cumsum(matrix, axis=1) - matrix
    starts = pa.ListArray.from_arrays(pa.array(np.arange(parts + 1) * shards, pa.int32()), pa.array(start.ravel()))
    deal = materialize(spark.createDataFrame(pa.table({"part": pa.array(np.arange(parts), pa.int32()), "starts": starts})), "shard-matrix")
    local = Window.partitionBy("part").orderBy("r1", "doc_id", "text_crc32")
    placed = rows.withColumn("rank", F.row_number().over(local) - 1).join(small(deal, 8 * MAX_CELLS + 64 * parts), "part")  # MAX_CELLS numbers at most
    # the last shard that starts at or before this rank
    shard = F.size(F.filter("starts", lambda s: s <= F.col("rank"))) - 1
    placed = placed.withColumn("shard", shard.cast("int"))
    ranges = max(1, -(-total // (shards * PART_ROWS)))
    # r2 is a whole long; its high 32 bits cut the shard into ranges of equal width
    placed = placed.withColumn("range", F.floor((F.shiftright("r2", 32) + F.lit(1 << 31)) * F.lit(ranges) / F.lit(float(1 << 32))).cast("int"))
    placed = materialize(placed.drop("starts", "rank", "part"), "shard-placed")
    sums = placed.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # a row per 8192 rows
    again = Window.partitionBy("shard", "range").orderBy("r2", "doc_id", "text_crc32")
    slots = placed.withColumn("k", F.row_number().over(again) - 1).join(sums, ["shard", "range"])
    return slots.select("doc_id", "size", "text_crc32", "text_hash", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """``docs`` with shard and slot (in place of columns of these names). Texts are shuffled once; rows of one id and text are numbered and take their slots in turn."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    places = materialize(assign(docs, shards, seed).select("doc_id", "text_hash", "shard", "slot"), "shard-places")
    repeated = places.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count(F.lit(1)).alias("many"))
    repeated = materialize(repeated.filter(F.col("many") > EQUAL_ROWS), "shard-repeated")
    body = F.struct(*[F.col(f"`{c}`") for c in names]).alias("body")
    rows = docs.select(body).select("body", "body.doc_id", F.xxhash64("body.text").alias("text_hash"))

    often = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))

    def few(some: DataFrame) -> DataFrame:
        return some.join(small(repeated), often, "left_anti") if repeated.facts["rows"] else some

    slots = few(places).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("slots"))
    # the join brings equal rows together, so this window moves nothing
    joined = few(rows).join(slots, often).withColumn("place", F.get("slots", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1))) - 1))
    out = joined.select("body.*", F.col("place.shard").alias("shard"), F.col("place.slot").alias("slot"))
    if not repeated.facts["rows"]:
        return out

    def turns(some: DataFrame) -> DataFrame:
        return numbered(some.join(small(repeated), often).drop("id", "hash"), ["doc_id", "text_hash"], "many").drop("many")

    free = turns(places).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("nth").alias("turn"), "shard", "slot")
    return out.unionByName(turns(rows).join(free, often & (F.col("nth") == F.col("turn"))).select("body.*", "shard", "slot"))
