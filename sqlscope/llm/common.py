"""Shared helpers: scratch tables in the cluster's shared folder, size-checked
broadcasts and vectorised text hashing."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Largest table, in bytes of its values, that is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that it need not be installed there."""
    sc = spark.sparkContext
    if any(x.startswith("sqlscope-") for x in sc._python_includes):
        return
    root = Path(__file__).resolve().parent.parent
    name = Path(tempfile.mkdtemp()) / f"sqlscope-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``). Where it is unset, a local master gets a temporary one; a cluster must name its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        found = "file://" + tempfile.mkdtemp(prefix="sqlscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sqlscope/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **facts: Column) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again.

    What was seen while writing is kept beside the result: ``facts["rows"]``, ``facts["bytes"]``
    (of the values) and the aggregates asked for.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    width = [_width(F.col(f"`{f.name}`"), f.dataType.typeName()) for f in df.schema.fields]
    total = F.sum(sum(width[1:], width[0])) if width else F.lit(0)
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(total.cast("long"), F.lit(0)).alias("bytes"), *[c.alias(n) for n, c in facts.items()])
    watched.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    out.facts = {"rows": 0, "bytes": 0} | dict.fromkeys(facts, 0) | {k: v or 0 for k, v in seen.get.items()}
    return out


def _width(c: Column, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if kind in ("array", "map"):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 8
    return F.lit(8)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame | None) -> None:
    """Remove materialised tables that nothing reads any more."""
    for t in tables:
        if t is not None:
            drop_path(t.sparkSession, t.path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised ``df`` with a broadcast hint if its values have at most ``limit`` bytes; otherwise as it is, and Spark shuffles it."""
    return F.broadcast(df) if df.facts["bytes"] <= limit else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with a worker that gives memory back after each task: workers live on, and so would their heaps."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def numbered(rows: DataFrame, by: list[str], many: str, part_rows: int = 4096) -> DataFrame:
    """``rows`` with ``nth``: 1, 2, ... among those that agree in ``by``, of which ``many`` tells the number.

    They are numbered in parts of about ``part_rows`` rows, so no task holds all of a kind. Which row gets which number is not determined.
    """
    parted = materialize(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col(many) / part_rows))), "numbered")
    counts = parted.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("base"))
    upto = Window.partitionBy(*by).orderBy("part")
    counts = counts.select(*[F.col(c).alias(f"{c}_2") for c in by], F.col("part").alias("part_2"), (F.sum("base").over(upto) - F.col("base")).alias("base"))
    same = F.col("part") == F.col("part_2")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_2"))
    nth = F.row_number().over(Window.partitionBy(*by, "part").orderBy(F.lit(1)))
    found = parted.withColumn("nth", nth).join(counts, same).withColumn("nth", F.col("nth") + F.col("base"))
    return found.select(*rows.columns, "nth")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------------------
# Text hashing on Arrow buffers

_M = np.uint64(0xBF58476D1CE4E5B9)
_N = np.uint64(0x94D049BB133111EB)
_POWER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
#: Bytes hashed at once; texts are cut there between words only.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _N
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _POWER)
_powers = {"n": 0, "up": None, "down": None}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", int(_POWER)), ("down", pow(int(_POWER), -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


#: Words of more bytes are hashed by BLAKE2: a polynomial modulo 2**64 can be made to collide on long ones.
LONG_WORD = 64


def word_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each maximal run where ``inside`` holds; ``data``: uint8."""
    start, _, words = split_words(data, inside, np.zeros(0, np.int64))
    return start, words


def slices(batches, rows: int = 1024):
    """The same rows in batches of at most ``rows``, so that what is made of one stays small."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)


def text_pieces(column: pa.Array, limit: int = PIECE):
    """(first, last, bytes, offsets) of consecutive texts that hold ``limit`` bytes together, or one longer text.

    Offsets have one more entry than texts; a null text has no bytes.
    """
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def hashed_words(column: pa.Array, fold: np.ndarray, is_word: np.ndarray):
    """For pieces of a text column: (first, last, word hashes, word count offsets per text).

    ``fold`` maps bytes before hashing; ``is_word`` tells the bytes of words. A text
    of more than PIECE bytes is hashed in parts cut between words, so memory
    follows its word count.
    """
    for i, j, data, offsets in text_pieces(column):
        if j == i + 1 and len(data) > PIECE:
            found, at = [], 0
            inside = is_word[data]
            while at < len(data):
                stop = at + PIECE
                if stop < len(data):
                    gaps = np.flatnonzero(~inside[stop : stop + PIECE])
                    while not len(gaps) and stop < len(data):
                        stop += PIECE
                        gaps = np.flatnonzero(~inside[stop : stop + PIECE])
                    stop = stop + int(gaps[0]) if len(gaps) else len(data)
                found.append(word_hashes(fold[data[at:stop]], inside[at:stop])[1])
                at = stop
            words = np.concatenate(found)
            yield i, j, words, np.array([0, len(words)])
            continue
        inside = is_word[data]
        # texts touch each other in the buffer: a word must not run over a border
        start, _, words = split_words(fold[data], inside, offsets)
        yield i, j, words, np.searchsorted(start, offsets)


def split_words(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each maximal run where ``inside`` holds; one ends where a text ends (``offsets``)."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = edge == 1, edge == -1
    cut = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
    begins[cut] = True
    ends[cut] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        words[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return start, end, words
