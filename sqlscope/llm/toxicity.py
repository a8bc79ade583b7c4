"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text's features are the distinct hashes of its words, of neighbouring pairs and
of pairs with one word between (lower-cased words of letters and digits). The
model learns in one task from a bounded sample of labelled documents, in the
order of a hash of their ids until ``max_rows`` documents or ``max_features``
features are held; per-coordinate rates and the L1 term leave few weights, which
are broadcast. Every whole text is scored where it lies, in Arrow batches,
without a shuffle.

Defined results: a null or empty text has no features and scores the bias; a very
long text is scored whole, in pieces cut between words; without labelled rows every
score is 0.5 by the empty model; several labels of one document count as the
largest, null labels not at all; of rows that share an id one text (that of the
smallest hash) is learned from and all are scored; columns other than doc_id, text
and toxic are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscope.llm.common import _N, bucket_of, hashed_words, mix, slices, tidy

BITS = 20
#: Labelled documents that are learned from at most, and passes over them; features of theirs that are held at most.
MAX_ROWS, EPOCHS, MAX_FEATURES = 16_000, 4, 16_000_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, text number, feature) for pieces of a column, features repeated as often as they occur."""
    for i, j, words, at in hashed_words(pc.utf8_lower(texts), _FOLD, _WORD):
        owner = np.repeat(np.arange(j - i), np.diff(at))
        shift = np.uint64(64 - BITS)
        found, owners = [words >> shift], [owner]
        for gap, salt in ((1, 1), (2, 2)):
            if len(words) > gap:
                same = owner[gap:] == owner[:-gap]
                pair = mix(words[:-gap] * np.uint64(2 * salt + 1) + _N) + words[gap:]
                found.append(mix(pair)[same] >> shift)
                owners.append(owner[gap:][same])
        yield i, j, np.concatenate(owners), np.concatenate(found).astype(np.int64)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not zero; index 2**BITS is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(x: np.ndarray) -> np.ndarray:
        zx, l1 = z[x], np.where(x == 1 << BITS, 0.0, L1)
        return np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((BETA + np.sqrt(n[x])) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            x = np.append(x, 1 << BITS)
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
    every = np.arange((1 << BITS) + 1)
    w = weights(every)
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept].astype(np.float64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x: list = [None] * len(b)
        for i, j, owner, found in features(b["text"]):
            both = np.unique(owner.astype(np.int64) << 32 | found)
            cut = np.searchsorted(both, np.arange(j - i + 1, dtype=np.int64) << 32)
            for r in range(i, j):
                x[r] = (both[cut[r - i] : cut[r - i + 1]] & 0xFFFFFFFF).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b["order"], b["label"], pa.array([v if v is not None else [] for v in x], pa.list_(pa.int32()))], names=["order", "label", "x"])


def _learn(max_features: int):
    """From rows (order, label, x) in the order of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[float] = []
        texts: list[np.ndarray] = []
        held, full = 0, False
        for b in slices(batches, 256):
            for y, x in zip(b["label"].to_pylist(), b["x"], strict=True):
                full = full or held + len(x.values) > max_features
                if not full:
                    held += len(x.values)
                    labels.append(float(y))
                    texts.append(x.values.to_numpy().copy())  # the batch goes
        index, value = ftrl(texts, np.array(labels)) if texts else (np.zeros(0, np.int32), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([index.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], names=["at", "weight"])

    return tidy(run)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from labelled documents for which ``learnable`` (over doc_id) holds."""
    known = labels.filter("toxic is not null").filter(learnable).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_rows)
    sample = F.broadcast(sample.select(F.col("doc_id").alias("id"), "label", "order"))  # max_rows rows at most
    chosen = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("id"))
    once = chosen.groupBy("order", "id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    examples = once.mapInArrow(tidy(_examples), "order long, label int, x array<int>")
    # one task learns: max_rows documents and max_features features at most
    model = examples.repartition(1).sortWithinPartitions("order", "label").mapInArrow(_learn(max_features), "at binary, weight binary").first()
    if model is None:  # Spark saw that nothing can be chosen
        return np.zeros(0, np.int32), np.zeros(0)
    return np.frombuffer(model.at, np.int32), np.frombuffer(model.weight, np.float64)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, value = model.value
        w = np.zeros((1 << BITS) + 1)
        w[index] = value
        used = w != 0
        for b in slices(batches):
            total = np.full(len(b), w[1 << BITS])
            for i, j, owner, found in features(b["text"]):
                hit = used[found]
                both = np.unique(owner[hit].astype(np.int64) << 32 | found[hit])
                total[i:j] += np.bincount(both >> 32, weights=w[both & 0xFFFFFFFF], minlength=j - i)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "held_out", "score"])

    return tidy(run)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(train(docs, labels, bucket_of(F.col("doc_id"), folds) != held, max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (bucket_of(F.col("doc_id"), folds) == held).alias("held_out"))
    scored = rows.mapInArrow(_score(weights), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
