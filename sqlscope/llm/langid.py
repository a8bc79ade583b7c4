"""Language identification by hierarchical discrimination.

A text's features are the relative frequencies of hashed byte trigrams of its
lower-cased letters. Linear models decide the language family first (softmax);
inside the family one-versus-one linear support vector machines vote. They
learn in one task from a bounded sample: rows are taken by a hash of id and text,
about ``max_rows`` in all and as many of each language, and in the order of that
hash until ``2 * max_rows`` rows or ``max_features`` trigrams are held, as sparse
vectors. Every whole text is scored where it lies in Arrow batches, without a shuffle.

A text that is null or has no letter is ``und`` with score 0. Defined results:
without rows to learn from every text is ``und``; a language outside the table of
families is a family of its own; equal rows (id, text and lang) are learned from
once and scored each; votes that tie go to the larger margins, then to the first
language by name; very long texts are scored whole, in pieces of their trigrams;
columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscope.llm.common import bucket_of, materialize, slices, small, text_pieces, tidy

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS = 13
#: Documents that are learned from (in expectation, as many of each language), and their distinct trigrams at most.
MAX_ROWS, MAX_FEATURES = 4_000, 6_000_000
_SCALE = 32.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashed trigrams, offsets per text) for pieces of a column; other characters count as one blank."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    # a blank on either side keeps trigrams inside their text
    for i, j, data, at in text_pieces(pc.binary_join_element_wise(" ", lowered, "  ", "")):
        letters = np.where(_LETTER[data], data, 32).astype(np.uint32)
        if len(letters) < 3:
            yield i, j, np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
            continue
        a, b, c = letters[:-2], letters[1:-1], letters[2:]
        kept = (b != 32) | ((a != 32) & (c != 32))
        spots = np.flatnonzero(kept)
        gram = (a[spots] | (b[spots] << np.uint32(8)) | (c[spots] << np.uint32(16))) * np.uint32(0x9E3779B1)
        # a trigram belongs to the text of its middle byte
        yield i, j, (gram >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(spots + 1, at)


class Rows:
    """Sparse rows of relative trigram frequencies; a few at a time are made dense."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        self.many = np.array([len(at) for at, _ in texts], np.int64)
        self.start = np.cumsum(self.many) - self.many
        self.at = np.concatenate([at for at, _ in texts]) if texts else np.zeros(0, np.uint16)
        self.value = np.concatenate([v for _, v in texts]) if texts else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.many)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for k, r in enumerate(rows):
            own = slice(self.start[r], self.start[r] + self.many[r])
            x[k, self.at[own]] = self.value[own]
        return x


def frequencies(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text and their relative frequencies."""
    at, many = np.unique(found.astype(np.uint16), return_counts=True)
    return at, (many * (_SCALE / max(1, len(found)))).astype(np.float32)


def fit_softmax(x: Rows, y: np.ndarray, classes: int, rng: np.random.Generator, epochs: int = 12) -> np.ndarray:
    w = np.zeros((1 << BITS, classes), np.float32)
    for e in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            some = x.dense(rows)
            s = some @ w
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            s[np.arange(len(rows)), y[rows]] -= 1
            w -= 0.5 / (1 + e) * (some.T @ s / len(rows) + 1e-5 * w)
    return w


def fit_svm(x: Rows, chosen: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 15) -> np.ndarray:
    """Weights by stochastic subgradients of the hinge loss over the chosen rows; y: -1 or 1 of each."""
    w, mean, seen = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0
    for e in range(epochs):
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 32)):
            some, sign = x.dense(chosen[part]), y[part]
            wrong = sign * (some @ w) < 1
            w = w * np.float32(1 - 1e-4) + np.float32(0.5 / (1 + e)) * (sign[wrong, None] * some[wrong]).sum(axis=0) / np.float32(len(part))
            mean, seen = mean + w, seen + 1
    return mean / np.float32(max(1, seen))


def fit(x: Rows, langs: list[str], seed: int = 7) -> dict:
    """Columns of ``w``: one per family, then one per pair of languages of a family."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    family = {n: FAMILY_OF.get(n, n) for n in names}
    families = sorted(set(family.values()))
    lang = np.array([names.index(v) for v in langs])
    kin = np.array([families.index(family[v]) for v in langs])
    columns, pairs = [fit_softmax(x, kin, len(families), rng)], []
    for f in families:
        for p, q in combinations([k for k, n in enumerate(names) if family[n] == f], 2):
            rows = np.flatnonzero((lang == p) | (lang == q))
            columns.append(fit_svm(x, rows, np.where(lang[rows] == p, 1, -1).astype(np.float32), rng)[:, None])
            pairs.append((p, q))
    return {"names": names, "families": families, "family_of": [families.index(family[n]) for n in names], "pairs": pairs, "w": np.concatenate(columns, axis=1).astype(np.float32)}


def decide(model: dict, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and score in [0, 1] from the linear values of rows."""
    nf = len(model["families"])
    e = np.exp(s[:, :nf] - s[:, :nf].max(axis=1, keepdims=True))
    family = e / e.sum(axis=1, keepdims=True)
    best = family.argmax(axis=1)
    kin = np.array(model["family_of"])
    votes = np.where(kin[None, :] == best[:, None], 0.0, -1.0)
    sure = np.zeros_like(votes)
    size = np.bincount(kin, minlength=nf)[kin]
    for k, (p, q) in enumerate(model["pairs"]):
        m = 1 / (1 + np.exp(-np.clip(2 * s[:, nf + k], -35, 35)))
        votes[:, p] += m > 0.5
        votes[:, q] += m <= 0.5
        sure[:, p] += m
        sure[:, q] += 1 - m
    # ties of votes go to the larger margins, then to the first language
    lang = (votes + sure / (len(kin) + 1)).argmax(axis=1)
    rows = np.arange(len(s))
    share = np.where(size[lang] > 1, sure[rows, lang] / np.maximum(size[lang] - 1, 1), 1.0)
    return lang, family[rows, best] * share


def _learn(max_rows: int, max_features: int):
    """From rows (order, lang, text) in the order of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        langs: list[str] = []
        texts: list[tuple[np.ndarray, np.ndarray]] = []
        held, full = 0, False
        for b in slices(batches, 256):
            if full:
                continue
            for i, j, found, at in trigrams(b["text"]):
                for lang, own in zip(b["lang"].slice(i, j - i).to_pylist(), np.split(found, at[1:-1]), strict=True):
                    text = frequencies(own)
                    full = full or len(texts) >= 2 * max_rows or held + len(text[0]) > max_features
                    if not full:
                        held += len(text[0])
                        langs.append(lang)
                        texts.append(text)
        model = fit(Rows(texts), langs) if texts else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return tidy(run)


def train(docs: DataFrame, learnable: Column, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> dict | None:
    """The model, learned from rows with text and lang for which ``learnable`` holds."""
    import pickle

    known = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & learnable)
    langs = materialize(known.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("many")), "langs")  # a row per language
    rate = F.lit(float(max_rows)) / F.lit(max(1, langs.facts["rows"])) / F.col("many")
    order = F.xxhash64(F.lit("lang"), "doc_id", "text")
    drawn = known.withColumn("order", order).join(small(langs), F.col("lang") == F.col("l"))
    drawn = drawn.filter(F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate)
    once = drawn.groupBy("order", "lang").agg(F.first("text").alias("text"))
    one = once.repartition(1).sortWithinPartitions("order", "lang")
    learned = one.mapInArrow(_learn(max_rows, max_features), "model binary").first()
    return pickle.loads(learned.model) if learned else None  # no row at all if Spark sees that nothing can be chosen


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches):
            lang, sure = np.zeros(len(b), np.int64), np.zeros(len(b))
            letters = pc.fill_null(pc.match_substring_regex(b["text"], r"\p{L}"), False).to_numpy(zero_copy_only=False) if m else np.zeros(len(b), bool)
            if m:
                for i, j, found, at in trigrams(b["text"]):
                    sums = np.zeros((j - i, m["w"].shape[1]))
                    owner = np.repeat(np.arange(j - i), np.diff(at))
                    for k in range(m["w"].shape[1]):
                        sums[:, k] = np.bincount(owner, weights=m["w"][:, k][found], minlength=j - i)
                    lang[i:j], sure[i:j] = decide(m, sums / np.maximum(1, np.diff(at))[:, None] * _SCALE)
            names = [m["names"][k] if ok else "und" for k, ok in zip(lang, letters, strict=True)] if m else ["und"] * len(b)
            kept = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(names, pa.string()), pa.array(np.where(letters, sure, 0.0))], names=[*kept, "lang_pred", "score"])

    return tidy(run)


def identify(docs: DataFrame, folds: int = 3, held: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    inside = bucket_of(F.col("doc_id"), folds)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, inside != held, max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (inside == held).alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(model, least: float):
    predict = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = next(predict(iter([pa.RecordBatch.from_arrays([b["text"]], names=["text"])])))
            good = pc.and_(pc.not_equal(found["lang_pred"], "und"), pc.greater_equal(found["score"], least))
            yield b.filter(good)

    return tidy(run)


def keep_identified(docs: DataFrame, least: float = 0.0, folds: int = 3, held: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without the texts that are ``und`` or score below ``least``; one pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, bucket_of(F.col("doc_id"), folds) != held, max_rows))
    return docs.mapInArrow(_keep(model, least), docs.schema)
