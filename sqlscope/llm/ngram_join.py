"""Exact n-gram Jaccard self-join by vertical partitioning of the global n-gram order.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with equal
   sets are one class, so exact copies cost nothing further.
2. The global order puts frequent shingles last: by a count in a sketch
   (broadcast, sized by the input within bounds), then by hash. Two sets that link
   share a shingle among the first n - ceil(t n) + 1 of either (prefix filter), so
   only those are shuffled. A bucket is what shares such a shingle and is of like
   size; buckets with equal members are one.
3. Classes of a bucket are compared by bitmaps of a size that follows the sets,
   which bound the overlap from above and closely. A bucket yields a spanning
   forest of the pairs that may link, not all pairs.
4. The overlap of each such pair is counted exactly: the global order is cut into
   fragments of like weight, each fragment's partial overlaps are counted
   separately and summed per pair.
5. Links are joined to components. Where a pair was refused, the buckets that hold
   it are walked again without the refused pairs, until none has a pair left.
   Every pair that may link is then either inside a component or refused by exact
   count, so no link is lost.

A set that has a shingle at place k of the order shares at most its n - k last with
another whose first common shingle that is, so it links there with sets up to a size
only, its reach. Two that reach but smaller sets than themselves don't link by it. So a
bucket of more than ``block`` classes is parted in hosts, which reach sets of their own
size, and guests, which meet hosts within their reach only: most of what shares the
frequent shingles of a group but has changed too much to link with it.

Hosts are dealt out three times: in blocks that share a few of them; then what lies
outside the largest component, in blocks that share the classes with most links so
far; then, by pairs of blocks, what is still outside against everything. A large group
of near copies is joined by the first two in proportion to its size; the third, which
is exact, finds little left. Guests are dealt to blocks of hosts in order of size.

Defined results: null, empty and blank texts have no shingles, link with nothing
and are components of their own; texts of fewer than ``size`` words are one
shingle; very long texts are hashed in pieces and only cost memory for their
shingles; rows with repeated or null ids are rows like others (a component's id
is its smallest non-null id); an empty table gives no rows; columns other than
doc_id and text are ignored. Two sets count as equal if their 128-bit digests
agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.llm.common import _N, drop, hashed_words, materialize, mix, slices, small, tidy

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Counters of the frequency sketch, as powers of two: least and most (a byte each once it is merged), and of one chunk.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 18, 26, 18
#: Bits of a bitmap: least and most; in between eight or more for each shingle.
LEAST_BITMAP, MOST_BITMAP = 4096, 1 << 18
#: Fragments of the order, members of a bucket that one task walks, classes that blocks of a bucket share.
FRAGMENTS, BLOCK, SHARED = 4, 256, 32
#: Edges of a graph that one task contracts.
EDGES = 1_000_000
#: Classes that a worker remembers so as not to tell them twice.
SEEN = 200_000


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for i, j, words, at in hashed_words(texts, _FOLD, _WORD):
        n = len(words)
        grams = np.zeros(0, np.uint64)
        if n >= size:
            grams = words[: n - size + 1].copy()
            for k in range(1, size):
                grams = mix(grams + _N) + words[k : n - size + 1 + k]
        for r in range(i, j):
            a, z = int(at[r - i]), int(at[r - i + 1])
            if z - a >= size:
                yield r, np.unique(grams[a : z - size + 1])
            elif z > a:  # the whole sequence as one shingle, apart from those of ``size`` words
                h = np.full(1, z - a, np.uint64)
                for k in range(a, z):
                    h = mix(h + _N + words[k : k + 1])
                yield r, h
            else:
                yield r, np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """Of a set, as two signed 64-bit numbers: order-free sums of mixes, mixed again."""
    if not len(s):
        return 0, 0
    n = np.uint64(len(s))
    once, twice = mix(s), mix(s * _N + n)
    both = np.array([once.sum() ^ mix(once + twice).sum(), twice.sum() + n], np.uint64)
    both = mix(both + mix(both[::-1] * _N))
    return tuple(both.view(np.int64).tolist())


def _spots(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _profile(size: int, bits: int):
    """Rows (doc_id, n, d1, d2, chunk, counts): a row per document, and the task's counts for the sketch."""
    chunk = 1 << min(bits, CHUNK_BITS)
    names = ["doc_id", "n", "d1", "d2", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.uint8), set()  # a task counts to 255
        for b in slices(batches):
            m = len(b)
            n, found = np.zeros(m, np.int64), np.zeros((2, m), np.int64)
            for r, s in shingle_sets(b["text"], size):
                n[r], found[:, r] = len(s), (key := digest(s))
                if len(s) and key not in seen:  # copies count once in a task
                    seen.add(key)
                    spots = _spots(s, bits)
                    counts[spots] += counts[spots] < 255
                    if len(seen) > SEEN:
                        seen.clear()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(found[0]), pa.array(found[1]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        none = [pa.nulls(1, pa.int64())] * 4
        for k in range(len(counts) // chunk):
            part = counts[k * chunk : (k + 1) * chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([*none, pa.array([k], pa.int32()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=names)

    return tidy(run)


def _sum_chunks(chunk: int):
    """Sketch chunks of a partition summed: a byte per counter, the count's logarithm in tenths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["chunk"].to_pylist(), b["counts"], strict=True):
                part = np.frombuffer(pa.decompress(c.as_py(), chunk, codec="zstd"), np.uint8)
                sums[k] = sums.get(k, 0) + part.astype(np.uint64)
        for k, v in sums.items():
            level = np.minimum(np.log1p(v.astype(np.float64)) * 10, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "levels"])

    return tidy(run)


def fragment_borders(levels: np.ndarray, fragments: int) -> np.ndarray:
    """Where the global order (place()) is cut, so that fragments hold about as many shingle occurrences."""
    weight = np.bincount(levels, minlength=256) * np.expm1(np.arange(256) / 10)
    upto = np.cumsum(weight)
    out = []
    for f in range(1, fragments):
        goal = upto[-1] * f / fragments
        level = int(np.searchsorted(upto, goal))
        inside = (goal - (upto[level] - weight[level])) / weight[level] if level < 256 and weight[level] else 0.0
        out.append((min(level, 255) << 56) + min(int(inside * (1 << 56)), (1 << 56) - 1))
    return np.array(out, np.uint64)


def place(s: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """Places of shingles in the global order: level, then hash."""
    return (levels[_spots(s, bits)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))


#: Marks of grams as a Bloom filter of two hashes: its parts, bits for each gram, and the logarithm of its bits at most.
PARTS, MARK_BITS, MOST_MARKS = 64, 12, 28


def _marked(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each gram in a filter of 2**bits; the high bits of a gram tell the part that has them."""
    part = grams & ~np.uint64((1 << 58) - 1)
    once = mix(grams)
    return tuple(((part | (h >> np.uint64(6))) >> np.uint64(64 - bits)).astype(np.int64) for h in (once, mix(once + _N)))


def _mark(bits: int):
    """Parts of the filter, from rows (part, gram) of which a task has all of a part."""
    size = 1 << (bits - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for spots in _marked(b["gram"].to_numpy().view(np.uint64), bits):
                for p in np.unique(spots // size).tolist():
                    parts.setdefault(p, np.zeros(size, np.uint8))[spots[spots // size == p] % size] = 1
        for p, found in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], names=["part", "marks"])

    return tidy(run)


def marks_of(common: DataFrame) -> tuple[int, bytes]:
    """A filter that holds the grams of a materialised table: log2 of its bits, and its bytes (2**MOST_MARKS / 8 at most)."""
    bits = min(max(12, (MARK_BITS * common.facts["rows"]).bit_length()), MOST_MARKS)
    parts = common.select(F.shiftrightunsigned("gram", 58).alias("part"), "gram").repartition("part").mapInArrow(_mark(bits), "part int, marks binary")
    size = (1 << (bits - 6)) // 8
    whole = bytearray(PARTS * size)
    for r in parts.collect():
        whole[r.part * size : (r.part + 1) * size] = r.marks
    return bits, bytes(whole)


def _prefixes(size: int, percent: int, bits: int, sketch, marks=None):
    """(gram, d1, d2, at: the gram's place in its set) of the prefixes; with ``marks`` only of grams that they may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = np.frombuffer(sketch.value, np.uint8), set()
        for b in slices(batches):
            grams, keys, many = [], [], []
            for _, s in shingle_sets(b["text"], size):
                if not len(s) or (key := digest(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(key)
                p = len(s) - -(-percent * len(s) // 100) + 1
                order = np.argsort(levels[_spots(s, bits)], kind="stable")  # the set is sorted by hash
                grams.append(s[order[:p]])
                keys.append(key)
                many.append(p)
            if grams:
                told, d = np.concatenate(grams), np.repeat(np.array(keys, np.int64), many, axis=0)
                at = np.concatenate([np.arange(p, dtype=np.int32) for p in many])
                if marks is not None:
                    log, held = marks.value
                    kept = np.ones(len(told), bool)
                    for spots in _marked(told, log):
                        kept &= (np.frombuffer(held, np.uint8)[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1 == 1
                    told, d, at = told[kept], d[kept], at[kept]
                yield pa.RecordBatch.from_arrays([pa.array(told.view(np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(at)], names=["gram", "d1", "d2", "at"])

    return tidy(run)


def signature(s: np.ndarray) -> bytes:
    """A bitmap of parities: two of them differ in no more bits than their sets in members. Folded by XOR, a longer one becomes a shorter one."""
    bits = min(max(LEAST_BITMAP, 1 << (8 * len(s) - 1).bit_length()), MOST_BITMAP)
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of the length of the shortest, in words of 64 bits."""
    words = min(map(len, maps)) // 8
    out = np.empty((len(maps), words), np.uint64)
    for row, m in zip(out, maps, strict=True):
        row[:] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0)
    return out


def _facts(size: int, bits: int, sketch, borders: np.ndarray):
    """Rows (d1, d2, fragment, part, bitmap): a bitmap as fragment -1, and the set cut at the borders of the global order."""
    fragments = len(borders) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = np.frombuffer(sketch.value, np.uint8), set()
        for b in slices(batches, 256):
            keys, parts, maps = [], [], []
            for _, s in shingle_sets(b["text"], size):
                if not len(s) or (key := digest(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(key)
                at = place(s, levels, bits)
                order = np.argsort(at, kind="stable")
                keys.append(key)
                parts += [None, *np.split(s[order].view(np.int64), np.searchsorted(at[order], borders))]
                maps += [signature(s), *[None] * fragments]
            if keys:
                d = np.repeat(np.array(keys, np.int64), fragments + 1, axis=0)
                fragment = np.tile(np.arange(-1, fragments, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(fragment), pa.array(parts, pa.list_(pa.int64())), pa.array(maps, pa.binary())], names=["d1", "d2", "fragment", "part", "bitmap"])

    return tidy(run)


def _forest(percent: int, tries: int, cls: np.ndarray, n: np.ndarray, comp: np.ndarray, maps: np.ndarray, refused: set, side: np.ndarray | None) -> Iterator[tuple[int, int, int, int]]:
    """Walk the pairs (a, b and their set sizes) of a bucket that may link, from component to component.

    A component counts as reached after ``tries`` pairs with it were told, and is not compared with what was reached before.
    """
    _, comp = np.unique(comp, return_inverse=True)
    left, told = np.ones(len(cls), bool), np.zeros(len(cls), np.int64)
    for seed in range(len(cls)):
        if not left[seed]:
            continue
        queue = list(np.flatnonzero(comp == comp[seed]))
        left[queue] = False
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return
            if side is not None:
                rest = rest[side[rest] != side[x]]
            low, high = np.minimum(n[rest], n[x]), np.maximum(n[rest], n[x])
            fits = 100 * low >= percent * high
            rest, low = rest[fits], low[fits]
            if not len(rest):
                continue
            apart = np.bitwise_count(maps[rest] ^ maps[x]).sum(axis=1, dtype=np.int64)
            most = np.minimum((n[rest] + n[x] - apart) // 2, low)
            near = 100 * most >= percent * (n[rest] + n[x] - most)
            for y in rest[near][np.argsort(apart[near], kind="stable")]:
                if not left[y]:
                    continue
                pair = (int(min(cls[x], cls[y])), int(max(cls[x], cls[y])))
                if pair in refused:
                    continue
                yield (*pair, int(n[x]), int(n[y])) if cls[x] == pair[0] else (*pair, int(n[y]), int(n[x]))
                told[comp[y]] += 1
                if told[comp[y]] >= tries:
                    more = np.flatnonzero(comp == comp[y])
                    left[more] = False
                    queue.extend(more)


def _walk(percent: int, tries: int):
    """Pairs (a, b, na, nb) to count, from rows sorted by cell: (cell, side, cls, n, comp, bitmap, other).

    A row with ``other`` is a refused pair of the cell; a cell's rows are held at once, which its size bounds.
    """

    def cell(side: np.ndarray, cls: np.ndarray, n: np.ndarray, comp: np.ndarray, other: np.ndarray, maps: list) -> Iterator[tuple[int, int, int, int]]:
        pairs = np.flatnonzero(other >= 0)
        refused = set(zip(cls[pairs].tolist(), other[pairs].tolist(), strict=True))
        members = np.flatnonzero(other < 0)
        cls, at = np.unique(cls[members], return_index=True)
        if len(cls) < 2:
            return
        at = members[at]
        side = side[at]
        yield from _forest(percent, tries, cls, n[at], comp[at], folded([maps[i] for i in at]), refused, side if side.any() and not side.all() else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set = set()

        def out(columns: list):
            new = [p for p in dict.fromkeys(cell(*columns)) if p not in told]
            if len(told) > SEEN:
                told.clear()
            told.update(new)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], names=["a", "b", "na", "nb"])

        last, held = None, []  # the cell that may go on
        for b in batches:
            if not len(b):
                continue
            keys = b["cell"].to_numpy()
            columns = [pc.fill_null(b[c], -1).to_numpy() for c in ("side", "cls", "n", "comp", "other")] + [b["bitmap"].to_pylist()]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if held and last != keys[a]:
                    yield from out(_joined(held))
                    held = []
                last = keys[a]
                held.append([c[a:z] for c in columns])
        if held:
            yield from out(_joined(held))

    return tidy(run)


def _joined(parts: list[list]) -> list:
    if len(parts) == 1:
        return parts[0]
    return [*(np.concatenate(c) for c in list(zip(*parts, strict=True))[:-1]), [m for p in parts for m in p[-1]]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a partition as stars around the smallest node of each of its components."""
    edges = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, ends = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), return_inverse=True)
    root = np.arange(len(nodes))
    u, v = ends[: len(edges)], ends[len(edges) :]
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    for a in range(0, len(own), 1 << 16):
        some = own[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["u", "v"])


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """(cls, comp) of every node of ``edges`` (a, b): its component's smallest node. Materialised.

    Each task contracts ``per_task`` edges to stars. What several tasks leave is joined by
    alternating large and small stars, whose steps are aggregates and joins on narrow rows,
    until the least neighbour of every node is the least of its edges.
    """
    plain = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    both = materialize(plain, "edges")
    while True:
        parts = -(-both.facts["rows"] // per_task) or 1
        stars = materialize(both.repartition(parts).mapInArrow(tidy(_contract), "u long, v long"), "stars")
        drop(both)
        if parts == 1:
            break
        mirrored = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = mirrored.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(mirrored.join(low, "u").select("u", "v", "m"), "large", open=F.count_if(F.col("m") != F.least("u", "v")))
        if not large.facts["open"]:
            drop(large)
            break
        far = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        joined = far.join(low, "u")
        both = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v")))
        both = materialize(both.filter("u <> v").distinct(), "edges")
        drop(stars, large)
    roots = stars.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct()
    out = materialize(stars.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionAll(roots), "comp")
    drop(stars)
    return out


def count_overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, na, nb, both): the overlap of each pair, summed over fragments that are counted one by one."""
    left = segments.join(small(pairs), F.col("cls") == F.col("a")).select("a", "b", "na", "nb", "fragment", F.col("part").alias("part_a"))
    second = pairs.select("b")
    second.facts = pairs.facts
    right = segments.join(small(second), F.col("cls") == F.col("b"), "left_semi").select(F.col("cls").alias("b"), "fragment", F.col("part").alias("part_b"))
    partial = left.join(right, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("part_a", "part_b")).alias("n"))
    # a class may be there twice if its document id is: the fragment counts once
    once = partial.repartition("a", "b").groupBy("a", "b", "na", "nb", "fragment").agg(F.max("n").alias("n"))
    return once.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("both"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


@dataclass
class _Join:
    """What is known of the pairs: links and refused pairs by exact count, and components (cls, comp) of the links."""

    percent: int
    maps: DataFrame
    segments: DataFrame
    links: list[DataFrame] = field(default_factory=list)
    refused: list[DataFrame] = field(default_factory=list)
    comp: DataFrame | None = None

    def with_comp(self, rows: DataFrame) -> DataFrame:
        if self.comp is None:
            return rows.withColumn("comp", F.col("cls"))
        return rows.join(small(self.comp), "cls", "left_outer").withColumn("comp", F.coalesce("comp", "cls"))

    def refused_in(self, cells: DataFrame, pairs: list[DataFrame]) -> DataFrame:
        """(cell, cls, other): refused pairs with both ends in a cell."""
        mine = cells.select("cell", F.col("cls").alias("a"))
        theirs = cells.select("cell", F.col("cls").alias("b"))
        return _union(pairs).join(mine, "a").join(theirs, ["cell", "b"]).select("cell", F.col("a").alias("cls"), F.col("b").alias("other"))

    def settle(self, cells: DataFrame) -> None:
        """Walk ``cells`` (cell, side, cls, n; materialised) until none has a pair left that may link."""
        tries, now = 1, cells
        while True:
            rows = self.with_comp(now)
            rows.facts = now.facts  # few cells go to the bitmaps, so these are not shuffled
            rows = small(rows).join(self.maps, "cls").select("cell", "side", "cls", "n", "comp", "bitmap", F.lit(None).cast("long").alias("other"))
            if self.refused:
                no = self.refused_in(now, self.refused)
                rows = rows.unionByName(no.select("cell", "cls", "other"), allowMissingColumns=True)
            pairs = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_walk(self.percent, tries), "a long, b long, na long, nb long")
            pairs = materialize(pairs.distinct(), "pairs")
            if not pairs.facts["rows"]:
                return drop(pairs, now if now is not cells else None)
            linked = F.col("both") * 100 >= F.lit(self.percent) * (F.col("na") + F.col("nb") - F.col("both"))
            counted = count_overlaps(pairs, self.segments).select("a", "b", linked.alias("linked"))
            counted = materialize(counted, "counted", no=F.count_if(~F.col("linked")), yes=F.count_if("linked"))
            drop(pairs)
            if counted.facts["yes"]:
                self.links.append(counted.filter("linked").select("a", "b"))
                before, self.comp = self.comp, components(_union(self.links))
                drop(before)
            if not counted.facts["no"]:
                return drop(now if now is not cells else None)
            no = counted.filter("not linked").select("a", "b")
            self.refused.append(no)
            # where the ends of all refused pairs have met all the same, the cell's forest still spans what may link
            apart = self.with_comp(no.withColumnRenamed("a", "cls")).withColumnsRenamed({"cls": "a", "comp": "ca", "b": "cls"})
            apart = self.with_comp(apart).filter("ca <> comp").select("a", F.col("cls").alias("b"))
            touched = self.refused_in(now, [apart]).select("cell").distinct()
            again = materialize(now.join(touched, "cell", "left_semi").select("cell", "side", "cls", "n"), "cells")
            drop(now if now is not cells else None)
            now = again
            tries *= 8


def _dealt(rows: DataFrame, blocks: Column, shared: Column) -> DataFrame:
    """Cells of rows (bucket, cls, n, ...): a block of its bucket for each, all blocks for a shared one."""
    mine = F.pmod(F.xxhash64("cls"), blocks)
    every = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.xxhash64("bucket", k))
    cells = F.when(shared, every).otherwise(F.array(F.xxhash64("bucket", mine)))
    return rows.select(F.explode(cells).alias("cell"), F.lit(0).alias("side"), "cls", "n")


def _giants(found: _Join, members: DataFrame) -> DataFrame:
    """(bucket, giant, inner, outer) of buckets in several components: the largest, its classes and the others. Materialised."""
    per = found.with_comp(members).groupBy("bucket", "comp").count()
    giant = per.groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("giant"), F.max("count").alias("inner"), (F.sum("count") - F.max("count")).alias("outer"))
    return materialize(giant.filter("outer > 0"), "giants", most=F.max("outer"))


def _settle_large(found: _Join, members: DataFrame, block: int) -> None:
    """What the hosts (bucket, cls, n) of large buckets still have in several components."""
    giants = _giants(found, members)
    if giants.facts["most"] > 4 * block and found.links:
        # the classes with most links so far reach most of the rest
        degree = _union(found.links).select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").count()
        order = Window.partitionBy("bucket").orderBy(F.desc("count"), "cls")
        hubs = members.join(small(giants), "bucket", "left_semi").join(degree, "cls").withColumn("nth", F.row_number().over(order))
        hubs = materialize(hubs.filter(F.col("nth") <= SHARED).select("bucket", "cls", F.lit(True).alias("hub")), "hubs")
        outside = found.with_comp(members).join(small(giants), "bucket").join(small(hubs), ["bucket", "cls"], "left_outer").withColumn("hub", F.coalesce("hub", F.lit(False)))
        outside = outside.filter((F.col("comp") != F.col("giant")) | F.col("hub"))
        second = materialize(_dealt(outside, F.ceil(F.col("outer") / block), F.col("hub")), "second")
        drop(hubs, giants)
        found.settle(second)
        drop(second)
        giants = _giants(found, members)
    if giants.facts["rows"]:
        inside, outer, inner = F.col("comp") == F.col("giant"), F.ceil(F.col("outer") / block), F.ceil(F.col("inner") / block)
        at = found.with_comp(members).join(small(giants), "bucket")
        # blocks outside are 0, 1, ..., those inside -1, -2, ...; no pair of two inside
        at = at.withColumn("mine", F.when(inside, -1 - F.pmod(F.xxhash64("cls"), inner)).otherwise(F.pmod(F.xxhash64("cls"), outer)))
        at = at.withColumn("other", F.explode(F.sequence(F.when(inside, F.lit(0).cast("long")).otherwise(-inner), outer - 1)))
        cell = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
        third = materialize(at.select(cell.alias("cell"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "cls", "n"), "third")
        found.settle(third)
        drop(third)
    drop(giants)


def _settle_guests(found: _Join, members: DataFrame, block: int) -> None:
    """Pairs of a guest and a host of large buckets (bucket, cls, n, reach).

    Hosts are cut to blocks in order of size. A guest goes to those blocks that have a host within its
    reach, of its size or not much smaller, which reaches it too, unless all there is of its component.
    """
    hosts, guests = members.filter("reach >= n"), members.filter("reach < n")
    upto = Window.partitionBy("bucket").orderBy("n")
    sizes = hosts.groupBy("bucket", "n").count().withColumn("base", F.sum("count").over(upto) - F.col("count"))
    sizes = materialize(sizes, "host-sizes")
    nth = F.floor((F.col("base") + F.pmod(F.xxhash64("cls"), F.col("count"))) / block)
    placed = materialize(found.with_comp(hosts).join(small(sizes), ["bucket", "n"]).select("bucket", nth.alias("nth"), "cls", "n", "reach", "comp"), "hosts")
    ends = [F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("far"), F.min("comp").alias("low"), F.max("comp").alias("high")]
    blocks = materialize(placed.groupBy("bucket", "nth").agg(*ends), "blocks")
    meet = (F.col("least") <= F.col("reach")) & (F.col("n") <= F.col("far")) & (100 * F.col("most") >= found.percent * F.col("n"))
    apart = (F.col("low") != F.col("comp")) | (F.col("high") != F.col("comp"))
    visits = materialize(found.with_comp(guests).join(small(blocks), "bucket").filter(meet & apart).select("bucket", "nth", "cls", "n"), "visits")
    if visits.facts["rows"]:
        parts = materialize(visits.groupBy("bucket", "nth").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), "parts")
        part = F.pmod(F.xxhash64("cls"), F.col("parts"))
        there = visits.join(small(parts), ["bucket", "nth"]).select(F.xxhash64("bucket", "nth", part).alias("cell"), F.lit(1).alias("side"), "cls", "n")
        here = placed.join(small(parts), ["bucket", "nth"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cells = materialize(there.unionAll(here.select(F.xxhash64("bucket", "nth", "part").alias("cell"), F.lit(0).alias("side"), "cls", "n")), "guests")
        found.settle(cells)
        drop(cells, parts)
    drop(visits, blocks, placed, sizes)


def links_of(docs: DataFrame, size: int = 4, percent: int = 85, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(profile: doc_id, n, d1, d2 per row; components: d1, d2, comp of the classes that link with another, or None)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    letters = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(LEAST_BITS, (letters // 64).bit_length()), MOST_BITS)  # a word has some six letters, and a counter some ten shingles
    chunk = 1 << min(bits, CHUNK_BITS)
    told = materialize(rows.mapInArrow(_profile(size, bits), "doc_id long, n long, d1 long, d2 long, chunk int, counts binary"), "profile")
    profile = told.filter("chunk is null").select("doc_id", "n", "d1", "d2")
    merged = told.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_sum_chunks(chunk), "chunk int, levels binary")
    whole = np.zeros(1 << bits, np.uint8)
    for r in merged.collect():  # 2**MOST_BITS bytes at most
        whole[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(r.levels, np.uint8)
    borders = fragment_borders(whole, FRAGMENTS)
    sketch = spark.sparkContext.broadcast(whole.tobytes())
    del whole

    prefixes = rows.mapInArrow(_prefixes(size, percent, bits, sketch), "gram long, d1 long, d2 long, at int")
    # of two classes at least (or, which is found out below, of one that several tasks told)
    common = materialize(prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("gram"), "common")
    if not common.facts["rows"]:
        sketch.destroy()
        drop(common)
        return profile, None
    marks = spark.sparkContext.broadcast(marks_of(common))
    prefixes = rows.mapInArrow(_prefixes(size, percent, bits, sketch, marks), "gram long, d1 long, d2 long, at int")
    shared = materialize(prefixes.join(small(common), "gram").distinct(), "shared")
    marks.destroy()
    drop(common)
    chosen = shared.select("d1", "d2").distinct()
    classes = profile.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")).join(chosen, ["d1", "d2"], "left_semi")
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    # sets that link are of the same or the next band of sizes, so a cell is a shingle and two bands
    step = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1e-6
    band = F.floor(F.log(F.col("n")) / F.lit(step))
    # the largest set it can share enough with, where all they share comes from this place on
    reach = F.expr(f"((n - at) * {100 + percent} - n * {percent}) div {percent}")
    member = F.struct("cls", "n", reach.alias("reach")).alias("member")
    cells = shared.join(_part(classes, "d1", "d2", "cls", "n"), ["d1", "d2"]).select(F.explode(F.array(F.xxhash64("gram", band), F.xxhash64("gram", band + 1))).alias("cell"), member)
    names = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("member.cls")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "member.cls"), 32)).alias("s"))
    names = names.filter("many > 1").select("cell", F.xxhash64("many", "x", "s").alias("bucket"))
    buckets = materialize(cells.join(names, "cell").select("bucket", "member.*").groupBy("bucket", "cls", "n").agg(F.max("reach").alias("reach")), "buckets")
    drop(shared)

    # texts of one document of each class in a bucket (and of others that share its id)
    near = classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select("d1", "d2", "cls", "rep")
    near = materialize(near, "near")
    texts = rows.join(_part(near, "rep"), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    facts = texts.mapInArrow(_facts(size, bits, sketch, borders), "d1 long, d2 long, fragment int, part array<long>, bitmap binary")
    facts = materialize(facts.join(_part(near, "d1", "d2", "cls"), ["d1", "d2"]).drop("d1", "d2"), "facts", maps=F.sum(F.octet_length("bitmap") + 16))
    sketch.destroy()
    maps = facts.filter("fragment = -1").select("cls", "bitmap")
    maps.facts = {"bytes": facts.facts["maps"]}

    found = _Join(percent, small(maps), facts.filter("fragment >= 0").select("cls", "fragment", "part"))
    hosts = F.count_if(F.col("reach") >= F.col("n"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), hosts.alias("size")).filter(F.col("many") > block)
    sizes = materialize(sizes.select("bucket", F.ceil(F.col("size") / block).alias("blocks"), "size"), "sizes")
    plain = buckets.select(F.col("bucket").alias("cell"), F.lit(0).alias("side"), "cls", "n")
    if not sizes.facts["rows"]:
        plain.facts = buckets.facts
        found.settle(plain)
    else:
        large = materialize(buckets.join(small(sizes), "bucket"), "large")
        pivot = F.pmod(F.xxhash64(F.lit(7), "cls"), F.ceil(F.col("size") / SHARED)) == 0
        inner = large.filter("reach >= n")
        first = plain.join(_part(sizes, "bucket").withColumnRenamed("bucket", "cell"), "cell", "left_anti").unionAll(_dealt(inner, F.col("blocks"), pivot))
        first = materialize(first, "cells")
        found.settle(first)
        drop(first)
        _settle_large(found, inner.select("bucket", "cls", "n"), block)
        _settle_guests(found, large.select("bucket", "cls", "n", "reach"), block)
        drop(large)
    if found.comp is None:
        return profile, None
    comp = materialize(found.comp.join(classes.select("cls", "d1", "d2"), "cls").select("d1", "d2", "comp"), "comp")
    drop(buckets, sizes, facts, near, classes)
    return profile, comp


def _part(table: DataFrame, *names: str) -> DataFrame:
    """Columns of a materialised table, broadcast if the table is small."""
    part = table.select(*names)
    part.facts = table.facts
    return small(part)


def join_components(docs: DataFrame, size: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link from ``percent`` of Jaccard similarity."""
    profile, comp = links_of(docs, size, percent, block)
    if comp is None:
        labelled = profile.withColumns({"l1": F.col("d1"), "l2": F.col("d2")})
    else:
        # a component that links counts as the class (comp, null)
        known = small(comp)
        labelled = profile.join(known, ["d1", "d2"], "left_outer").withColumns({"l1": F.coalesce("comp", "d1"), "l2": F.when(F.col("comp").isNull(), F.col("d2"))})
    groups = labelled.filter("n > 0").groupBy("l1", "l2").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("many"))
    groups = small(materialize(groups.filter("many > 1").select(F.col("l1").alias("g1"), F.col("l2").alias("g2"), "component_id"), "groups"))
    own = labelled.join(groups, (F.col("l1") == F.col("g1")) & F.col("l2").eqNullSafe(F.col("g2")) & (F.col("n") > 0), "left_outer")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; of rows that share the smallest id all stay."""
    names = docs.columns
    found = join_components(docs, size, percent)
    gone = small(materialize(found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(*names)
