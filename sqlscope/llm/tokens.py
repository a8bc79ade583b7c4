"""Token ids in a patched frame-of-reference file format, as a Spark data source ("pfor").

A file holds blocks of 1,024 ids. A block stores its minimum, the differences to
it packed at the bit width that a percentile of them needs, and the rest as
exceptions (position, high bits). A footer indexes where blocks start and which
document has which ids, so a run of documents is read without the rest.

    file    : "PFT1" block* footer length-of-footer(u64) "PFT1"
    block   : minimum u32, width u8, ids u16, exceptions u16, packed bits, positions u16*, high bits u32*
    footer  : zlib of JSON {"n_ids", "blocks": [offset...], "docs": [[id, first, ids]...]}

Writing takes rows (doc_id, text) sorted inside partitions whose order is the
order of the ids; it encodes, appends the end id and packs as it goes. Reading
returns (doc_id, start, n_tokens, ids_crc32[, ids]).

Vocabularies that drop white space are encoded word by word (a long text in pieces
cut between words); others, whose tokens carry blanks, by whole texts.

Defined results: a null text is empty and has the end id alone; null ids come
first; rows with equal ids are ordered by a hash of their texts, and equal rows
follow each other; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sqlscope.llm import files
from sqlscope.llm.common import scratch_path, slices, split_words, text_pieces

MAGIC, BLOCK = b"PFT1", 1024
_HEAD = struct.Struct("<IBHH")
#: Words whose ids a worker remembers (about 40 bytes each); the memory starts again beyond.
REMEMBERED = 2_500_000
#: Words of letters that are kept for their marked forms; as many older ones stay beside them.
STEMS = 150_000
#: Widths at which packed bits are whole little-endian numbers.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values, one after another from the lowest bit on: a row of bytes each."""
    if width in _WHOLE:
        return np.ascontiguousarray(values.astype(_WHOLE[width])).view(np.uint8).reshape(len(values), -1)
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def pack_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """Blocks of ``ids`` (u32), the last one shorter perhaps."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK
    if whole:
        grid = ids[: whole * BLOCK].reshape(whole, BLOCK)
        low = grid.min(axis=1)
        rest = grid - low[:, None]
        at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
        bound = np.partition(rest, at, axis=1)[:, at]
        widths = np.frexp(bound.astype(np.float64))[1]
        done: dict[int, bytes] = {}
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            for r, p in zip(rows, pack_bits(rest[rows], int(w)), strict=True):
                high = rest[r] >> np.uint32(w) if w < 32 else np.zeros(BLOCK, np.uint32)
                spots = np.flatnonzero(high)
                done[int(r)] = _HEAD.pack(int(low[r]), int(w), BLOCK, len(spots)) + p.tobytes() + spots.astype("<u2").tobytes() + high[spots].astype("<u4").tobytes()
        out += [done[r] for r in range(whole)]
    tail = ids[whole * BLOCK :]
    if len(tail):
        low = int(tail.min())
        rest = tail - np.uint32(low)
        w = int(np.sort(rest)[max(0, int(np.ceil(percentile * len(tail))) - 1)]).bit_length()
        high = rest >> np.uint32(w) if w < 32 else np.zeros(len(tail), np.uint32)
        spots = np.flatnonzero(high)
        out.append(_HEAD.pack(low, w, len(tail), len(spots)) + pack_bits(rest[None, :], w)[0].tobytes() + spots.astype("<u2").tobytes() + high[spots].astype("<u4").tobytes())
    return out


def unpack_block(data: memoryview | bytes, at: int = 0) -> np.ndarray:
    low, w, n, spots = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = -(-n * w // 8)
    if w in _WHOLE:
        ids = np.frombuffer(data, _WHOLE[w], n, at).astype(np.uint32)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * w].reshape(n, w)
        ids = np.zeros(n, np.uint32)
        for k in range(w):
            ids |= bits[:, k].astype(np.uint32) << np.uint32(k)
    if spots:
        where = np.frombuffer(data, "<u2", spots, at + size)
        ids[where] |= np.frombuffer(data, "<u4", spots, at + size + 2 * spots) << np.uint32(w)
    return ids + np.uint32(low)


#: Byte-level vocabularies write a byte as a visible character: those of Latin-1 that are visible stay, the others follow from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_BYTE_CHAR = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}


def byte_level(word: str) -> str:
    return word.encode().decode("latin-1").translate(_BYTE_CHAR)


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x0A]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes whose words are hashed at once; longer words than LONG are told apart by themselves.
PIECE, LONG = 1 << 20, 255


class Encoder:
    """Token ids of texts. Where the vocabulary drops white space and so no token spans it (``by_word``), what
    lies between blanks and line ends is encoded once and remembered by a 64-bit hash. Words of Latin letters
    then go to the model directly in lower case, marks behind them apart, if the vocabulary splits them so
    (``direct``); all else takes the whole way. Both are held against whole texts when a vocabulary is loaded."""

    _LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
    #: Letters, then marks that the vocabulary takes as one run (an apostrophe may start a piece of its own).
    _MARKED = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]+)")

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        state = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (state.get("normalizer") or {}).get("normalizers", [])]
        suffix = state["model"].get("end_of_word_suffix")
        #: Whether words may go to the model: BPE with word ends over lower-cased text, split at letters.
        self.direct = state["model"]["type"] == "BPE" and bool(suffix) and "Lowercase" in kinds and not state["model"].get("continuing_subword_prefix")
        first = state.get("pre_tokenizer") or {}
        first = (first.get("pretokenizers") or [first])[0]
        #: Whether white space only parts words: so by its kind, and by what it does to these texts.
        self.by_word = first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (first.get("type") == "Split" and first.get("behavior") == "Removed")
        self.model = self.tokenizer.model
        self.base: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.forget()
        whole, many = self._whole, [x.split() for x in self._PROBES]
        self.by_word = self.by_word and all(whole(x) == b"".join(map(whole, w)) for x, w in zip(self._PROBES, many, strict=True))
        self.direct = self.direct and self.by_word and all(self.encode(x) == whole(x) for w in many for x in w)

    _PROBES = ("a b", " a  b ", "\na\n\nb c\n", "The end. \n It's -- 'x' don't!", "word! two-part a.b, (in) x' Na\u00efve \u00c9T\u00c9?", " 12 a1 1a \u4f60\u597d b\u4f60 ", "", " ")

    def forget(self) -> None:
        """Start the numbering again."""
        #: Hashes in order, and beside each the number of its word; ids, their start and their count by number.
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters, packed."""
        ids = self.base.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = packed([t.id for t in self.model.tokenize(word if word.isascii() else byte_level(word))])
            if len(self.base) >= STEMS:
                self.older, self.base = self.base, {}
            self.base[word] = ids
        return ids

    def encode(self, word: str) -> bytes:
        if self.direct:
            low = word.lower()
            if self._LETTERS.fullmatch(low):
                return self._word(low)
            if m := self._MARKED.fullmatch(low):
                marks = self.marks.get(m[2])
                if marks is None:
                    marks = self._whole(m[2])
                    if len(self.marks) < 10_000:
                        self.marks[m[2]] = marks
                return self._word(m[1]) + marks if m[1] else marks
        return self._whole(word)

    def _whole(self, word: str) -> bytes:
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and where each text's begin."""
        raw = data.tobytes()
        if self.direct and b"<|" not in raw:  # special tokens are told apart by case
            data = _LOWER[data]
            raw = data.tobytes()
        start, end, found = split_words(data, ~_GAP[data], offsets)
        distinct, first, inverse = np.unique(found, return_index=True, return_inverse=True)
        if len(self.start) + len(distinct) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.keys, distinct)
        numbers = np.full(len(distinct), -1, np.int64)
        inner = np.flatnonzero(spot < len(self.keys))
        inner = inner[self.keys[spot[inner]] == distinct[inner]]
        numbers[inner] = self.number[spot[inner]]
        missing = np.flatnonzero(numbers < 0)
        known = len(self.start)
        new = [self.encode(raw[a:z].decode()) for a, z in zip(start[first[missing]].tolist(), end[first[missing]].tolist(), strict=True)]
        numbers[missing] = known + np.arange(len(missing))
        self.keys, self.number = np.insert(self.keys, spot[missing], distinct[missing]), np.insert(self.number, spot[missing], numbers[missing])
        words = numbers[inverse]
        for i in np.flatnonzero(end - start > LONG):
            words[i] = known + len(new)
            new.append(self.encode(raw[start[i] : end[i]].decode()))
        if new:
            lengths = np.fromiter(map(len, new), np.int64, len(new)) // 4
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(new), np.uint32)])
        return words, np.searchsorted(start, offsets)

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, and how many each has."""
        words, at = self._numbers(data, offsets)
        size = self.length[words]
        before = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(int(before[-1]))
        return self.flat[place + np.repeat(self.start[words] - before[:-1], size)], np.diff(before[at])

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has; a null text is empty."""
        if not self.by_word:
            found = [np.array([*e.ids, end_id], np.uint32) for t in texts.to_pylist() for e in self.tokenizer.encode_batch([t or ""], add_special_tokens=False)]
            return (np.concatenate(found), np.array([len(x) for x in found], np.int64)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        out, counts, mark = [], [], np.array([end_id], np.uint32)
        for i, j, data, offsets in text_pieces(pc.fill_null(texts, ""), PIECE):
            if len(data) <= PIECE:
                ids, many = self._ids(data, offsets)
                out.append(np.insert(ids, np.cumsum(many), end_id))
                counts.append(many + 1)
                continue
            total, at = 1, 0  # one long text, cut between words
            while at < len(data):
                stop = min(at + PIECE, len(data))
                while stop < len(data) and not _GAP[data[stop]]:
                    more = np.flatnonzero(_GAP[data[stop : stop + PIECE]])
                    stop = stop + int(more[0]) if len(more) else min(stop + PIECE, len(data))
                out.append(self._ids(data[at:stop], np.array([0, stop - at]))[0])
                total += len(out[-1])
                at = stop
            out.append(mark)
            counts.append(np.array([total]))
        return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """One per worker, so that tasks after the first know most words."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


@dataclass
class _Written(WriterCommitMessage):
    entries: list


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.tokenizer, self.end_id = options["tokenizer"], int(options.get("end_id", "1"))
        self.percentile = float(options.get("percentile", "0.9"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, at, n_ids, blocks, docs = None, len(MAGIC), 0, [], []
        waiting, held = [], 0
        encode = name = None

        def flush(last: bool) -> None:
            nonlocal at, waiting, held
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            n = len(ids) if last else len(ids) // BLOCK * BLOCK
            for b in pack_blocks(ids[:n], self.percentile):
                blocks.append(at)
                out.write(b)
                at += len(b)
            waiting, held = [ids[n:]], len(ids) - n

        for batch in slices(iterator):
            if not len(batch):
                continue
            if out is None:
                system, folder, name = files.new_file(self.path, ".pft")
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(MAGIC)
                encode = encoder(self.tokenizer)
            ids, many = encode(batch.column(1), self.end_id)
            starts = n_ids + np.cumsum(many) - many
            docs += zip(batch.column(0).to_pylist(), starts.tolist(), many.tolist(), strict=True)
            n_ids += len(ids)
            waiting.append(ids)
            held += len(ids)
            if held >= 1 << 18:
                flush(False)
        if out is None:
            return _Written([])
        flush(True)
        footer = zlib.compress(json.dumps({"n_ids": n_ids, "blocks": blocks, "docs": docs}).encode(), 6)
        out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        out.close()
        return _Written([{"part": part, "file": name, "n_ids": n_ids, "n_docs": len(docs)}])

    def commit(self, messages: list) -> None:
        found = sorted((e for m in messages if m for e in m.entries), key=lambda e: e["part"])
        files.write_manifest(self.path, found, self.overwrite)

    def abort(self, messages: list) -> None:
        files.delete(self.path, [e["file"] for m in messages if m for e in m.entries])


@dataclass
class _Part(InputPartition):
    file: str
    base: int
    first: int
    last: int


class TokenReader(DataSourceReader):
    """A partition per run of ``docs_per_partition`` documents of a file."""

    def __init__(self, options: dict):
        self.path, self.ids = options["path"], options.get("ids", "false") == "true"
        self.step = int(options.get("docs_per_partition", "65536"))

    def partitions(self) -> list[InputPartition]:
        out, base = [], 0
        _, folder = files.open_fs(self.path)
        for e in files.read_manifest(self.path) or []:
            out += [_Part(f"{folder}/{e['file']}", base, a, min(a + self.step, e["n_docs"])) for a in range(0, e["n_docs"], self.step)]
            base += e["n_ids"]
        return out or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = files.open_fs(self.path)
        with system.open_input_file(partition.file) as f:
            size = f.size()
            f.seek(size - 12)
            (length,) = struct.unpack("<Q", f.read(8))
            f.seek(size - 12 - length)
            footer = json.loads(zlib.decompress(f.read(length)))
            ends = [*footer["blocks"], size - 12 - length]
            docs, i = footer["docs"][partition.first : partition.last], 0
            while i < len(docs):
                j, first = i + 1, docs[i][1]
                while j < len(docs) and docs[j][1] + docs[j][2] - first <= 1 << 20:
                    j += 1
                upto = docs[j - 1][1] + docs[j - 1][2]
                a, z = first // BLOCK, -(-upto // BLOCK)
                f.seek(ends[a])
                data = f.read(ends[z] - ends[a])
                ids = np.concatenate([unpack_block(data, ends[k] - ends[a]) for k in range(a, z)]).astype("<u4")[first - a * BLOCK : upto - a * BLOCK]
                own = [ids[d[1] - first : d[1] - first + d[2]] for d in docs[i:j]]
                cols = [
                    pa.array([d[0] for d in docs[i:j]], pa.int64()),
                    pa.array([partition.base + d[1] for d in docs[i:j]], pa.int64()),
                    pa.array([d[2] for d in docs[i:j]], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if self.ids:
                    cols.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * self.ids])
                i = j


class TokenDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pfor"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if self.options.get("ids") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenDataSource)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, percentile: float = 0.9) -> None:
    """Token files of ``docs`` in the order of doc_id. Texts are shuffled once, by ranges of the id."""
    register(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.write.format("pfor").mode("append").option("tokenizer", tokenizer).option("end_id", str(end_id)).option("percentile", str(percentile)).save(path)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write token files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return spark.read.format("pfor").load(path)
