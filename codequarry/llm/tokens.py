"""Token ids in binary files: blocks of a static range asymmetric numeral system.

A store is two Parquet tables in one folder.  ``table`` holds the shared frequency table, once:
the symbols that occur and their frequencies, which add up to 2^SCALE.  ``blocks`` holds the
blocks: ``shard`` and ``block`` order them, and each carries whole documents (their ids and
numbers of tokens) and one coded payload that is decoded without any other block.

A payload is ``LANES`` interleaved coders: token i of a block belongs to lane i mod LANES.  Its
layout, little-endian, is

    magic "RNS1", tokens (u32), words (u32), checkpoints (u32),
    crc32 of the token ids (u32), crc32 of the rest (u32),
    per checkpoint: token offset (u32), word offset (u32), LANES states (u64),
    words (u32).

A checkpoint holds the decoder's state before a token offset that is a multiple of LANES, so a
reader may start there, and several readers may share a block.  The first one, at zero, always
exists.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codequarry.llm.common import kept_in_worker, slices
from codequarry.session import scratch_path

SCALE = 20  # frequencies add up to 2^SCALE; symbols must be fewer
LANES = 1024
LOW = 1 << 31  # states stay in [LOW, LOW * 2^32)
CHECKPOINT = 128 * LANES  # tokens between checkpoints
BLOCK = 1 << 18  # tokens after which a block ends, at a document's end
_HEAD, _HEAD_BYTES = "<4sIIIII", 24


# ---- tokenizer ---------------------------------------------------------------------------------


class WordMemo:
    """Encodes texts by their words, each word by the tokenizers library and remembered.

    For tokenizers that lower-case, drop white space and split at it by ``PATTERN``, so that a text's ids are
    those of its words; whether a file is one is read from its settings, and any other tokenizer gets whole texts.  Arrow lower-cases and splits a batch and finds its distinct words; a word
    of plain letters, digits and marks is cut into the runs that the tokenizer's own pattern makes
    of it, which go to its model; other words go through the whole tokenizer, and so do texts with
    special tokens or with characters beyond U+00FF.  Words are kept in two generations of at most
    ``FULL``, so a worker's memory is bounded.
    """

    FULL = 400_000
    MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe, which some tokenizers treat apart
    LOWER = "a-zß-öø-ÿ"

    # The settings of tokenizers that encode word by word.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        normalizer, split = (self._settings(part) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.by_words = (
            normalizer.get("normalizers") == self.NORMALIZER and split.get("pretokenizers") == self.SPLIT
            and self.tokenizer.post_processor is None and not self.tokenizer.model.dropout
            and all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        )
        self.whole = re.compile(f"[{self.LOWER}0-9{self.MARKS}]+").fullmatch
        self.runs = re.compile(f"[{self.LOWER}]+|[0-9]|[{self.MARKS}]+").findall
        self.letters = _byte_letters()
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.id_bytes = [np.array([i], self.kind).tobytes() for i in range(size)]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _settings(part) -> dict:
        """The settings of a part of the tokenizer, without its vocabulary."""
        return json.loads(part.__getstate__()) if part is not None else {}

    def _run(self, run: str) -> bytes:
        text = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        one = self.id_bytes
        return b"".join([one[t.id] for t in self.tokenizer.model.tokenize(text)])

    def _ids(self, distinct: list[str]) -> list[bytes]:
        """The ids of each of some distinct words."""
        if len(self.words) > self.FULL:
            self.words, self.older = {}, self.words
        words, older, other = self.words, self.older, []
        out = list(map(words.get, distinct))
        for n, ids in enumerate(out):
            if ids is not None:
                continue
            word = distinct[n]
            known = older.get(word)
            if known is not None:
                words[word] = out[n] = known
            elif not word:
                words[word] = out[n] = b""
            elif word.isascii() and word.isalpha():
                words[word] = out[n] = self._run(word)
            elif self.whole(word):
                runs = self.runs(word)
                known = self._run(word) if len(runs) == 1 else b"".join([words.get(r) or self._run(r) for r in runs])
                words[word] = out[n] = known
            else:
                other.append(n)
        for n, ids in zip(other, self._all([distinct[n] for n in other]), strict=True):
            words[distinct[n]] = out[n] = ids
        return out

    def _all(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, column: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        raw = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] is not None else memoryview(b"")
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [bytes(raw[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, NULL as empty, as little-endian unsigned integers of ``kind``."""
        column = pc.fill_null(column, "")
        if not self.by_words:
            return self._all(column.to_pylist())
        whole = pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, r"[^\x{00}-\x{ff}]"))
        mixed = pc.match_substring_regex(column, f"[^ \nA-ZÀ-ÖØ-Þ0-9{self.LOWER}{self.MARKS}]")
        way = np.where(whole.to_numpy(zero_copy_only=False), 2, np.where(mixed.to_numpy(zero_copy_only=False), 1, 0))
        out: list[bytes] = [b""] * len(column)
        for kind in range(3):
            rows = np.flatnonzero(way == kind)
            if not len(rows):
                continue
            some = column.take(pa.array(rows))
            if kind == 2:
                found = self._all(some.to_pylist())
            else:
                some = pc.utf8_lower(some)
                if kind == 0:  # only letters, digits and marks: marks stand apart, so fewer words differ
                    some = pc.replace_substring_regex(some, f"[{self.MARKS}]+", r" \0 ")
                found = self._by_words(some)
            for row, ids in zip(rows.tolist(), found, strict=True):
                out[row] = ids
        return out


def _byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_ids(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """(doc_id, ids) of every row: ids as bytes of u16 or, for large vocabularies, u32, with ``end``
    appended; NULL texts are empty."""

    file = _file(path)  # a vocabulary, so of bounded size; executors need not have it
    shared, key = docs.sparkSession.sparkContext.broadcast(file), f"{zlib.crc32(file.encode())}-{len(file)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept_in_worker("tokenizer", key, lambda: WordMemo(shared.value))
        tail = np.array([end], memo.kind).tobytes()
        for batch in batches:
            for part in slices(batch, "text", 12 << 20):
                ids = pa.array([i + tail for i in memo.encode(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


# ---- frequencies -------------------------------------------------------------------------------


def id_kind(path: str) -> str:
    """How ``token_ids`` writes an id: as u16 or u32, by the size of the vocabulary."""
    return "<u2" if Tokenizer.from_str(_file(path)).get_vocab_size() <= 1 << 16 else "<u4"


def symbol_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(symbol, count) over all ids; each task counts its rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                seen = np.bincount(np.frombuffer(ids.as_py(), kind))
                if len(seen) > len(total):
                    total = np.r_[total, np.zeros(len(seen) - len(total), np.int64)]
                total[: len(seen)] += seen
        symbols = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(symbols.astype(np.int64)), pa.array(total[symbols])], ["symbol", "count"])

    return tokens.select("ids").mapInArrow(run, "symbol bigint, count bigint").groupBy("symbol").agg(F.sum("count").alias("count"))


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least one that add up to 2^scale, near ``counts`` in proportion."""
    total = 1 << scale
    if not 0 < len(counts) <= total:
        raise ValueError(f"{len(counts)} symbols do not fit a table of 2^{scale}")
    spare = total - len(counts)  # one is each symbol's due
    share = counts.astype(np.float64) * (spare / counts.sum())
    freq = 1 + np.floor(share).astype(np.int64)
    rest = total - int(freq.sum())
    by_rest = np.lexsort((np.arange(len(counts)), np.floor(share) - share))
    freq[by_rest[:rest]] += 1
    return freq


class Coder:
    """Coding and decoding with one frequency table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, scale: int = SCALE):
        self.symbols, self.scale = symbols.astype(np.uint32), scale
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.index = np.full(int(symbols.max()) + 1, -1, np.int64)
        self.index[symbols] = np.arange(len(symbols))
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.int64), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        """One payload; lanes are coded from their last token to their first."""
        n, scale = len(ids), np.uint64(self.scale)
        rows = -(-n // LANES)
        at = np.full(rows * LANES, -1, np.int64)
        at[:n] = self.index[ids]
        at = at.reshape(rows, LANES)
        state = np.full(LANES, LOW, np.uint64)
        freq, start = self.freq, self.start
        limit = np.uint64(LOW >> self.scale << 32)
        words: list[np.ndarray] = []  # back to front
        marks = []
        written = 0
        for row in range(rows - 1, -1, -1):
            k = at[row]
            real = slice(None) if row + 1 < rows or k[-1] >= 0 else k >= 0
            x, k = state[real], k[real]
            f = freq[k]
            full = x >= limit * f
            if full.any():
                out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
                words.append(out[::-1])
                written += len(out)
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[real] = (q << scale) + (x - q * f) + start[k]
            if row * LANES % CHECKPOINT == 0:
                marks.append((row * LANES, written, state.copy()))
        if not rows:
            marks.append((0, 0, state.copy()))
        stream = np.concatenate(words)[::-1].astype("<u4").tobytes() if words else b""
        body = b"".join(struct.pack("<II", token, written - done) + s.astype("<u8").tobytes() for token, done, s in marks[::-1]) + stream
        return struct.pack(_HEAD, b"RNS1", n, written, len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``first`` up to checkpoint ``last`` (the end if None)."""
        magic, n, words, marks, crc, body_crc = struct.unpack_from(_HEAD, payload)
        body = memoryview(payload)[_HEAD_BYTES:]
        if magic != b"RNS1" or zlib.crc32(body) != body_crc:
            raise ValueError("damaged block")
        wide = 8 + 8 * LANES
        token, word = struct.unpack_from("<II", body, first * wide)
        stop = n if last is None or last >= marks else struct.unpack_from("<I", body, last * wide)[0]
        state = np.frombuffer(body, "<u8", LANES, first * wide + 8).astype(np.uint64)
        stream = np.frombuffer(body, "<u4", words, marks * wide).astype(np.uint64)
        rows = -(-(stop - token) // LANES)
        out = np.empty((rows, LANES), np.int64)
        mask, scale, slot, freq, start = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), self.slot, self.freq, self.start
        for row in range(rows):
            live = min(LANES, stop - token - row * LANES)
            x = state[:live]
            low = x & mask
            k = slot[low]
            out[row, :live] = k
            x = freq[k] * (x >> scale) + low - start[k]
            need = x < np.uint64(LOW)
            if need.any():
                count = int(need.sum())
                x[need] = (x[need] << np.uint64(32)) | stream[word : word + count]
                word += count
            state[:live] = x
        ids = self.symbols[out.reshape(-1)[: stop - token]]
        if first == 0 and stop == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids differ from those written")
        return ids


# ---- files -------------------------------------------------------------------------------------

_BLOCKS = "shard int, block int, doc_ids array<bigint>, n_tokens array<bigint>, payload binary"


def write(tokens: DataFrame, folder: str, kind: str) -> None:
    """Write (doc_id, ids) rows as a store, in ascending order of doc_id, NULL first, then of ids.

    Shards are ranges of doc_id; a document is never cut, so a block ends with the document that
    fills it.  The frequency table is collected: it has at most 2^SCALE rows.
    """
    spark = tokens.sparkSession
    table = symbol_counts(tokens, kind).orderBy("symbol").limit((1 << SCALE) + 1).collect()
    symbols = np.array([r[0] for r in table], np.int64)
    freq = frequencies(np.array([r[1] for r in table], np.int64)) if table else symbols
    row = spark.range(1).select(F.lit(symbols.tolist()).cast("array<bigint>").alias("symbols"), F.lit(freq.tolist()).cast("array<bigint>").alias("freq"))
    row.coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast((symbols, freq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, held, size = None, 0, [], 0

        def block() -> pa.RecordBatch:
            ids = [np.frombuffer(i, kind) for _, i in held]
            row = ([shard], [number], [[d for d, _ in held]], [[len(i) for i in ids]], [coder.encode(np.concatenate(ids))])
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = ["shard", "block", "doc_ids", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        width = np.dtype(kind).itemsize
        for batch in batches:
            for shard, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                coder = coder or Coder(*shared.value)
                held.append((doc, ids))
                size += len(ids) // width
                if size >= BLOCK:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    ranged = tokens.select("doc_id", "ids").repartitionByRange(F.col("doc_id"), F.xxhash64("ids"))
    ordered = ranged.sortWithinPartitions("doc_id", "ids").select(F.spark_partition_id().alias("shard"), F.col("doc_id").cast("bigint"), "ids")
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, crc32, ids) of every document of a store, in any order of rows.

    Blocks are decoded independently.  ``start`` is the number of ids of all documents before; it
    comes from the stored numbers of tokens: a sum per shard, a running sum over the shards (as
    many as tasks wrote them) and one over the blocks of each shard.  ``ids`` are bytes of u32;
    without them the rows stay narrow.
    """
    row = spark.read.parquet(f"{folder}/table").first()
    shared = spark.sparkContext.broadcast((np.array(row["symbols"], np.int64), np.array(row["freq"], np.int64)))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("size").alias("size"))
    shards = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("size").over(before.orderBy("shard")), F.lit(0)).alias("past"))
    inner = F.coalesce(F.sum("size").over(before.partitionBy("shard").orderBy("block")), F.lit(0))
    placed = sizes.withColumn("inner", inner).join(shards, F.col("shard") == F.col("of"))
    places = placed.select(F.col("shard").alias("at_shard"), F.col("block").alias("at_block"), (F.col("past") + F.col("inner")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for shard, block, docs, counts, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                coder = coder or Coder(*shared.value)
                raw = memoryview(coder.decode(payload).astype("<u4").tobytes())
                ends = np.cumsum(counts)
                each = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts, ends.tolist(), strict=True)]
                n = len(docs)
                arrays = [
                    pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(docs, pa.int64()),
                    pa.array(ends - np.array(counts)), pa.array(counts, pa.int64()), pa.array([zlib.crc32(i) for i in each], pa.int64()),
                    pa.array([bytes(i) for i in each] if ids else [None] * n, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "block", "doc_id", "offset", "n_tokens", "crc32", "ids"])

    rows = blocks.select("shard", "block", "doc_ids", "n_tokens", "payload").mapInArrow(
        run, "shard int, block int, doc_id bigint, offset bigint, n_tokens bigint, crc32 bigint, ids binary"
    )
    rows = rows if ids else rows.drop("ids")
    joined = rows.join(places, (F.col("shard") == F.col("at_shard")) & (F.col("block") == F.col("at_block")))
    start = (F.col("before") + F.col("offset")).alias("start")
    return joined.select("doc_id", start, "n_tokens", "crc32", *(["ids"] if ids else []))


def store(docs: DataFrame, path: str, end: int = 2, folder: str | None = None) -> str:
    """Encode documents and write the store; returns its folder.

    The ids are written once before: the counts and the coder both read them, and the tokenizer
    is the costly part.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    ids = token_ids(docs, path, end)
    held = f"{folder}/ids"
    ids.write.option("compression", "zstd").parquet(held)
    write(spark.read.schema(ids.schema).parquet(held), folder, id_kind(path))
    return folder
