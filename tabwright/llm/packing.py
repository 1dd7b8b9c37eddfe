"""Tokenized pieces of documents and their packing into sequences by sums of squares."""

from __future__ import annotations

import sys
import types
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import Scratch, text_of

CAPACITY = 2048
END = 0                  # id after each document
BLOCK_PIECES = 100_000   # pieces that are packed together
CACHED_STEMS = 1_000_000   # stems that a worker process remembers: some hundreds of MB
ROWS = 4_000             # texts that are split and looked up at a time
MARK = "\x01"
ENDINGS = ".,;:!?$%&#*"   # marks that are cut off the end of a word
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "serial"]
PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long, serial long"
PLACED = "doc_id {id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, word by word.

    The tokenizer never joins anything across ASCII white space, so the ids of a text
    are those of its words one after the other. It drops case and begins a new piece
    where a letter or digit meets punctuation; so a word is looked up in lower case and
    apart from the marks that end it. Each distinct word of a batch is looked up once, and
    stems not seen before are encoded many at a time with the
    control character U+0001 between them, whose id no other text gives.
    """

    def __init__(self, tokenizer: Tokenizer, cached: int = CACHED_STEMS):
        self.tokenizer, self.stems, self.cached = tokenizer, {}, cached
        (self.mark,) = tokenizer.encode(MARK, add_special_tokens=False).ids

    def alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_stems(self, stems: list[str]) -> None:
        for at in range(0, len(stems), 20_000):
            some = stems[at:at + 20_000]
            joined = f" {MARK} ".join(some)
            found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            marks = (4 * np.flatnonzero(found == self.mark)).tolist()
            ids = found.tobytes()
            self.stems.update(zip(some, map(ids.__getitem__, map(slice, [0, *(m + 4 for m in marks)], [*marks, len(ids)]))))

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        parts, alone = [], {}
        for word in words:
            if MARK in word or "<|" in word:   # special tokens are found before anything else
                alone[word] = self.alone(word)
                parts.append((word, ""))
                continue
            lower = word.lower() if word.isascii() else word
            stem = lower.rstrip(ENDINGS)
            last = stem[-1:]
            parts.append((stem, lower[len(stem):]) if last.isascii() and last.isalnum() else (lower, ""))
        stems = {stem for stem, _ in parts}.difference(self.stems, alone)
        if len(self.stems) + len(stems) > self.cached:
            self.stems, stems = {}, {stem for stem, _ in parts}.difference(alone)
        self.encode_stems(list(stems))
        for ending in {ending for _, ending in parts}.difference(self.stems):
            self.stems[ending] = self.alone(ending)
        known = self.stems | alone if alone else self.stems
        return [known[stem] + known[ending] if ending else known[stem] for stem, ending in parts]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = self.words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(found), "<u4")
        word = coded.indices.to_numpy()
        sizes = size[word]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(first[word] - upto[:-1], sizes) + np.arange(upto[-1])
        data, ends = ids[at].tobytes(), 4 * upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _encoder(model: str) -> Encoder:
    """The worker process's encoder, which its later tasks find with the stems it has seen."""
    kept = sys.modules.setdefault("_tabwright_worker", types.ModuleType("_tabwright_worker")).__dict__
    if kept.get("model") != model:
        kept.update(model=model, encoder=Encoder(Tokenizer.from_str(model)))
    return kept["encoder"]


def tokenized(docs: DataFrame, tokenizer_path: str, doc_id="doc_id", text="text", capacity: int = CAPACITY,
              end: int = END, rows: int = ROWS, cached: int = CACHED_STEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, serial.

    A document is the ids of its whole text and the id ``end``; it is cut into pieces of
    ``capacity`` ids only if it has more. ``serial`` counts the pieces of a task: with
    it, copies of one row can be told apart. ``rows`` texts are looked up at a time, and
    a worker remembers ``cached`` stems: fewer of both take less memory and more time.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())   # a few MB, of fixed size
    last = np.array([end], "<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        encode, serial = _encoder(model.value), 0
        encode.cached = cached
        for batch in batches:
            for low in range(0, len(batch), rows):
                some = batch.slice(low, rows)
                found, row = [], []
                for i, ids in enumerate(encode(some.column("text"))):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        row.append(i)
                        found.append((k, at // 4, len(part) // 4, zlib.crc32(part), serial))
                        serial += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*found), [pa.int32()] + [pa.int64()] * 4)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(row)), *columns], names=NAMES)
            pa.default_memory_pool().release_unused()     # the worker process lives on beside later stages

    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return texts.mapInArrow(run, PIECE.format(id=kind))


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, by the sum-of-squares rule.

    ``open_bins[g]`` is the number of open bins with a gap of g. An item goes where the
    sum of the squares of these counts becomes smallest: into some open gap, or into a
    new bin; of equal choices the smallest gap. Filled bins don't count.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        if size >= capacity:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        gaps = open_bins[size:capacity]
        change = np.where(gaps > 0, 2 * (open_bins[:capacity - size] - gaps) + 2, never)
        if gaps[0]:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin())
        if change[best] <= 2 * open_bins[capacity - size] + 1:
            gap = size + best
            at = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, at, made = capacity, made, made + 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            stacks[gap - size].append(at)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset (from 0 without gaps in each sequence).

    Pieces are dealt at random, by a hash, into blocks of about ``block_pieces`` that
    are packed independently; a block's loss is a few sequences, whatever its size.
    In a block the pieces above an eighth of the capacity come first, largest first,
    and the rest in hash order: the rule keeps the gaps of all sizes in stock that the
    small ones then fill. Only the numbers of a piece are shuffled, not its ids.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    blocks = max(1, -(-pieces.count() // block_pieces))
    key = F.xxhash64("serial", "piece", "ids_crc32", "doc_id")
    rows = pieces.withColumn("key", key).withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["length"].to_numpy()
        first = np.where(size > capacity // 8, -size, 0)
        order = np.lexsort((pdf["serial"].to_numpy(), pdf["key"].to_numpy(), first))
        bins, offsets = place(size[order], capacity)
        out = pdf.iloc[order].assign(sequence_id=bins + (int(pdf["block"].iloc[0]) << 32), offset=offsets)
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return rows.groupBy("block").applyInPandas(run, PLACED.format(id=kind))


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id="doc_id", text="text", capacity: int = CAPACITY,
                   rows: int = ROWS, cached: int = CACHED_STEMS) -> DataFrame:
    """Tokenize and pack all rows.

    A null or empty text is the id ``END`` alone. Every row is a document, repeated ones
    as often as they are there; a null id stays null. An empty table gives an empty
    result. Other columns of the input are not read.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = tokenized(docs, tokenizer_path, doc_id, text, capacity, rows=rows, cached=cached)
    return pack(scratch.keep(pieces, "pieces"), capacity)
