"""Closed syncmers: context-free anchors of texts, fingerprints of them and positional matching."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import cut_points, with_buckets
from .common import text_of

K, S = 16, 5            # characters of an anchor and of the inner substrings compared
SKETCH = 64             # anchors of the short form of a fingerprint; likeness and the written form have all
BASE = np.uint64(0x9E3779B97F4A7C15)
OUT_BYTES = 8_000_000   # fingerprints that a task hands over at once
PART_ROWS = 20_000      # rows of a range that one task goes through in order


def _rolling(codes: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of every substring of ``length``, by doubling."""
    def _power(n: int) -> np.uint64:
        return np.uint64(pow(int(base), n, 1 << 64))

    if len(codes) < length:
        return codes[:0]
    whole, have, doubled, size = None, 0, codes, 1
    while True:
        if length & size:
            whole = doubled if whole is None else whole[:len(doubled) - have] * _power(size) + doubled[have:]
            have += size
            if have == length:
                return whole
            whole = whole[:max(0, len(codes) - have + 1)]
        doubled = doubled[:len(doubled) - size] * _power(size) + doubled[size:]
        size *= 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (width - size)], h[width - size:]) if width > size else h


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of an array of character or byte codes.

    A k-mer is one if the smallest hash of its s-mers is that of its first or last
    s-mer. That depends on the k-mer alone, so equal substrings have equal anchors at
    equal distances, wherever they stand; and of k - s + 1 k-mers in a row at least
    one is an anchor.
    """
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = codes.astype(np.uint64) + np.uint64(1)
    inner = _mixed(_rolling(codes, s))
    width = k - s + 1
    least = _sliding_min(inner, width)
    at = np.flatnonzero((least == inner[:len(least)]) | (least == inner[width - 1:]))
    return at, _mixed(_rolling(codes, k)[at])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Fingerprint:
    """All distinct anchors of a text by hash, each at its first position."""

    def __init__(self, text: str, positions: np.ndarray, hashes: np.ndarray):
        if not len(positions) and text:   # too short for an anchor: the text as a whole is one
            positions, hashes = np.zeros(1, np.int64), np.frombuffer(hashlib.md5(text.encode()).digest()[:8], np.uint64)
        self.hashes, first = np.unique(hashes, return_index=True)
        self.positions = positions[first]

    def whole(self) -> str:
        """All anchors in the order of their hashes: per anchor 16 hexadecimal digits of the hash and 8 of the position."""
        both = np.empty(len(self.hashes), np.dtype([("hash", ">u8"), ("position", ">u4")]))
        both["hash"], both["position"] = self.hashes, self.positions
        return both.tobytes().hex()

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        """The fingerprint of which ``text`` is the whole form."""
        both = np.frombuffer(bytes.fromhex(text), np.dtype([("hash", ">u8"), ("position", ">u4")]))
        return cls("", both["position"].astype(np.int64), both["hash"].astype(np.uint64))

    def __str__(self) -> str:
        """A short form to look at: the SKETCH smallest as ``hash@position`` in hexadecimal, in the order of the hashes; empty for an empty text."""
        return " ".join(f"{h:016x}@{p:x}" for h, p in zip(self.hashes[:SKETCH].tolist(), self.positions[:SKETCH].tolist()))

    def likeness(self, other: Fingerprint) -> float:
        """Share of the anchors of both that stand in both in the same order.

        Anchors in common are chained by position; the longest chain that rises in
        both texts counts, so chance matches elsewhere do not. Two empty texts have
        likeness 1.
        """
        _, mine, theirs = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        union = len(self.hashes) + len(other.hashes) - len(mine)
        if not union:
            return 1.0
        there = other.positions[theirs][np.argsort(self.positions[mine])]
        if (there[1:] > there[:-1]).all():
            return len(there) / union
        ends: list[int] = []
        for p in there.tolist():
            i = bisect_left(ends, p)
            ends[i:i + 1] = [p]
        return len(ends) / union


class Document:
    """A text with its anchors, hashed once."""

    def __init__(self, doc_id, text: str):
        self.id, self.text = doc_id, text
        self.positions, self.hashes = anchors(codes_of(text))
        self.print = Fingerprint(text, self.positions, self.hashes)

    def edited(self, following: Document) -> tuple[str, Fingerprint]:
        """The text whose last third is replaced by the start of the next one, and its fingerprint.

        Its anchors are those of both texts that lie wholly in what is taken of them,
        and those across the seam; nothing else has to be hashed again.
        """
        tail = len(self.text) // 3
        cut = len(self.text) - tail
        text = self.text[:cut] + following.text[:tail]
        taken = len(text) - cut
        seam = max(0, cut - K + 1)
        across, seam_hashes = anchors(codes_of(text[seam:cut + K - 1]))
        head, rest = self.positions <= cut - K, following.positions <= taken - K
        positions = np.concatenate([self.positions[head], across + seam, following.positions[rest] + cut])
        hashes = np.concatenate([self.hashes[head], seam_hashes, following.hashes[rest]])
        order = np.argsort(positions, kind="stable")
        return text, Fingerprint(text, positions[order], hashes[order])


def anchor_table(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """All anchors of all rows: doc_id, position (code points from 0), hash (signed 64 bits)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row, t in zip(batch["doc_id"], batch["text"]):
                at, hashes = anchors(codes_of(t))
                yield pd.DataFrame({"doc_id": pd.Series([row] * len(at), dtype=batch["doc_id"].dtype), "position": at,
                                    "hash": hashes.view(np.int64)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, position long, hash long")


def _in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows in parts, each a range of the descending order of ids and ended by the first row of the next part.

    Within an id rows are ordered by a hash of the text; rows without an id come last.
    The first rows of all parts, one per part, go through the driver as keys only.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumns({"_order": F.bitwise_not("doc_id"), "_tie": F.xxhash64("text")})
    n = max(24, math.ceil(docs.count() / PART_ROWS))
    rows = with_buckets(rows, cut_points(rows.select("_order"), ["_order"], n, most=n))
    none = F.lit(n + 2) + F.shiftrightunsigned("_tie", 56).cast("int")   # rows without an id: 256 parts by hash
    rows = rows.withColumn("_part", F.when(F.col("_order").isNull(), none).otherwise(F.col("_b__order"))).drop("_b__order")
    # unsigned order of the hash, as the parts of rows without an id are cut by its leading bits
    rows = rows.withColumn("_tie", F.col("_tie").bitwiseXOR(F.lit(-2**63)))
    firsts = rows.groupBy("_part").agg(F.min(F.struct(F.coalesce("_order", F.lit(0)).alias("o"), F.col("_tie").alias("t"))).alias("f"))
    firsts = sorted((r["_part"], r["f"]["o"], r["f"]["t"]) for r in firsts.collect())
    ends = [(part, *firsts[(i + 1) % len(firsts)]) for i, (part, _, _) in enumerate(firsts)]
    ends = docs.sparkSession.createDataFrame(ends, "_to int, _from int, _o long, _t long")
    copies = rows.join(F.broadcast(ends), (F.col("_part") == F.col("_from")) & (F.col("_tie") == F.col("_t"))
                       & (F.coalesce("_order", F.lit(0)) == F.col("_o")))
    copies = copies.select("doc_id", "text", "_order", "_tie", F.col("_to").alias("_part"), F.lit(True).alias("_last"))
    both = rows.select("doc_id", "text", "_order", "_tie", "_part", F.lit(False).alias("_last")).unionByName(copies)
    return both.repartition(n, "_part").sortWithinPartitions("_part", "_last", F.col("_order").asc_nulls_last(), "_tie")


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_likeness(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness, one row per row.

    The next document is the one with the next smaller id (after the last, the first);
    rows with one id follow each other by a hash of the text, rows without an id come
    last, and the only row of a table follows itself. A null text is empty; an empty
    text has an empty fingerprint. Fingerprints are written whole, so both likenesses
    follow from the written ones (:meth:`Fingerprint.read`). An empty table gives an empty result. Other columns
    are not read. Texts are shuffled once, into ranges of the order; a task goes
    through them in order and holds two documents at a time.
    """
    names = [c.split()[0] for c in EDITED.split(", ")]

    def frame(out):
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    def run(batches):
        held, part = None, None
        for batch in batches:
            out, size = [], 0
            for row, t, at, last in zip(batch["doc_id"], batch["text"], batch["_part"], batch["_last"]):
                if at == part and held is None:
                    continue   # a further copy of the row that ended the part
                document = Document(None if pd.isna(row) else int(row), t)
                if at == part:
                    edited, mark = held.edited(document)
                    out.append((held.id, len(held.text), hashlib.sha256(edited.encode()).hexdigest(), held.print.whole(),
                                mark.whole(), held.print.likeness(mark), held.print.likeness(document.print)))
                    size += len(out[-1][3]) + len(out[-1][4])
                    if size > OUT_BYTES:
                        yield frame(out)
                        out, size = [], 0
                held, part = None if last else document, at
            yield frame(out)

    rows = _in_order(docs, doc_id, text).select("doc_id", "text", "_part", "_last")
    return rows.mapInPandas(run, EDITED)
