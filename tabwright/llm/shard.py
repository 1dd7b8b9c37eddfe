"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, numbered, text_of

PRIME = 2**31 - 1
ROUNDS = 6
WALK = 64


def round_keys(seed, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers below the prime for each round, from an md5 of seed and round."""
    def number(i, part):
        return int(hashlib.md5(f"{seed}|{i}|{part}".encode()).hexdigest()[:15], 16) % (PRIME - 1) + 1
    return [(number(i, "add"), number(i, "times")) for i in range(rounds)]


def permuted_once(x: Column, side: int, keys) -> Column:
    """One pass of the Feistel network over [0, side * side); no number overflows a long for side below 2^31."""
    right = x % side
    left = F.call_function("div", x, F.lit(side))
    for add, times in keys:
        mixed = (right + add) % PRIME
        left, right = right, (left + mixed * mixed % PRIME * times % PRIME) % side
    return left * side + right


def permuted(x: Column, n: int, seed) -> Column:
    """A permutation of [0, n) for row numbers ``x``.

    The network permutes the smallest square not below n; a value outside [0, n) is
    sent through again until it is inside (cycle walking). At most 2 * sqrt(n)
    values are outside, so up to n = 1024 the walk always ends within WALK steps,
    and above it fails to with a chance below (2 / sqrt(n)) ** WALK < 1e-76; it then
    raises, and another seed has to be taken.
    """
    side = max(1, math.isqrt(max(n, 1) - 1) + 1)
    keys = round_keys(seed)
    outside = side * side - n
    first = permuted_once(x, side, keys)
    if not outside:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(outside, WALK))), first,
                       lambda at, _: F.when(at < n, at).otherwise(permuted_once(at, side, keys)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk did not end; take another seed")).cast("long"))


def shard(docs: DataFrame, shards: int, doc_id="doc_id", text="text", seed="shard") -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard, slot per row.

    Rows are numbered in the order of the id (nulls last, ties by text digest); the
    number's place in the seeded permutation gives shard = place % shards and
    slot = place // shards, so counts differ by at most one and both can be computed
    for any row number without the data. Repeated rows are rows of their own: which
    of two identical rows has which place is open, their places are not. A null text
    has size 8 and the CRC of the empty text. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.keep(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(text_of(text)) + 8).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"), F.md5(text_of(text)).alias("digest")), "narrow")
    rows = numbered(narrow, "doc_id", ["digest"], "row_number")
    place = permuted(F.col("row_number"), narrow.count(), seed)
    return rows.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", "row_number", "place", (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"))
