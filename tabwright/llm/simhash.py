"""SimHash fingerprints and near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ordered import sized
from .common import Scratch, fresh, text_of
from .components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
BLOCK = 1 << 15   # shingles of one text that are counted at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text, 0 without words."""
    words = (text or "").encode().lower().split()   # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        value = xxhash.xxh64_intdigest(joined, SEED)
        return value - (value >> 63 << 64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: n - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, n - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        some = range(at, min(total, at + BLOCK))
        hashes = np.fromiter((digest(joined[starts[i]:stops[i]], SEED) for i in some), np.uint64, len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, columns, text="text", out="fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The named columns of every row plus its fingerprint."""
    schema = StructType([docs.schema[c] for c in columns] + [StructField(out, LongType())])
    names = list(columns)

    def run(batches):
        for batch in batches:
            found = batch[names].copy()
            found[out] = np.fromiter((fingerprint(t, shingle) for t in batch["__text"]), np.int64, len(batch))
            yield found

    return docs.select(*names, text_of(text).alias("__text")).mapInPandas(run, schema)


def ball(radius: int) -> list[int]:
    """All 64-bit masks with at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (m >> 63 << 64) for m in masks]


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within ``distance`` bits.

    Every fingerprint emits all variants within half the distance, rounded up; two
    fingerprints within the distance have a variant in common. A variant belongs to
    at most as many distinct fingerprints as the ball has masks (65 for distance 2),
    so no group grows with the data. For an even distance all fingerprints of a
    variant are within the distance of each other, and linking neighbours in order
    loses no connection; for an odd one every pair of the group is verified.
    """
    half = (distance + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball(half)])
    variants = prints.select(F.col("fingerprint").alias("b"), F.explode(
        F.transform(masks, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("variant"))
    if distance % 2 == 0:
        previous = F.lag("b").over(W.partitionBy("variant").orderBy("b"))
        pairs = variants.select(previous.alias("a"), "b").where(F.col("a").isNotNull())
    else:
        groups = variants.groupBy("variant").agg(F.array_sort(F.collect_list("b")).alias("g")).where("size(g) > 1")
        pairs = (groups.select("g", F.explode("g").alias("a")).select("a", F.explode("g").alias("b")).where("a < b"))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fingerprint, component) for distinct fingerprints; component is the smallest fingerprint linked."""
    linked = components(links(prints, distance))
    return prints.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"))


def simhash(docs: DataFrame, doc_id="doc_id", text="text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and empty texts and texts of white space have fingerprint zero, which links
    like any other; a text of fewer words than a shingle is one shingle. The
    component id is the smallest id among all rows linked, null if none has an id.
    Repeated rows come back as often as they are there. An empty table gives an empty
    result. Other columns of the input are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                                          ["doc_id"], shingle=shingle), "fingerprints")
    prints = scratch.keep(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    found = scratch.keep(classes(prints.select("fingerprint"), distance), "classes")
    least = found.join(prints, "fingerprint").groupBy("component").agg(F.min("least").alias("component_id"))
    named = found.join(least, "component").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id="doc_id", text="text", shingle: int = SHINGLE, distance: int = DISTANCE,
                most: int = 100_000) -> DataFrame:
    """The rows of ``docs`` of which one document per group stays, the one with the smallest id.

    Rows with one id and one text are one document. A group without ids keeps the
    document with the smallest text digest. All columns of the input come back. What
    goes is found in a table of keys; texts meet it in a broadcast up to ``most`` keys
    and are shuffled once beyond that.
    """
    scratch = Scratch(docs.sparkSession)
    key, digest = fresh(docs, "_row"), F.md5(text_of(text))
    ident = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), digest.alias("digest"))
    rows = scratch.keep(with_fingerprints(docs.select(ident.alias("row"), F.col(text).alias("text")), ["row"],
                                          shingle=shingle), "fingerprints")
    prints = scratch.keep(rows.groupBy("fingerprint").agg(F.min("row").alias("row")), "distinct")
    found = classes(prints.select("fingerprint"), distance).join(prints, "fingerprint")
    stay = found.groupBy("component").agg(F.min("row").alias(key)).select(key, F.lit(True).alias("stays"))
    keys = rows.groupBy(F.col("row").alias(key)).agg(F.count(F.lit(1)).alias("n")).join(stay, key, "left")
    keys = scratch.keep(keys.where("stays is null or n > 1"), "keys")
    kept = docs.withColumn(key, ident).join(sized(keys.where("stays is null").select(key), most), key, "left_anti")
    repeated = keys.where("stays").select(key)
    if not repeated.isEmpty():
        repeated = sized(repeated, most)
        once, again = kept.join(repeated, key, "left_anti"), kept.join(repeated, key, "left_semi").dropDuplicates([key])
        kept = once.unionByName(again)
    return kept.drop(key)
