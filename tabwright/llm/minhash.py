"""MinHash near-duplicates: fast similarity sketches, banding, exact verification on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..operators.ordered import OFFSET_ROWS, null_safe_join, sized
from .common import Scratch, text_of
from .components import components
from .sketches import band_keys, batches_by_words, set_digests, shingle_sets, sketch

SHINGLE = 5
SIMILARITY = 80      # percent
COORDINATES = 128    # of the sketch that is cut into bands
LONG = 2_048         # of the sketch that decides which pairs of a bucket are verified, 4 bits each
MISS = 1e-7          # chance that a pair at the threshold shares no band, and that it agrees in too few coordinates
BLOCK = 4_096        # members of a bucket that one task compares with as many others


def least_agreement(size: int = LONG, similarity: float = SIMILARITY / 100, bits: int = 4, miss: float = MISS) -> int:
    """Coordinates that sketches of a pair at the threshold have in common, but for a chance of ``miss``.

    Of a coordinate only some bits are compared, so unlike ones agree once in 2 ** bits.
    """
    p, total = similarity + (1 - similarity) / 2 ** bits, 0.0
    if p >= 1:
        return size
    for k in range(size + 1):
        total += math.exp(math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1)
                          + k * math.log(p) + (size - k) * math.log(1 - p))
        if total > miss:
            return k
    return size


def band_rows(size: int = COORDINATES, similarity: float = SIMILARITY / 100, miss: float = MISS) -> int:
    """Most coordinates a band can have so that a pair at the threshold shares one: 4 at a similarity of 0.8."""
    return max([r for r in range(1, size + 1) if (1 - similarity ** r) ** (size // r) <= miss], default=1)


#: Of every byte the number of its halves that are zero: coordinates that agree, if the byte is a difference.
HALVES = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


def _low_bytes(sketches: np.ndarray, bits: int = 8) -> pa.Array:
    """The lowest 8 or 4 bits of every coordinate, one binary value per sketch."""
    low = (sketches & np.uint64((1 << bits) - 1)).astype(np.uint8)
    low = np.ascontiguousarray(low if bits == 8 else low[:, ::2] | (low[:, 1::2] << 4))
    ends = np.arange(len(low) + 1, dtype=np.int32) * low.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(ends), pa.py_buffer(low)])


def with_sketches(docs: DataFrame, keys, text: str, shingle: int = SHINGLE, rows: int = 4, size: int = COORDINATES) -> DataFrame:
    """The key columns plus n (set size), a and b (128 bits of the set), bands (keys) and bytes (8 bits a coordinate)."""
    keys = list(keys)
    schema = StructType([docs.schema[k] for k in keys] + [StructField(c, LongType()) for c in "nab"] + [
        StructField("bands", ArrayType(LongType())), StructField("bytes", BinaryType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for at, to in batches_by_words(pc.binary_length(texts).to_pylist()):
                values, starts = shingle_sets(texts.slice(at, to - at).to_pylist(), shingle)
                sketches = sketch(values, starts, size)
                digests, bands = set_digests(values, starts), band_keys(sketches, rows)
                offsets = np.arange(to - at + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).slice(at, to - at) for k in keys], pa.array(np.diff(starts)),
                    pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.ListArray.from_arrays(pa.array(offsets * bands.shape[1]), pa.array(bands.ravel())),
                    _low_bytes(sketches)], names=schema.names)

    return docs.select(*keys, text_of(text).alias("text")).mapInArrow(run, schema)


def with_sets(rows: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``members``, the full shingle set as an array of longs, and ``long``, 4 bits a coordinate of a longer sketch."""
    schema = StructType([rows.schema[key], StructField("members", ArrayType(LongType())), StructField("long", BinaryType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for at, to in batches_by_words(pc.binary_length(texts).to_pylist()):
                values, starts = shingle_sets(texts.slice(at, to - at).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([
                    batch.column(key).slice(at, to - at),
                    pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64))),
                    _low_bytes(sketch(values, starts, LONG), 4)], names=schema.names)

    return rows.select(key, text_of(text).alias("text")).mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (x, y) whose full sets have ``100 * intersection >= similarity * union``."""
    left = sets.select(F.col("id").alias("x"), F.col("members").alias("_sx"))
    right = sets.select(F.col("id").alias("y"), F.col("members").alias("_sy"))
    both = pairs.join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("_sx", "_sy")).cast("long")
    both = both.select("x", "y", common.alias("i"), (F.size("_sx") + F.size("_sy")).cast("long").alias("s"))
    return both.where(100 * F.col("i") >= similarity * (F.col("s") - F.col("i"))).select("x", "y")


def open_pairs(members: DataFrame, prints: DataFrame, agreement: int, rows: int, similarity: int = SIMILARITY,
               block: int = BLOCK) -> DataFrame:
    """Pairs (x, y) of unlike components in a bucket whose long sketches agree in ``agreement`` coordinates.

    ``members`` has key (bucket), band, id and component, ``prints`` id, n, bytes and
    long. Every member outside a bucket's largest component meets every member of the
    bucket; members inside it need not meet each other. Both sides are dealt into
    blocks, a task compares one block with one other, and only pairs that pass leave it,
    each from the first band that it shares; so a bucket of any size is linear in rows
    shuffled. Sketches are joined only to members of buckets with several components.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_m"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("_m", "component")).alias("main"),
                                    F.sum("_m").alias("m"), (F.sum("_m") - F.max("_m")).alias("o"), F.count(F.lit(1)).alias("_c"))
    main = main.where("_c > 1").drop("_c")
    found = members.join(main, "key").withColumn("outer", F.col("component") != F.col("main"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    deal = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    copies = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    columns = ["key", "band", "id", "component", "outer"]
    # a side's own block, and a copy for every block of the other side
    inside = found.select(*columns, deal("m").alias("j"), copies("o").alias("i"), F.lit(False).alias("left"))
    outside = found.where("outer").select(*columns, deal("o").alias("i"), copies("m").alias("j"), F.lit(True).alias("left"))
    dealt = outside.unionByName(inside).join(prints.select("id", "n", "bytes", "long"), "id")

    def sketches_of(side: pa.Table, column: str) -> np.ndarray:
        return np.frombuffer(b"".join(side.column(column).to_pylist()), np.uint8).reshape(side.num_rows, -1)

    def compare(both: pa.Table) -> pa.Table:
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, right = (both.filter(pc.equal(both.column("left"), side)) for side in (True, False))
        if left.num_rows and right.num_rows:
            band = left.column("band")[0].as_py()
            short = [sketches_of(t, "bytes")[:, :(band + 1) * rows].reshape(t.num_rows, band + 1, rows) for t in (left, right)]
            long = [sketches_of(t, "long") for t in (left, right)]
            ids, parts, sizes, outer = ([t.column(c).to_numpy() for t in (left, right)] for c in ("id", "component", "n", "outer"))
            for r in range(left.num_rows):
                small, large = np.minimum(sizes[0][r], sizes[1]), np.maximum(sizes[0][r], sizes[1])
                hit = np.flatnonzero((parts[0][r] != parts[1]) & (100 * small >= similarity * large)
                                     & (~outer[1] | (ids[0][r] < ids[1])))
                hit = hit[(short[0][r] == short[1][hit]).all(axis=2).argmax(axis=1) == band]
                hit = hit[HALVES[long[0][r] ^ long[1][hit]].sum(axis=1) >= agreement]
                xs.append(np.minimum(ids[0][r], ids[1][hit]))
                ys.append(np.maximum(ids[0][r], ids[1][hit]))
        return pa.table({"x": np.concatenate(xs), "y": np.concatenate(ys)})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "x long, y long")


def minhash(docs: DataFrame, doc_id="doc_id", text="text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if their sets of distinct shingles of words (between ASCII
    white space, A-Z lower-cased) have at least ``similarity`` percent of their union
    in common. A text of fewer words than a shingle is one shingle; null and empty
    texts and texts of white space have an empty set, which is linked with nothing.
    ``component_id`` is the smallest id reachable by links, null if no row of the
    component has an id; ``kept`` says that it is the row's own id (null and null count
    as the same). Repeated rows come back as often as they are there; an empty table
    gives an empty result. Other columns of the input are not read.

    Rows with one set are one class, and only classes are compared. The first member
    of a band's bucket is verified with all others; what is not in one component then
    meets in blocks (:func:`open_pairs`). A linked pair shares a band, and agrees in
    enough coordinates of a longer sketch, but for a chance below 1e-7 each; every
    link is confirmed on full sets.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # texts are found again by id and hash; two texts of one id and hash would have to collide in 64 bits
    rows = rows.withColumn("h", F.xxhash64(text_of("text")))
    per_band = band_rows(similarity=similarity / 100)
    marks = scratch.keep(with_sketches(rows, ["doc_id", "h"], "text", shingle, per_band), "marks")
    filled = marks.where("n > 0").groupBy("n", "a", "b").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("row"),
        F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    classes = scratch.keep(filled.withColumn("id", F.monotonically_increasing_id()), "classes")

    entries = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = scratch.keep(entries.join(shared.drop("_n"), "key"), "shared")
    wanted = shared.select("id").distinct().join(classes.select("id", "row.doc_id", "row.h"), "id")
    found = null_safe_join(rows, sized(wanted, OFFSET_ROWS), ["doc_id", "h"])
    texts = found.groupBy("id").agg(F.first("text").alias("text"))     # repeated rows are one
    sets = scratch.keep(with_sets(texts, "id", "text", shingle), "sets")

    firsts = shared.where("id <> head").select(F.col("head").alias("x"), F.col("id").alias("y")).distinct()
    edges = scratch.keep(verified(firsts, sets, similarity), "firsts")
    near = scratch.keep(components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))), "near")

    members = shared.select("key", "band", "id").join(near, F.col("id") == F.col("node"), "left").select(
        "key", "band", "id", F.coalesce("component", "id").alias("component"))
    prints = classes.select("id", "n", "bytes").join(sets.select("id", "long"), "id")
    agreement = least_agreement(similarity=similarity / 100)
    more = verified(open_pairs(members, prints, agreement, per_band, similarity), sets, similarity)
    part = lambda c, out: near.select(F.col("node").alias(c), F.col("component").alias(out))
    more = (more.join(part("x", "cx"), "x", "left").join(part("y", "cy"), "y", "left")
            .select(F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("b")))
    last = components(scratch.keep(more, "more"))
    joined = near.join(last.withColumnsRenamed({"node": "_node", "component": "_last"}), F.col("component") == F.col("_node"), "left")
    joined = joined.select("node", F.coalesce("_last", "component").alias("component"))
    # a class without an edge of its own in the first round may be in the second only
    late = last.join(near, "node", "left_anti")
    final = joined.unionByName(late.select("node", "component"))
    named = classes.select("id", "n", "a", "b", "least").join(final, F.col("id") == F.col("node"), "left")
    named = named.select("n", "a", "b", "least", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.keep(named.join(least, "component").select("n", "a", "b", "component_id", F.lit(True).alias("_known")), "named")
    out = marks.select("doc_id", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"),
                     F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    scratch.drop("shared", "sets", "firsts", "near", "more", "classes")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
