"""Merkle manifest of a dataset: hash trees per language by slot pivot, proofs of every row and their check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordered import null_safe_join, sized
from .common import BUCKET_ROWS, Scratch

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the fields joined: ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
             for v in values]
    return F.sha2(F.concat(*parts), 256)


def ordered_rows(df: DataFrame, order: list[str], out: str, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """Add ``out``, the row's number from 0 in the order of the columns, nulls first.

    Spark range-sorts the rows; they are written with the number of their range, so
    that a lost task gives the same ranges again. Counts per range make the offsets,
    one row per BUCKET_ROWS rows.
    """
    parts = max(1, math.ceil(rows / BUCKET_ROWS))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt, name)
    upto, offsets = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, upto))
        upto += n
    before = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    inside = W.partitionBy("_part").orderBy(*order)
    return (dealt.join(before, "_part")
            .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_part", "_before"))


def parents(nodes: DataFrame, carried: list[str] = (), fanout: int = FANOUT) -> DataFrame:
    """One row per parent: grp, pos, n (nodes of the group on the parents' level), alone, hash and the children's columns.

    The slot pivot: a conditional aggregate per slot spreads the children of a parent
    into ``c0`` ... (and ``<column>0`` ... for the carried ones), their concatenation is
    hashed. A group's only node is handed up as it is (``alone``).
    """
    slots = range(fanout)
    pick = lambda c, k: F.max(F.when(F.col("_slot") == k, F.col(c))).alias(f"{'c' if c == 'hash' else c}{k}")
    split = nodes.withColumns({"_slot": F.pmod("pos", F.lit(fanout)), "_up": F.floor(F.col("pos") / fanout)})
    rows = split.groupBy("grp", "_up").agg(F.max("n").alias("_n"), *[pick(c, k) for c in ("hash", *carried) for k in slots])
    alone = F.col("_n") == 1
    joined = F.concat(*[F.coalesce(F.col(f"c{k}"), F.lit("")) for k in slots])
    return rows.select("grp", F.col("_up").alias("pos"), F.ceil(F.col("_n") / fanout).alias("n"), alone.alias("alone"),
                       F.when(alone, F.col("c0")).otherwise(F.sha2(joined, 256)).alias("hash"),
                       *[f"{'c' if c == 'hash' else c}{k}" for c in ("hash", *carried) for k in slots])


def climb(nodes: DataFrame, scratch: Scratch, name: str, most: int, carried: list[str] = (),
          fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """(levels of parents from the leaves up, the groups' last nodes); ``most`` is the size of the largest group.

    Level k has an eighth of the rows of level k - 1, and each is written once. The
    groups are hashed by (group, parent), so one that holds all rows is dealt out as well.
    """
    levels, k = [], 0
    while most > 1 or not levels:
        level = scratch.keep(parents(nodes, carried if not levels else [], fanout), f"{name}-{k}")
        levels.append(level)
        nodes, most, k = level.select("grp", "pos", "n", "hash"), -(-most // fanout), k + 1
    return levels, nodes


def siblings(level: DataFrame, above: DataFrame, carried: list[str] = (), fanout: int = FANOUT) -> DataFrame:
    """Every node of a level below ``above`` (grp, pos, path): grp, pos, hash, the carried columns and its path to the top.

    A path lists, from the node's own level up, what is hashed before and after it;
    the node's own slot column is left out, the others are its siblings.
    """
    cell = lambda k: F.coalesce(F.col(f"c{k}"), F.lit(""))
    side = lambda ks: F.unhex(F.concat(F.lit(""), *[cell(k) for k in ks]))
    slots = F.array(*[F.struct(
        F.lit(k).cast("long").alias("slot"), F.col(f"c{k}").alias("hash"), *[F.col(f"{c}{k}").alias(c) for c in carried],
        side(range(k)).alias("before"), side(range(k + 1, fanout)).alias("after")) for k in range(fanout)])
    rows = level.join(above, ["grp", "pos"]).select("grp", "pos", "alone", "path", F.explode(slots).alias("s")).where("s.hash is not null")
    step = F.array(F.struct(F.col("s.before").alias("before"), F.col("s.after").alias("after")))
    return rows.select("grp", (F.col("pos") * fanout + F.col("s.slot")).alias("pos"), F.col("s.hash").alias("hash"),
                       *[F.col(f"s.{c}").alias(c) for c in carried],
                       F.when(F.col("alone"), F.col("path")).otherwise(F.concat(step, F.col("path"))).alias("path"))


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    as_hex = lambda b: F.lower(F.hex(b))
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(as_hex(s["before"]), h, as_hex(s["after"])), 256))


def proof(path: Column) -> Column:
    """Hex SHA-256 of all siblings of a path, left to right, level by level."""
    digests = F.transform(path, lambda s: F.lower(F.concat(F.hex(s["before"]), F.hex(s["after"]))))
    return F.sha2(F.array_join(digests, ""), 256)


def manifest(docs: DataFrame, fields=FIELDS, key: str = "doc_id", group: str = "lang", tampered: Column | None = None,
             text: str = "text", fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf hashes the row's ``fields``. The leaves of a group ascend by key (nulls
    first, ties by leaf hash; two rows alike in all fields have one leaf and take
    neighbouring places) and are hashed in runs of ``fanout`` until one node, the
    subroot, is left; the subroots in the order of their groups (null first) likewise
    give the root. ``tampered`` is the text that the check finds where it differs from
    the one hashed: ``folded_root`` follows from its leaf and the original siblings,
    ``verified`` says whether it is the root. Null and empty texts hash differently.
    Repeated rows come back as often as they are there; an empty table gives an empty
    result. Columns that are no field are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    original = [F.col(c) for c in fields]
    found = [tampered if c == text and tampered is not None else F.col(c) for c in fields]
    # one struct column per use: names of the input cannot clash with those here
    leaves = scratch.keep(docs.select(F.col(key).alias("doc_id"), F.col(group).cast("string").alias("_lang"),
                                      leaf_digest(original).alias("hash"), leaf_digest(found).alias("now")), "leaves")
    sizes = scratch.keep(leaves.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    groups = scratch.keep(ordered_rows(sizes, ["_lang"], "grp", scratch, "group-order", total["groups"]), "groups")

    # numbers over all rows, less the number of the group's first row, are places in the group
    numbered = ordered_rows(leaves, ["_lang", "doc_id", "hash"], "number", scratch, "order", total["rows"] or 0)
    starts = numbered.groupBy("_lang").agg(F.min("number").alias("first"))
    named = sized(null_safe_join(groups, starts, ["_lang"]))
    nodes = null_safe_join(numbered, named, ["_lang"]).select(
        "grp", (F.col("number") - F.col("first")).alias("pos"), "n", "hash", F.struct("doc_id", "now").alias("row"))
    levels, tops = climb(nodes, scratch, "level", total["most"] or 0, ["row"], fanout)

    tops = scratch.keep(tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"),
                                    F.lit(total["groups"]).cast("long").alias("n"), "hash"), "tops")
    upper, root = climb(tops, scratch, "upper", total["groups"], fanout=fanout)
    root = root.select("hash").first()
    root = root["hash"] if root else None
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    paths = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("grp"), F.lit(0).cast("long").alias("pos"), empty.alias("path"))
    for level in reversed(upper):
        paths = siblings(level, paths.select("grp", "pos", "path"), fanout=fanout)
    subroots = scratch.keep(paths.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"),
                                         F.col("hash").alias("subroot"), "path"), "subroots")
    above = subroots.select("grp", "pos", "path")
    for k in range(len(levels) - 1, 0, -1):
        above = scratch.keep(siblings(levels[k], above, fanout=fanout).select("grp", "pos", "path"), f"paths-{k}")
    rows = siblings(levels[0], above, ["row"], fanout)
    rows = rows.join(sized(subroots.select("grp", "subroot")), "grp").select(
        F.col("row.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"),
        proof(F.col("path")).alias("proof_sha256"), fold(F.col("row.now"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(key: str = "doc_id", text: str = "text", divisor: int = 3) -> Column:
    """The text with A-Z lower-cased where ``divisor`` divides the unsigned CRC-32 of the decimal key, else the text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % divisor == 0
    return F.when(hit, F.translate(F.col(text), upper, lower)).otherwise(F.col(text))
