"""Indexes of image folders and archives, from paths and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import with_label_name
from ..operators.ordered import next_value

# The archive log's marker of an empty block and the one entry
# that is known to be unreadable.
NUL_BLOCK = "** Block of NULs **"
UNREADABLE = ("n06470073_47249.JPEG",)
BLOCK_BYTES = 512


def asset_index(df: DataFrame, path: str, pattern: str = r"([^/]+)-(\d+)\.jpg$") -> DataFrame:
    """(key, slot) of every path that matches ``<key>-<slot>.jpg``, with the path."""
    p = F.col(path)
    return df.where(p.rlike(pattern)).select(
        F.regexp_extract(p, pattern, 1).alias("key"),
        F.regexp_extract(p, pattern, 2).cast("int").alias("slot"), p.alias("path"))


def folder_index(paths: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Entries of a class-folder layout ``.../<class_id>/<class_id>_<index>.<ext>``.

    ``labels`` has class_id, class_index, class_name.
    """
    p = F.col(path)
    entries = paths.select(F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("class_id"),
                           F.regexp_extract(p, r"_(\d+)\.[^./]+$", 1).try_cast("long").alias("actual_index"))
    lookup = labels.select(F.col("class_id").alias("_id"), "class_index", "class_name")
    return with_label_name(entries, lookup, "class_id", "_id")


def block_index(lines: DataFrame, line: str = "value", class_id: str = "class_id",
                skip: tuple[str, ...] = UNREADABLE) -> DataFrame:
    """Byte ranges of archive members from lines ``block <n>: <file name>``.

    A member ends where the next entry of its archive starts; empty blocks end a
    member but are none themselves.
    """
    blocks = lines.select(
        class_id, F.regexp_extract(line, r"^block (\d+):", 1).cast("long").alias("block"),
        F.regexp_extract(line, r": (.*?)\s*$", 1).alias("filename"))
    ranged = next_value(blocks, [class_id], "block", "next_block")
    return (ranged.where((F.col("filename") != NUL_BLOCK) & ~F.col("filename").isin(*skip)
                         & F.col("next_block").isNotNull())
            .select(class_id, "filename", (F.col("block") * BLOCK_BYTES).alias("start_offset"),
                    (F.col("next_block") * BLOCK_BYTES).alias("end_offset")))


def class_dictionary(entries: DataFrame) -> DataFrame:
    """One row per class_index with its id and name."""
    return entries.groupBy("class_index").agg(F.max("class_id").alias("class_id"),
                                              F.max("class_name").alias("class_name"))
