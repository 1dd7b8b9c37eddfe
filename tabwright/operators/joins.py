"""Joins by key; no operator relies on row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordered import sized


def attach_assets(table: DataFrame, index: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of the table that have an asset, with the asset's columns."""
    return table.join(index, key, "inner")


def keep_known(index: DataFrame, table: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Index entries whose key is in the table."""
    return index.join(table.select(key), key, "left_semi")


def missing_assets(table: DataFrame, index: DataFrame, key: str, slots: int = 1) -> DataFrame:
    """Keys of the table with fewer than ``slots`` distinct assets."""
    if slots == 1:
        return table.select(key).join(index.select(key), key, "left_anti").distinct()
    have = index.groupBy(key).agg(F.countDistinct("slot").alias("n"))
    return (table.select(key).distinct().join(have, key, "left")
            .where(F.coalesce("n", F.lit(0)) < slots).select(key))


def with_label_name(df: DataFrame, labels: DataFrame, left: str, right: str) -> DataFrame:
    """Dimension lookup; the label table is broadcast if its size allows."""
    labels = sized(labels.distinct())
    return df.join(labels, df[left] == labels[right], "left").drop(labels[right])


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail with a message if a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").select(key).first()
    if twice is not None:
        raise ValueError(f"{key}={twice[0]!r} occurs more than once")
    return df


def join_features(a: DataFrame, b: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Columns of two feature tables of the same rows, by unique key."""
    if check:
        require_unique(a, key)
        require_unique(b, key)
    return a.join(b, key, "inner")


def concat_tokens(a: DataFrame, b: DataFrame, key: str, tokens: str, out: str | None = None) -> DataFrame:
    """Token lists of two modalities, one after the other, per key."""
    out = out or tokens
    right = b.select(key, F.col(tokens).alias("_tokens"))
    return a.join(right, key, "inner").withColumn(out, F.concat(F.col(tokens), F.col("_tokens"))).drop("_tokens")


def stack(a: DataFrame, b: DataFrame, role: str = "role", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    return a.withColumn(role, F.lit(names[0])).unionByName(b.withColumn(role, F.lit(names[1])))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).where(F.col(c).isNotNull()).distinct()
