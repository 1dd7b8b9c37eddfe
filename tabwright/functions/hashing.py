"""Seeded order: every random choice is an order by an md5 of seed and key.

The result does not depend on partitioning or on the number of executors, and
another SQL engine can compute the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(seed, *cols: str | Column) -> Column:
    """32 hex digits; ordering by it is a seeded random permutation."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", seed.cast("string"), *[p.cast("string") for p in parts]))


def hash_int(hash_col: str | Column, digits: int = 13) -> Column:
    """The first hex digits as a long (13 digits fit a double exactly)."""
    col = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("long")


def hash_unit(hash_col: str | Column) -> Column:
    """Uniform number in [0, 1) with 52 random bits."""
    return hash_int(hash_col, 13) / F.lit(float(16**13))
