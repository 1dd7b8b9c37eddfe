"""Exact, reproducible splits, folds and samples.

All choices order rows by a seeded md5 of their unique key. Exact sizes come
from threshold hashes, so splitting is a filter and never sorts or shuffles the
table; only operators that must number every row (epoch orders) do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import seeded_hash
from .ordered import hash_rank, hash_thresholds, null_safe_join, prefix_digits, sized, take_first


def _rank_table(df: DataFrame, ranks: Sequence[int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(r),) for r in ranks], "rank long")


def split(df: DataFrame, key: str, sizes: Mapping[str, int | Callable[[int], int]] | None = None,
          rest: str = "test", seed: int = 0, out: str = "split") -> DataFrame:
    """Label rows with exact sizes; by default int(0.8 n) 'train' and the rest 'test'.

    ``sizes`` maps a label to a row count or to a function of n, in order.
    """
    sizes = sizes or {"train": lambda n: int(0.8 * n)}
    n = df.count()
    marked = df.withColumn("_h", seeded_hash(seed, key))
    total, ranks = 0, {}
    for label, size in sizes.items():
        total += size(n) if callable(size) else size
        ranks[label] = min(total, n)
    table = hash_thresholds(marked, "_h", _rank_table(df, sorted(set(ranks.values()))),
                            digits=prefix_digits(n))
    at = {r["rank"]: r["threshold"] for r in table.collect()}  # one row per label
    label: Column | None = None
    for name, rank in ranks.items():
        hit = F.col("_h") <= F.lit(at[rank])
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return marked.withColumn(out, label.otherwise(rest)).drop("_h")


def three_way_split(df: DataFrame, key: str, seed: int = 0, out: str = "split") -> DataFrame:
    """80 % train, a tenth of the train size for validation, the rest test."""
    return split(df, key, {"train": lambda n: int(0.8 * n), "valid": lambda n: int(0.1 * int(0.8 * n))},
                 "test", seed, out)


def tuning_holdout(df: DataFrame, key: str, seed: int = 0, out: str = "split") -> DataFrame:
    """A random tenth for tuning, the rest for training."""
    return split(df, key, {"tune": lambda n: n // 10}, "train", seed, out)


def class_quotas(df: DataFrame, y: str, take: int, n: int) -> DataFrame:
    """(y, rank): how many rows each class gives to ``take`` of the ``n`` rows, by largest remainder."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") * F.lit(float(take)) / F.lit(float(max(n, 1)))
    quotas = counts.withColumn("_floor", F.floor(share)).withColumn("_rest", F.round(share - F.floor(share), 9))
    order = W.orderBy(F.desc("_rest"), F.asc(y))  # over the class table only
    left = F.lit(take) - F.sum("_floor").over(W.partitionBy())
    return quotas.withColumn("_place", F.row_number().over(order)).select(
        y, (F.col("_floor") + F.when(F.col("_place") <= left, 1).otherwise(0)).cast("long").alias("rank"))


def stratified_split(df: DataFrame, key: str, y: str, frac: float, seed: int = 0,
                     names: tuple[str, str] = ("train", "test"), out: str = "split") -> DataFrame:
    """Two-way split with class shares kept; ceil(frac * n) rows get ``names[1]``."""
    n = df.count()
    take = math.ceil(round(frac * n, 9))
    marked = df.withColumn("_h", seeded_hash(seed, key))
    flagged = take_first(marked, "_h", class_quotas(df, y, take, n), [y], "_test", prefix_digits(n))
    return flagged.withColumn(out, F.when(F.col("_test"), names[1]).otherwise(names[0])).drop("_h", "_test")


def _fold_ends(df: DataFrame, k: int, by: Sequence[str], y: str | None) -> DataFrame:
    """(by..., fold, rank): last hash rank of each fold within its group.

    With classes, fold i gets every k-th row of the class-sorted table starting
    at i, so folds are balanced over all classes; without, the first n % k folds
    get one row more.
    """
    repeats = [c for c in by if c != y]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if y is None:
        sizes = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
            "_size", F.floor(F.col("_n") / k) + F.when(F.col("fold") < F.col("_n") % k, 1).otherwise(0))
    else:
        start = F.coalesce(F.sum("_n").over(W.partitionBy(*repeats).orderBy(y).rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0))
        spread = counts.withColumn("_s", start).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        upto = F.floor((F.col("_s") + F.col("_n") - 1 - F.col("fold")) / k)
        sizes = spread.withColumn("_size", upto - F.floor((F.col("_s") - 1 - F.col("fold")) / k))
    w = W.partitionBy(*by).orderBy("fold").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sizes.select(*by, "fold", F.sum("_size").over(w).cast("long").alias("rank"))


def kfold(df: DataFrame, key: str, k: int, y: str | None = None, seed: int = 0, repeats: int = 1,
          equal_size: bool = False, out: str = "fold") -> DataFrame:
    """Test fold 0..k-1 of every row, for each ``repeat`` with its own seed.

    With ``equal_size`` the surplus rows of a fold above n // k move to training:
    their fold is -1.
    """
    marked = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "_h", seeded_hash(F.lit(seed) + F.col("repeat"), key))
    by = ["repeat"] + ([y] if y else [])
    ends = sized(_fold_ends(marked, k, by, y))
    limits = hash_thresholds(marked, "_h", ends.select(*by, "rank").distinct(), by)
    table = null_safe_join(ends, limits, [*by, "rank"]).groupBy(*by).agg(
        F.array_sort(F.collect_list("threshold")).alias("_ends"))  # k entries per group
    joined = null_safe_join(marked, sized(table), by)
    fold = F.size(F.filter("_ends", lambda t: t < F.col("_h")))
    result = joined.withColumn(out, fold).drop("_ends")
    if equal_size:
        sizes = result.groupBy("repeat", out).agg(F.count(F.lit(1)).alias("_n"))
        expected = F.floor(F.sum("_n").over(W.partitionBy("repeat")) / k)
        surplus = sizes.select("repeat", out, F.greatest(F.col("_n") - expected, F.lit(0)).cast("long").alias("rank"))
        result = take_first(result, "_h", surplus, ["repeat", out], "_moved")
        result = result.withColumn(out, F.when(F.col("_moved"), -1).otherwise(F.col(out))).drop("_moved")
    return result.drop("_h")


def member_filters(df: DataFrame, key: str, size: int | float, members: int, seed: int = 0) -> list[Column]:
    """One row condition per member: ``size`` rows, or int(size * n) + 1 for a share, drawn independently.

    A condition compares the member's hash of the key with a threshold, so a
    member's rows are a filter of any table that has the key.
    """
    n = df.count()
    if isinstance(size, float):
        if not 0 < size < 1:
            raise ValueError("a fraction must lie in (0, 1)")
        size = int(size * n) + 1
    elif not 1 <= size <= n:
        raise ValueError(f"sample size {size} must lie in [1, {n}]")
    wide = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
    marked = wide.withColumn("_h", seeded_hash(F.lit(seed) + F.col("member"), key))
    wanted = df.sparkSession.createDataFrame([(m, int(size)) for m in range(members)], "member int, rank long")
    limits = {r["member"]: r["threshold"] for r in hash_thresholds(
        marked, "_h", wanted, ["member"], prefix_digits(n)).collect()}
    return [seeded_hash(seed + m, key) <= F.lit(limits[m]) for m in range(members)]


def subsample(df: DataFrame, key: str, size: int | float, members: int, seed: int = 0) -> DataFrame:
    """An independent sample per ensemble member, as rows (member, ...)."""
    inside = member_filters(df, key, size, members, seed)
    members = F.array(*[F.struct(F.lit(m).alias("member"), c.alias("inside")) for m, c in enumerate(inside)])
    wide = df.withColumn("_it", F.explode(members))
    return wide.where("_it.inside").withColumn("member", F.col("_it.member")).drop("_it")


def per_class_sample(df: DataFrame, key: str, y: str, n: int, tries: int = 1, seed: int = 0) -> DataFrame:
    """Up to ``n`` rows of every class, for each ``try`` with its own seed."""
    wide = df.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn(
        "_h", seeded_hash(F.lit(seed) + F.col("try"), key))
    wanted = wide.groupBy("try", y).agg(F.least(F.count(F.lit(1)), F.lit(n)).cast("long").alias("rank"))
    return take_first(wide, "_h", wanted, ["try", y], "_in").where("_in").drop("_h", "_in")


def epoch_order(df: DataFrame, key: str, size: int, shards: int = 1, epoch: int = 0, seed: int = 0) -> DataFrame:
    """(key, tile, shard, position): a shuffled epoch of ``size`` rows dealt to shards in turn.

    Keys are tiled to reach the size; the order of an epoch depends on
    seed * epoch (epoch alone for seed 0).
    """
    tiles = max(1, math.ceil(size / df.count()))
    tiled = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    marked = tiled.withColumn("_h", seeded_hash(seed * epoch if seed else epoch, "tile", key))
    ranked = hash_rank(marked, "_h", "_rank").where(F.col("_rank") <= size)
    place = F.col("_rank") - 1
    return ranked.select(key, "tile", (place % shards).cast("int").alias("shard"),
                         F.floor(place / shards).alias("position"))


def shard_order(df: DataFrame, key: str, shards: int, seed: int = 0, advance: int = 0) -> DataFrame:
    """(key, shard, pass, position): the rest of the pass a sharded reader is in after ``advance`` rows.

    Rows are dealt to shards once; each shard reshuffles them every pass with a
    seed of its own, so whole passes are skipped without replaying them.
    """
    n = df.count()
    per_shard = n // shards
    skipped, left = advance // n, advance % n
    number, skip = skipped + left // per_shard, left % per_shard
    dealt = hash_rank(df.select(key, seeded_hash(seed, key).alias("_h")), "_h", "_rank").where(
        F.col("_rank") <= per_shard * shards)
    sharded = dealt.select(key, ((F.col("_rank") - 1) % shards).cast("int").alias("shard"))
    pass_seed = F.lit(seed) + F.col("shard") + F.lit(number << 24)
    ranked = hash_rank(sharded.withColumn("_h", seeded_hash(pass_seed, key)), "_h", "_rank", ["shard"])
    return ranked.where(F.col("_rank") > skip).select(
        key, "shard", F.lit(number).alias("pass"), (F.col("_rank") - 1).alias("position"))
