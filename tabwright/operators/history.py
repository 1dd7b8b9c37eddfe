"""Histories of metrics: smoothed meters, best step, early stop, running centre."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import halo_blocks, running


def lower_median(values: Column) -> Column:
    """Middle element of a list, the lower of the two for an even count."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) / 2).cast("int"))


def smoothed_meter(df: DataFrame, by: Sequence[str], step: str, value: str, last: int = 20,
                   block_rows: int = 100_000) -> DataFrame:
    """Per row: median, mean and max of the last ``last`` values and the mean of all so far.

    ``step`` is unique inside a series. A long series is cut into blocks with
    the preceding ``last - 1`` rows, so no task holds a series.
    """
    by = list(by)
    rows = df.select(*by, step, value).withColumn("_one", F.lit(1))
    so_far = running(rows, by, step, {"_sum": value, "_pos": "_one"})
    blocks = halo_blocks(so_far, by, "_pos", last - 1, block_rows)
    w = W.partitionBy(*by, "_block").orderBy(step).rowsBetween(-(last - 1), 0)
    out = blocks.select(
        *by, step, value, "_halo", F.collect_list(value).over(w).alias("_last"),
        ((F.col("_sum") + F.col(value)) / (F.col("_pos") + 1)).alias("global_avg"))
    return out.where(~F.col("_halo")).select(
        *by, step, value, lower_median(F.col("_last")).alias("median"),
        (F.aggregate("_last", F.lit(0.0), lambda a, x: a + x) / F.size("_last")).alias("avg"),
        "global_avg", F.array_max("_last").alias("max"))


def best_step(df: DataFrame, by: Sequence[str], step: str = "step", score: str = "score") -> DataFrame:
    """(by..., best_step, best_score); the earliest step wins ties."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(step)).alias("t")))
    return df.where(F.col(score).isNotNull()).groupBy(*by).agg(top.alias("_b")).select(
        *by, (-F.col("_b.t")).alias("best_step"), F.col("_b.s").alias("best_score"))


def patience(best: Column, rate: float, offset: float, least: int, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.bround(best * rate + offset, 0)))


def early_stop(df: DataFrame, by: Sequence[str], step: str = "step", score: str = "score", rate: float = 0.3,
               offset: float = 10, min_patience: int = 50, max_patience: int = 10_000) -> DataFrame:
    """(by..., stop_step, best_step, best_score): where adaptive patience ends each run.

    A run stops at the first step that is no new best and lies the patience of
    the best step or more behind it; ``stop_step`` is null if that never happens.
    """
    by = list(by)
    rows = df.select(*by, step, score).withColumn(
        "_mark", F.struct(F.col(score).alias("s"), (-F.col(step)).alias("t")))
    seen = running(rows, by, step, maxes={"_before": "_mark"})
    is_best = F.col("_before").isNull() | (F.col(score) > F.col("_before.s"))
    best = F.when(is_best, F.col(step)).otherwise(-F.col("_before.t"))
    stops = ~is_best & (F.col(step) - best >= patience(best, rate, offset, min_patience, max_patience))
    marked = seen.select(*by, F.col(step).alias("_step"), best.alias("_best"), F.greatest(
        F.col(score), F.col("_before.s")).alias("_top"), stops.alias("_stops"))
    first = F.min(F.when(F.col("_stops"), F.struct("_step", "_best", "_top")))
    final = F.max(F.struct("_step", "_best", "_top"))
    ends = marked.groupBy(*by).agg(first.alias("_first"), final.alias("_final"))
    return ends.select(*by, F.col("_first._step").alias("stop_step"),
                       F.coalesce("_first._best", "_final._best").alias("best_step"),
                       F.coalesce("_first._top", "_final._top").alias("best_score"))


def running_centre(df: DataFrame, by: Sequence[str], batch: str, value: str, momentum: float = 0.9,
                   block_rows: int = 100_000) -> DataFrame:
    """(by..., batch, batch_mean, centre): exponential average of batch means, starting at 0.

    Rows are reduced to batch means first. Each centre folds the batches whose
    weight still shows in a double, so blocks need a bounded number of earlier
    batches.
    """
    by = list(by)
    means = df.groupBy(*by, batch).agg(F.avg(value).alias("batch_mean")).withColumn("_one", F.lit(1))
    reach = 1
    while momentum**reach > 1e-18:
        reach += 1
    placed = running(means, by, batch, {"_pos": "_one"})
    blocks = halo_blocks(placed, by, "_pos", reach - 1, block_rows)
    w = W.partitionBy(*by, "_block").orderBy(batch).rowsBetween(-(reach - 1), 0)
    folded = F.aggregate(F.collect_list("batch_mean").over(w), F.lit(0.0),
                         lambda acc, m: acc * momentum + m * (1 - momentum))
    return blocks.withColumn("centre", folded).where(~F.col("_halo")).select(*by, batch, "batch_mean", "centre")
