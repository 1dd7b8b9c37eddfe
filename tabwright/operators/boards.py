"""Profiles, input checks, leaderboards and summaries of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .encode import value_counts
from .metrics import evaluate


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_rows, n_null, n_unique): exact, from one combined count of all cells."""
    counts = value_counts(df, cols or df.columns)
    return counts.groupBy(F.col("c").alias("column")).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("text").alias("n_unique"))


def input_checks(df: DataFrame, features: Sequence[str], target: str, classification: bool = True,
                 max_rows: int = 10_000, max_features: int = 500, max_classes: int = 10) -> DataFrame:
    """(check, value, limit, status): 'error' stops a fit, 'warning' only tells."""
    y = F.col(target)
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    bad = y.isNull() | (F.isnan(y.cast("double")) | (F.abs(y.cast("double")) == float("inf"))) if numeric else y.isNull()
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("bad"),
                 (F.countDistinct(y) if classification else F.lit(0)).alias("classes")).first()
    checks = [("min_rows", row["rows"], 2, "error" if row["rows"] < 2 else "ok"),
              ("min_features", len(features), 1, "error" if not features else "ok"),
              ("finite_target", row["bad"] or 0, 0, "error" if row["bad"] else "ok"),
              ("max_rows", row["rows"], max_rows, "warning" if row["rows"] > max_rows else "ok"),
              ("max_features", len(features), max_features, "warning" if len(features) > max_features else "ok")]
    if classification:
        checks.append(("max_classes", row["classes"], max_classes, "error" if row["classes"] > max_classes else "ok"))
    return df.sparkSession.createDataFrame(checks, "check string, value long, limit long, status string")


def grouped_scores(df: DataFrame, metrics: Sequence[str], group: str, within: Sequence[str],
                   how: str = "mean", **contract) -> DataFrame:
    """Scores per (group, within...), then per group, then overall: (level, group, metric, score).

    Undefined scores are skipped at each level.
    """
    combine = {"mean": F.avg, "sum": F.sum}[how]
    fine = evaluate(df, metrics, by=[group, *within], **contract)
    score = F.when(~F.isnan("score"), F.col("score"))
    per_group = fine.groupBy(F.col(group).cast("string").alias("group"), "metric").agg(combine(score).alias("score"))
    overall = per_group.groupBy("metric").agg(combine("score").alias("score"))
    return per_group.select(F.lit("group").alias("level"), "group", "metric", "score").unionByName(
        overall.select(F.lit("overall").alias("level"), F.lit("all").alias("group"), "metric", "score"))


def metric_matrix(results: DataFrame, methods: Sequence[str], dataset: str = "dataset", method: str = "method",
                  score: str = "score") -> DataFrame:
    """Datasets as rows; mean and sample deviation over runs per method as columns."""
    wide = results.groupBy(dataset).pivot(method, list(methods)).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    return wide


def ranks_and_wins(results: DataFrame, dataset: str = "dataset", method: str = "method",
                   score: str = "score") -> DataFrame:
    """(method, mean_rank, wins): descending average rank per dataset after rounding to 3 digits.

    Windows run over the result table (methods per dataset), not over data rows.
    """
    rounded = results.withColumn("_s", F.round(score, 3))
    rank = F.rank().over(W.partitionBy(dataset).orderBy(F.desc("_s")))
    ties = F.count(F.lit(1)).over(W.partitionBy(dataset, "_s"))
    ranked = rounded.withColumn("rank", rank + (ties - 1) / 2)
    return ranked.groupBy(method).agg(F.avg("rank").alias("mean_rank"),
                                      F.sum((F.col("rank") == 1).cast("long")).alias("wins"))


def seed_summary(runs: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Mean and population deviation over runs; failed runs (null) do not count."""
    return runs.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
                                 F.count(score).alias("n_runs"))


def grid_table(runs: DataFrame, a_values: Sequence[int], b_values: Sequence[int], a: str = "a", b: str = "b",
               score: str = "score") -> DataFrame:
    """Every (a, b) of the grid with mean, std, validity (a >= b) and the best cell; invalid cells score 0."""
    cells = [(int(x), int(y)) for x in a_values for y in b_values]
    grid = runs.sparkSession.createDataFrame(cells, f"{a} int, {b} int")
    table = grid.join(seed_summary(runs, [a, b], score), [a, b], "left")
    valid = F.col(a) >= F.col(b)
    table = table.select(a, b, valid.alias("valid"), F.when(valid, F.col("mean")).otherwise(0.0).alias("mean"),
                         F.when(valid, F.col("std")).otherwise(0.0).alias("std"))
    best = F.row_number().over(W.orderBy(F.desc_nulls_last("mean"), a, b)) == 1  # over the grid
    return table.withColumn("best", best)


def axis_mean(grid: DataFrame, axis: str, value: str = "mean") -> DataFrame:
    return grid.groupBy(axis).agg(F.avg(value).alias(value))
