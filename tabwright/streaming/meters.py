"""Running meters of metric series on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.history import lower_median
from ..operators.ordered import null_safe_join

SALTS = 32


def _last(rows: DataFrame, series: str, step: str, n: int, *salt: str) -> DataFrame:
    w = W.partitionBy(series, *salt).orderBy(F.desc(step))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def merge_batch(state: DataFrame | None, batch: DataFrame, series: str, step: str, value: str, last: int = 20) -> DataFrame:
    """(series, last, total, count) after one more batch.

    The batch is cut to its last rows per (series, salt) before it meets the
    state, so a series with most of the rows is spread over many tasks.
    """
    rows = batch.select(F.col(series), F.col(step).alias("step"), F.col(value).cast("double").alias("value"))
    sums = rows.groupBy(series).agg(F.sum("value").alias("total"), F.count("value").alias("count"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("step"), F.lit(SALTS)))
    recent = _last(salted, series, "step", last, "_salt").drop("_salt")
    if state is not None:
        recent = recent.unionByName(state.select(series, F.explode("last").alias("_it")).select(series, "_it.step", "_it.value"))
        sums = sums.unionByName(state.select(series, "total", "count"))
    kept = _last(recent, series, "step", last).groupBy(series).agg(
        F.sort_array(F.collect_list(F.struct("step", "value"))).alias("last"))  # at most ``last`` entries
    totals = sums.groupBy(series).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    return null_safe_join(kept, totals, [series])


def meter_values(state: DataFrame, series: str) -> DataFrame:
    """(series, step, value, median, avg, global_avg, max) from the state."""
    values = F.transform("last", lambda s: s["value"])
    return state.withColumn("_v", values).select(
        series, F.col("last")[F.size("last") - 1]["step"].alias("step"),
        F.element_at("_v", -1).alias("value"), lower_median(F.col("_v")).alias("median"),
        (F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.size("_v")).alias("avg"),
        (F.col("total") / F.col("count")).alias("global_avg"), F.array_max("_v").alias("max"))


class RunningMeter:
    """Meter state of a stream, one Parquet version per micro-batch.

    A version is written from the one before and the batch; a repeated batch
    overwrites its own version, so retries do not count twice.
    """

    def __init__(self, path: str, series: str, step: str, value: str, last: int = 20):
        self.path, self.series, self.step, self.value, self.last = path.rstrip("/"), series, step, value, last

    def version(self, batch_id: int) -> str:
        return f"{self.path}/version={batch_id}"

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(self.version(batch_id - 1)) if batch_id > 0 else None
        merge_batch(state, batch, self.series, self.step, self.value, self.last).write.mode("overwrite").parquet(
            self.version(batch_id))

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.update)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def values(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return meter_values(spark.read.parquet(self.version(batch_id)), self.series)


def windowed_averages(stream: DataFrame, series: str, ts: str, value: str, window: str = "1 day") -> DataFrame:
    """(window start, series, n, mean) per tumbling window; partial sums are combined before the shuffle.

    There is no watermark: a late row changes its window, and the state is one row per
    window and series. Write it with :class:`WindowTable`.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    return timed.groupBy(F.window("_ts", window).alias("_w"), series).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean")).select(
            F.col("_w.start").alias("start"), series, "n", "mean")


class WindowTable:
    """Keyed table of a windowed stream: every micro-batch writes the windows it changed, the latest of a key counts.

    A repeated batch overwrites its own part, so retries change nothing.
    """

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path.rstrip("/"), keys

    def update(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, windows: DataFrame, checkpoint: str, available_now: bool = True):
        writer = windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(self.update)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def rows(self, spark: SparkSession) -> DataFrame:
        parts = spark.read.parquet(self.path)
        values = [c for c in parts.columns if c not in (*self.keys, "batch")]
        latest = parts.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("_s"))
        return latest.select(*self.keys, "_s.*")
