"""Text expressions, row identity, prefix sums over range buckets and scratch tables."""

from __future__ import annotations

import gc
import math
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.ordered import OFFSET_ROWS, cut_points, null_safe_join, sized, with_buckets
from ..session import remove, scratch_table

SPACE = r"\x20\x09-\x0D"      # the six ASCII white-space characters
WORD = f"[^{SPACE}]+"
BUCKET_ROWS = 200_000         # rows that one range bucket should hold at most, on average


def text_of(col: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """Number of words as a long; null counts 0."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def row_key(seed, *cols: str) -> Column:
    """60 random bits as a long, a function of the seed and the named columns.

    Every value is marked as null or not, so that nulls and empty strings differ.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes not to clash with a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, size: int = 16 << 20):
    """Smaller Arrow batches while a plan runs: texts are held several times over between the JVM and Python."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


_kept: list[str] = []     # scratch tables written and not dropped yet, in the order they were written


class Scratch:
    """Written tables below the shared folder, each of which can be dropped once it has been used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_table(self.spark, f"llm-{name}")
        _kept.append(path)
        with arrow_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name)
            remove(self.spark, path)
            _kept.remove(path)


@contextmanager
def kept_tables():
    """A list that on leaving the block holds the scratch tables written inside and not dropped."""
    before, out = set(_kept), []
    yield out
    out += [p for p in _kept if p not in before]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Drop scratch tables that no result reads any more; have Spark drop the shuffle files of plans that are gone."""
    for path in paths:
        if path in _kept:
            remove(spark, path)
            _kept.remove(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def key_bits(rows: int, target: int = BUCKET_ROWS) -> int:
    """Leading bits of a uniform key so that a bucket holds about ``target`` rows."""
    return max(1, math.ceil(math.log2(max(1, rows / target))))


def key_bucket(key: Column, bits: int, width: int = 60) -> Column:
    """The leading ``bits`` of a key of ``width`` random bits: buckets in key order."""
    return F.shiftright(key, width - bits).cast("long")


def before(totals: DataFrame, by: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """``totals`` plus the sum of ``value`` over the group's earlier buckets."""
    w = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def numbered(df: DataFrame, order: str, ties: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's number from 0 in the order of a numeric column and then ``ties``, nulls last.

    Rows are cut into range buckets of the order column (rows without a value into
    hash buckets of the last tie column, which must then be uniform hex digits);
    counts per bucket give the offsets, and only rows of one bucket are sorted
    together.
    """
    b, h = fresh(df, "_bucket"), fresh(df, "_part")
    cuts = cut_points(df, [order])
    marked = with_buckets(df, cuts).withColumnRenamed(f"_b_{order}", b)
    marked = marked.withColumns({
        h: F.when(F.col(order).isNull(), F.substring(ties[-1], 1, 2)).otherwise(F.lit("")),
        b: F.when(F.col(order).isNull(), F.lit(2**31 - 1)).otherwise(F.col(b))})
    counts = marked.groupBy(b, h).agg(F.count(F.lit(1)).alias("_n"))
    w = W.orderBy(b, h).rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select(b, h, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(b, h).orderBy(order, *ties)
    return (null_safe_join(marked, sized(offsets, OFFSET_ROWS), [b, h])
            .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1).drop(b, h, "_offset"))
