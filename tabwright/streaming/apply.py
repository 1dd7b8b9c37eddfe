"""Fitted transforms on a stream: fit once on a table, apply to arriving rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.fitted import Fitted


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
               files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def apply_fitted(stream: DataFrame, fitted: Fitted, out_path: str, checkpoint: str,
                 columns: Sequence[str] | None = None, available_now: bool = True):
    """Start a query that appends transformed rows to Parquet files.

    Transforms are row-wise expressions and joins with small fixed tables, so
    the query keeps no state. One that looks at all rows it is given at once
    (``per_batch``) is applied to each batch, whose rows replace what an earlier
    try wrote to the folder ``batch=<number>``.
    """
    if fitted.per_batch:
        def write(batch: DataFrame, number: int) -> None:
            rows = fitted.transform(batch)
            (rows.select(*columns) if columns else rows).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    rows = fitted.transform(stream)
    if columns:
        rows = rows.select(*columns)
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out_path)
