"""L: streaming; M: user functions; dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C, reshape as R
from ..operators.fitted import Chain
from ..plans.prepare import Dataset, map_columns, prepare
from ..session import scratch_table
from ..streaming.apply import apply_fitted, read_files
from ..streaming.meters import RunningMeter, WindowTable, windowed_averages
from .base import query, table
from .metrics import rounded


def split_copy(spark, sf):
    """A folder of event files for a file stream, and its schema."""
    path = scratch_table(spark, "events-parts")
    events = table(spark, sf, "events")
    events.repartition(4, "event_id").write.parquet(path)
    return path, events.schema


@query("l1_fitted_on_stream", """WITH q AS (SELECT quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS d FROM events)
    SELECT event_id, round((value - m) / (d / 1.3489795003921634::DOUBLE), 6) AS value FROM events, q""")
def _(spark, sf):
    events = table(spark, sf, "events")
    fitted = Chain([R.fit_robust(events, ["value"])])
    out = scratch_table(spark, "stream-out")
    stream = read_files(spark, *split_copy(spark, sf))
    apply_fitted(stream, fitted, out, scratch_table(spark, "stream-state"), ["event_id", "value"]).awaitTermination()
    return spark.read.parquet(out).withColumn("value", F.round("value", 6))


@query("l2_running_meter", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k, avg(value) OVER (PARTITION BY event_type) AS g FROM events)
    SELECT event_type, max(event_id) AS step, arg_max(value, event_id) AS value, list_sort(list(value))[10] AS median, round(avg(value), 6) AS avg, round(any_value(g), 6) AS global_avg, max(value) AS max
    FROM r WHERE k <= 20 GROUP BY event_type""")
def _(spark, sf):
    path, schema = split_copy(spark, sf)
    meter = RunningMeter(scratch_table(spark, "meter"), "event_type", "event_id", "value")
    run = meter.start(read_files(spark, path, schema, files_per_trigger=1), scratch_table(spark, "meter-state"))
    run.awaitTermination()
    return rounded(meter.values(spark, run.lastProgress["batchId"]), 6, ["avg", "global_avg"])


@query("l2_windowed_averages", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean
    FROM events GROUP BY 1, 2""")
def _(spark, sf):
    windows = WindowTable(scratch_table(spark, "windows"), ["start", "event_type"])
    stream = read_files(spark, *split_copy(spark, sf), files_per_trigger=1)   # days are spread over all files
    windows.start(windowed_averages(stream, "event_type", "ts", "value"), scratch_table(spark, "windows-state")).awaitTermination()
    return windows.rows(spark).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n",
                                      F.round("mean", 6).alias("mean"))


@query("m2_custom_transform", "SELECT event_id, round(sqrt(value), 6) AS root, round(value, 6) AS back FROM events")
def _(spark, sf):
    C.register_transform("root", F.sqrt, lambda x: x * x, replace=True)
    df = C.elementwise(table(spark, sf, "events"), ["value"], "root", "_root")
    inverse = C.TRANSFORMS["root"][1]
    return df.select("event_id", F.round("value_root", 6).alias("root"), F.round(inverse(F.col("value_root")), 6).alias("back"))


@query("m4_row_and_target_transforms", "SELECT p_partkey, upper(p_name) AS p_name, p_size - 1 AS p_size FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return map_columns(df, {"p_name": F.upper, "p_size": lambda y: y - 1})


@query("prepare_documents", """WITH t AS (SELECT doc_id, lang, source, n_chars, quality, text FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
    SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::DOUBLE AS lang, (dense_rank() OVER (ORDER BY source) - 1)::DOUBLE AS source, n_chars::DOUBLE AS n_chars,
      quality::INTEGER AS target, lang || ' ' || coalesce(text, '') AS text FROM t""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.col("text").alias("body"))
    raw = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    spec = Dataset("doc_id", "quality", ("lang", "source"), ("n_chars",), ("lang_name", "body"),
                   derive={"lang_name": lambda: F.col("lang")})
    return prepare(raw, spec)
