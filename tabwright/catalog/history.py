"""K: windows over histories; J29-J30."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H, ordered as O
from .base import query, table
from .metrics import rounded


@query("j29_best_step", """SELECT event_type, min(event_id) AS best_step, any_value(value) AS best_score FROM
    (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) WHERE value = m GROUP BY event_type""")
def _(spark, sf):
    return H.best_step(table(spark, sf, "events"), ["event_type"], "event_id", "value")


@query("j30_running_centre", """WITH RECURSIVE m AS (SELECT event_type, batch, batch_mean, row_number() OVER (PARTITION BY event_type ORDER BY batch) AS i
      FROM (SELECT event_type, (event_id // 100)::BIGINT AS batch, avg(value) AS batch_mean FROM events GROUP BY 1, 2)), r AS (SELECT event_type, batch, batch_mean, i, 0.1::DOUBLE * batch_mean AS centre FROM m WHERE i = 1
      UNION ALL SELECT m.event_type, m.batch, m.batch_mean, m.i, r.centre * 0.9::DOUBLE + m.batch_mean * 0.1::DOUBLE FROM r JOIN m ON m.event_type = r.event_type AND m.i = r.i + 1)
    SELECT event_type, batch, round(batch_mean, 6) AS batch_mean, round(centre, 6) AS centre FROM r""")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("batch", F.floor(F.col("event_id") / 100))
    return rounded(H.running_centre(df, ["event_type"], "batch", "value"), 6, ["batch_mean", "centre"])


@query("k2_running_sum", "SELECT event_type, event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id) - value, 4) AS earlier FROM events")
def _(spark, sf):
    out = O.running(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", {"earlier": "value"})
    return out.select("event_type", "event_id", F.round("earlier", 4).alias("earlier"))


@query("k3_average_rank", """SELECT DISTINCT event_type, value, rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rank
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def _(spark, sf):
    return O.average_ranks(table(spark, sf, "events"), ["event_type"], "value", "rank").drop("_n")


@query("k4_smoothed_meter", """SELECT event_type, event_id, value, list_sort(list(value) OVER w)[(count(*) OVER w + 1) // 2] AS median, round(avg(value) OVER w, 6) AS avg,
    round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id) + 1e-10::DOUBLE, 6) AS global_avg, max(value) OVER w AS max
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    out = H.smoothed_meter(table(spark, sf, "events"), ["event_type"], "event_id", "value", block_rows=500)
    # the nudge keeps exact halves from rounding either way after the last bit
    return rounded(out.withColumn("global_avg", F.col("global_avg") + 1e-10), 6, ["avg", "global_avg"])


@query("k5_early_stop", """WITH b AS (SELECT event_type, event_id AS step, value, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events),
      c AS (SELECT *, prev IS NULL OR value > prev AS is_best FROM b),
      d AS (SELECT *, max(CASE WHEN is_best THEN step END) OVER (PARTITION BY event_type ORDER BY step) AS best, greatest(value, coalesce(prev, value)) AS top FROM c),
      e AS (SELECT *, NOT is_best AND step - best >= least(10000, greatest(50, round_even(best * 0.3::DOUBLE + 10, 0))) AS stops FROM d)
    SELECT event_type, min(step) FILTER (WHERE stops) AS stop_step, coalesce(arg_min(best, step) FILTER (WHERE stops), arg_max(best, step)) AS best_step,
      coalesce(arg_min(top, step) FILTER (WHERE stops), arg_max(top, step)) AS best_score FROM e GROUP BY event_type""")
def _(spark, sf):
    return H.early_stop(table(spark, sf, "events"), ["event_type"], "event_id", "value")


@query("k6_sorted_listing", "SELECT DISTINCT source FROM documents ORDER BY source")
def _(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().orderBy("source")
