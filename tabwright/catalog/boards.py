"""J4, J6, J23-J28: profiles, checks and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards as B, encode as E
from .base import query, table
from .clean import DOC_LABELS, doc_labels
from .metrics import R, regression, rounded

PROFILED = ("doc_id", "lang", "source", "n_chars", "quality", "toxic")


@query("j4_column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique FROM {DOC_LABELS}" for c in PROFILED))
def _(spark, sf):
    return B.column_profile(doc_labels(spark, sf))


@query("j4_value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS c, {c}::VARCHAR AS text, count(*) AS n FROM {DOC_LABELS} GROUP BY {c}" for c in ("lang", "source", "quality")))
def _(spark, sf):
    return E.value_counts(doc_labels(spark, sf), ["lang", "source", "quality"]).select("c", "text", "n")


@query("j6_input_checks", """WITH s AS (SELECT count(*) AS n, count(DISTINCT l_linenumber) AS k, count(*) FILTER (WHERE l_linenumber IS NULL) AS bad FROM lineitem)
    SELECT 'min_rows' AS "check", n AS value, 2::BIGINT AS "limit", CASE WHEN n < 2 THEN 'error' ELSE 'ok' END AS status FROM s
    UNION ALL SELECT 'min_features', 3, 1, 'ok' FROM s
    UNION ALL SELECT 'finite_target', bad, 0, CASE WHEN bad > 0 THEN 'error' ELSE 'ok' END FROM s
    UNION ALL SELECT 'max_rows', n, 10000, CASE WHEN n > 10000 THEN 'warning' ELSE 'ok' END FROM s
    UNION ALL SELECT 'max_features', 3, 500, 'ok' FROM s
    UNION ALL SELECT 'max_classes', k, 5, CASE WHEN k > 5 THEN 'error' ELSE 'ok' END FROM s""")
def _(spark, sf):
    return B.input_checks(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_linenumber", max_classes=5)


@query("j23_grouped_scores", f"""WITH {R}, f AS (SELECT flag, status, -avg(abs(y_true - y_pred)) AS s FROM R GROUP BY 1, 2), g AS (SELECT flag, avg(s) AS s FROM f GROUP BY 1)
    SELECT 'group' AS level, flag AS "group", 'mean_absolute_error' AS metric, round(s, 6) AS score FROM g
    UNION ALL SELECT 'overall', 'all', 'mean_absolute_error', round(avg(s), 6) FROM g""")
def _(spark, sf):
    return rounded(B.grouped_scores(regression(spark, sf), ["mae"], "flag", ["status"]), 6, ["score"])


RESULTS_SQL = """V AS (SELECT l_returnflag AS dataset, l_linenumber AS run, m AS method, -avg(abs(l_extendedprice - l_quantity * CASE m WHEN 'a' THEN 2000 WHEN 'b' THEN 2100 ELSE 2200 END)) / 1000 AS score
    FROM lineitem, (VALUES ('a'), ('b'), ('c')) s(m) GROUP BY 1, 2, 3)"""


def results(spark, sf):
    rate = F.when(F.col("method") == "a", 2000).when(F.col("method") == "b", 2100).otherwise(2200)
    df = table(spark, sf, "lineitem").withColumn("method", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    return df.groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("run"), "method").agg(
        (-F.avg(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * rate)) / 1000).alias("score"))


@query("j24_metric_matrix", f"WITH {RESULTS_SQL} SELECT dataset, " + ", ".join(
    f"round(avg(score) FILTER (WHERE method = '{m}'), 6) AS {m}_mean, round(stddev_samp(score) FILTER (WHERE method = '{m}'), 6) AS {m}_std" for m in "abc")
       + " FROM V GROUP BY dataset")
def _(spark, sf):
    out = B.metric_matrix(results(spark, sf), ["a", "b", "c"])
    return rounded(out, 6, [c for c in out.columns if c != "dataset"])


@query("j25_ranks_and_wins", f"""WITH {RESULTS_SQL}, k AS (SELECT dataset || run AS d, method, round(score, 3) AS s FROM V),
      r AS (SELECT method, rank() OVER (PARTITION BY d ORDER BY s DESC) + (count(*) OVER (PARTITION BY d, s) - 1) / 2 AS r FROM k)
    SELECT method, round(avg(r), 8) AS mean_rank, sum((r = 1)::INTEGER)::BIGINT AS wins FROM r GROUP BY method""")
def _(spark, sf):
    per_run = results(spark, sf).withColumn("dataset", F.concat("dataset", F.col("run").cast("string")))
    return rounded(B.ranks_and_wins(per_run), 8, ["mean_rank"])


RUNS_SQL = """U AS (SELECT (1 + user_id % 4)::INTEGER AS a, (1 + user_id % 3)::INTEGER AS b, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS score FROM events)"""


def runs(spark, sf):
    return table(spark, sf, "events").select((1 + F.col("user_id") % 4).cast("int").alias("a"), (1 + F.col("user_id") % 3).cast("int").alias("b"),
                                             "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("score"))


@query("j26_seed_summary", f"WITH {RUNS_SQL} SELECT event_type, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(score) AS n_runs FROM U GROUP BY 1")
def _(spark, sf):
    return rounded(B.seed_summary(runs(spark, sf), ["event_type"]), 6, ["mean", "std"])


GRID_SQL = f"""{RUNS_SQL}, s AS (SELECT a, b, avg(score) AS mean, stddev_pop(score) AS std FROM U GROUP BY 1, 2),
  g AS (SELECT x.a, y.b, x.a >= y.b AS valid, CASE WHEN x.a >= y.b THEN mean ELSE 0 END AS mean, CASE WHEN x.a >= y.b THEN std ELSE 0 END AS std
    FROM (SELECT unnest([1, 2, 3, 4])::INTEGER AS a) x CROSS JOIN (SELECT unnest([1, 2, 3])::INTEGER AS b) y LEFT JOIN s ON s.a = x.a AND s.b = y.b)"""


@query("j27_grid_table", f"""WITH {GRID_SQL} SELECT a, b, valid, round(mean, 6) AS mean, round(std, 6) AS std,
    row_number() OVER (ORDER BY mean DESC NULLS LAST, a, b) = 1 AS best FROM g""")
def _(spark, sf):
    return rounded(B.grid_table(runs(spark, sf), [1, 2, 3, 4], [1, 2, 3]), 6, ["mean", "std"])


@query("j28_axis_mean", "SELECT l_quantity, round(avg(m), 8) AS mean FROM (SELECT l_quantity, l_linenumber, avg(l_tax) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    grid = table(spark, sf, "lineitem").groupBy("l_quantity", "l_linenumber").agg(F.avg("l_tax").alias("mean"))
    return rounded(B.axis_mean(grid, "l_quantity"), 8, ["mean"])
