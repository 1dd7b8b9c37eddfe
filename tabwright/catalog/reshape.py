"""E: distribution reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import normal_cdf_sql, probit_sql
from ..operators import reshape as R
from .base import query, table
from .clean import INJECTED, injected

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
NUM = ["l_quantity", "l_extendedprice", "l_tax"]
K = ", ".join(KEYS)


def lines(spark, sf, spread=False):
    return table(spark, sf, "lineitem", spread).select(*KEYS, *NUM)


def out(df, cols=tuple(NUM), digits=6):
    return df.select(*KEYS, *[F.round(c, digits).alias(c) for c in cols])


def scaled_sql(center, spread, cols=NUM, digits=6):
    return f"SELECT {K}, " + ", ".join(
        f"round(({c} - {center.format(c=c)}) / {spread.format(c=c)}, {digits}) AS {c}" for c in cols) + " FROM lineitem, s"


def agg_sql(parts):
    return "WITH s AS (SELECT " + ", ".join(p.format(c=c) for c in NUM for p in parts) + " FROM lineitem) "


@query("e1_standard_scaler", agg_sql(["avg({c}) AS m_{c}", "stddev_pop({c}) AS d_{c}"]) + scaled_sql("m_{c}", "d_{c}"))
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_standard(df, NUM).transform(df))


@query("e1_standard_scaler_unclean", f"""WITH f AS (SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS x FROM {INJECTED}),
      i AS (SELECT event_id, coalesce(x, (SELECT avg(x) FROM f)) AS x FROM f)
    SELECT event_id, round((x - (SELECT avg(x) FROM i)) / (SELECT stddev_pop(x) FROM i), 6) AS x FROM i""")
def _(spark, sf):
    df = injected(spark, sf).select("event_id", "x")
    return R.fit_standard(df, ["x"]).transform(df).withColumn("x", F.round(F.col("x") + 0.0, 6))


@query("e2_deviation_scaler", agg_sql(["stddev_pop({c}) AS d_{c}"]) + scaled_sql("0", "d_{c}"))
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_standard(df, NUM, center=False).transform(df))


@query("e3_train_normalise", "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) + 1e-20::DOUBLE AS d_{c}" for c in NUM)
       + f" FROM lineitem WHERE l_linenumber <= 4) SELECT {K}, " + ", ".join(
    f"round(least(greatest(({c} - m_{c}) / d_{c}, -100), 100), 6) AS {c}" for c in NUM) + " FROM lineitem, s")
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_normalise(df, NUM, F.col("l_linenumber") <= 4).transform(df))


@query("e4_minmax", "WITH s AS (SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in NUM)
       + f" FROM lineitem WHERE l_linenumber <= 2) SELECT {K}, " + ", ".join(
    f"round(least(greatest(0.1::DOUBLE + 0.9::DOUBLE * ({c} - a_{c}) / (b_{c} - a_{c}), 0.1), 1), 6) AS {c}" for c in NUM) + " FROM lineitem, s")
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_minmax(df.where("l_linenumber <= 2"), NUM).transform(df))


@query("e5_robust_scaler", agg_sql(["quantile_cont({c}, 0.5) AS m_{c}", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.3489795003921634::DOUBLE AS d_{c}"])
       + scaled_sql("m_{c}", "d_{c}"))
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_robust(df, NUM).transform(df))


M = 101
LEVELS = [i / (M - 1) for i in range(M)]


def quantile_sql(cols, normal=False):
    """Tied knots collapse to their first and last level; a value on a knot takes the middle."""
    parts, joins = [], []
    for c in cols:
        parts.append(f"""q_{c} AS (SELECT v, min(i) / {M - 1}.0::DOUBLE AS lo, max(i) / {M - 1}.0::DOUBLE AS hi FROM (SELECT i - 1 AS i, round(q[i], 9) AS v
            FROM (SELECT quantile_cont({c}, {LEVELS}) AS q FROM lineitem), range(1, {M + 1}) t(i)) GROUP BY v),
          k_{c} AS (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS v2, lead(lo) OVER (ORDER BY v) AS lo2 FROM q_{c}),
          r_{c} AS (SELECT x, CASE WHEN x <= (SELECT min(v) FROM q_{c}) THEN 0 WHEN x >= (SELECT max(v) FROM q_{c}) THEN 1
              WHEN x = v THEN (lo + hi) / 2 ELSE hi + (lo2 - hi) * (x - v) / (v2 - v) END AS y
            FROM (SELECT DISTINCT {c} AS x FROM lineitem) d ASOF LEFT JOIN k_{c} ON d.x >= k_{c}.v)""")
        joins.append(f"JOIN r_{c} ON r_{c}.x = {c}")

    def val(c):
        y = f"r_{c}.y"
        return f"CASE WHEN {y} <= 1e-7 THEN -5.19933758270342 WHEN {y} >= 1 - 1e-7 THEN 5.19933758270342 ELSE {probit_sql(y)} END" if normal else y
    return "WITH " + ", ".join(parts) + f" SELECT {K}, " + ", ".join(
        f"round(({val(c)})::DOUBLE, 5) AS {c}" for c in cols) + " FROM lineitem " + " ".join(joins)


@query("e6_quantile_uniform", quantile_sql(["l_quantity", "l_tax"]))
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_quantile(df, ["l_quantity", "l_tax"], M).transform(df), ["l_quantity", "l_tax"], 5)


@query("e6_quantile_uniform_price", quantile_sql(["l_extendedprice"]))
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_quantile(df, ["l_extendedprice"], M).transform(df), ["l_extendedprice"], 5)


@query("e7_quantile_normal", quantile_sql(["l_quantity"], normal=True))
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_quantile(df, ["l_quantity"], M, "normal").transform(df), ["l_quantity"], 5)


def ranked_quantile_sql(cols, knots):
    """The transform with any number of knots: knot i of m lies at position i (n - 1) / (m - 1) of the n sorted values."""
    parts, joins = [], []
    for c in cols:
        parts.append(f"""s_{c} AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS r FROM lineitem),
          m_{c} AS (SELECT n - 1 AS l, greatest({knots}, 2) - 1 AS k FROM (SELECT count(*) AS n FROM lineitem)),
          p_{c} AS (SELECT i, i * l // k AS a, (i * l + k - 1) // k AS b, (i * l % k)::DOUBLE / k AS part, k FROM m_{c}, range((SELECT k + 1 FROM m_{c})) t(i)),
          q_{c} AS (SELECT v, min(i)::DOUBLE / any_value(k) AS lo, max(i)::DOUBLE / any_value(k) AS hi FROM (
            SELECT i, k, a.x + (b.x - a.x) * part AS v FROM p_{c} JOIN s_{c} a ON a.r = p_{c}.a JOIN s_{c} b ON b.r = p_{c}.b) GROUP BY v),
          k_{c} AS (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS v2, lead(lo) OVER (ORDER BY v) AS lo2 FROM q_{c}),
          r_{c} AS (SELECT x, CASE WHEN x <= (SELECT min(v) FROM q_{c}) THEN 0 WHEN x >= (SELECT max(v) FROM q_{c}) THEN 1
              WHEN x = v THEN (lo + hi) / 2 ELSE hi + (lo2 - hi) * (x - v) / (v2 - v) END AS y
            FROM (SELECT DISTINCT {c} AS x FROM lineitem) d ASOF LEFT JOIN k_{c} ON d.x >= k_{c}.v)""")
        joins.append(f"JOIN r_{c} ON r_{c}.x = {c}")
    return "WITH " + ", ".join(parts) + f" SELECT {K}, " + ", ".join(
        f"round(r_{c}.y::DOUBLE, 5) AS {c}" for c in cols) + " FROM lineitem " + " ".join(joins)


@query("e6_quantile_uni", ranked_quantile_sql(["l_extendedprice", "l_quantity"], "n // 5"))
def _(spark, sf):
    df = lines(spark, sf)
    cols = ["l_extendedprice", "l_quantity"]
    return out(R.fit_named(df, cols, "quantile_uni").transform(df), cols, 5)


@query("e6_quantile_uni_fine", ranked_quantile_sql(["l_extendedprice", "l_tax"], "n"))
def _(spark, sf):
    df = lines(spark, sf)
    cols = ["l_extendedprice", "l_tax"]
    return out(R.fit_named(df, cols, "quantile_uni_fine").transform(df), cols, 5)


def psi_sql(x, lam, method):
    if method == "box-cox":
        return f"CASE WHEN abs({lam}) < 1e-9 THEN ln({x}) ELSE (pow({x}, {lam}) - 1) / {lam} END"
    return f"""CASE WHEN {x} >= 0 THEN CASE WHEN abs({lam}) < 1e-9 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END
      ELSE CASE WHEN abs({lam} - 2) < 1e-9 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END END"""


def power_sql(source, method):
    """Grid search as text: coarse exponents, then fine ones around the best, then standardise."""
    jac = "ln(x)" if method == "box-cox" else "sign(x) * ln(1 + abs(x))"
    ll = f"-count(*) / 2 * ln(var_pop({psi_sql('x', 'lam', method)})) + (lam - 1) * sum({jac})"
    return f"""x AS ({source}),
      c AS (SELECT lam FROM (SELECT lam, round({ll}, 6) AS ll FROM x, (SELECT round(-6 + 0.1::DOUBLE * unnest(range(121)), 2) AS lam) GROUP BY lam) ORDER BY ll DESC, lam LIMIT 1),
      f AS (SELECT lam FROM (SELECT lam, round({ll}, 6) AS ll FROM x, (SELECT round(lam - 0.1 + 0.01::DOUBLE * unnest(range(21)), 2) AS lam FROM c) GROUP BY lam) ORDER BY ll DESC, lam LIMIT 1),
      p AS (SELECT x.* EXCLUDE (x), {psi_sql('x', 'lam', method)} AS y FROM x, f)"""


@query("e8_yeo_johnson", f"WITH {power_sql(f'SELECT {K}, l_quantity - 20 AS x FROM lineitem', 'yeo-johnson')} SELECT {K}, round((y - (SELECT avg(y) FROM p)) / (SELECT stddev_pop(y) FROM p), 5) AS x FROM p")
def _(spark, sf):
    df = lines(spark, sf, spread=True).withColumn("x", F.col("l_quantity") - 20)
    return out(R.fit_power(df, ["x"]).transform(df), ["x"], 5)


BOX = f"SELECT {K}, least(greatest(0.1::DOUBLE + 0.9::DOUBLE * (l_extendedprice - a) / (b - a), 0.1), 1) AS x FROM lineitem, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)"


@query("e9_box_cox", f"WITH {power_sql(BOX, 'box-cox')} SELECT {K}, round((y - (SELECT avg(y) FROM p)) / (SELECT stddev_pop(y) FROM p), 5) AS l_extendedprice FROM p")
def _(spark, sf):
    df = lines(spark, sf, spread=True)
    return out(R.fit_box_cox(df, ["l_extendedprice"]).transform(df), ["l_extendedprice"], 5)


@query("e10_safe_power", f"""WITH {power_sql(f'SELECT {K}, l_extendedprice / 1000 AS x, l_extendedprice / 1000 AS raw FROM lineitem', 'yeo-johnson')},
      m AS (SELECT avg(y) AS m, stddev_pop(y) AS d, max(y) AS top FROM p)
    SELECT {K}, round(CASE WHEN (top - m) / d > 100 THEN raw ELSE (y - m) / d END, 5) AS x, 3.5::DOUBLE AS same
    FROM p, m""")
def _(spark, sf):
    df = lines(spark, sf, spread=True).withColumns({"x": F.col("l_extendedprice") / 1000, "same": F.lit(3.5)})
    return out(R.fit_power(df, ["x", "same"], safe=True).transform(df), ["x", "same"], 5)


def kernel_sql(cols, alpha):
    """Exact kernel sums over the distinct values and their counts, rescaled to 0..1."""
    parts, joins = [], []
    for c in cols:
        z = f"((a.x - b.x) / (s.d * {alpha}::DOUBLE))"
        parts.append(f"""v_{c} AS (SELECT {c} AS x, count(*) AS n FROM lineitem GROUP BY 1),
          s_{c} AS (SELECT stddev_samp({c}) AS d FROM lineitem),
          f_{c} AS (SELECT a.x, sum(b.n * {normal_cdf_sql(z)}) / sum(b.n) AS f FROM v_{c} a, v_{c} b, s_{c} s GROUP BY a.x),
          r_{c} AS (SELECT x, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS y FROM f_{c})""")
        joins.append(f"JOIN r_{c} ON r_{c}.x = {c}")
    return "WITH " + ", ".join(parts) + f" SELECT {K}, " + ", ".join(
        f"round(r_{c}.y::DOUBLE, 6) AS {c}" for c in cols) + " FROM lineitem " + " ".join(joins)


@query("e11_kdi_values", kernel_sql(["l_quantity", "l_tax"], 0.5))
def _(spark, sf):
    df = lines(spark, sf)
    cols = ["l_quantity", "l_tax"]
    return out(R.fit_kdi(df, cols, 0.5, "uniform").transform(df), cols)


@query("e11_kdi")
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_kdi(df, NUM, 0.5, "uniform").transform(df))


@query("e11_kdi_normal")
def _(spark, sf):
    df = lines(spark, sf)
    return out(R.fit_named(df, NUM, "kdi_alpha_2.0").transform(df))


@query("e12_norm_and_kdi")
def _(spark, sf):
    df = lines(spark, sf)
    fitted = R.fit_norm_and_kdi(df, ["l_quantity", "l_tax"])
    return out(fitted.transform(df), fitted.names())


@query("e14_svd_append")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    cols = [*NUM, "l_discount"]
    fitted = R.fit_svd(df, cols)
    return out(fitted.transform(df), [*cols, *fitted.names()])


@query("e14_gram_matrix", "SELECT a AS i, b AS j, round(sum(x[a + 1] * x[b + 1]), 2) AS g FROM (SELECT [l_quantity, l_discount * 100, l_tax * 100] AS x FROM lineitem), (SELECT unnest(range(3))::INTEGER AS a), (SELECT unnest(range(3))::INTEGER AS b) GROUP BY 1, 2")
def _(spark, sf):
    g = R.gram(table(spark, sf, "lineitem"), F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100), 3)
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 2)) for i in range(3) for j in range(3)], "i int, j int, g double")


@query("e15_embedding_pca")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    fitted = R.fit_pca(df, "embedding", 8)
    return fitted.transform(df).select("vec_id", F.posexplode("pca").alias("component", "value"))


@query("e16_soft_clip", """WITH a AS (SELECT event_id, CASE WHEN event_id % 500 = 0 THEN value * 1000 WHEN event_id % 499 = 0 THEN -value * 1000 ELSE value END AS x, event_id % 4 <> 0 AS train FROM events),
      s AS (SELECT avg(x) - 3 * stddev_samp(x) AS lo, avg(x) + 3 * stddev_samp(x) AS hi FROM a WHERE train),
      t AS (SELECT avg(x) - 3 * stddev_samp(x) AS lo, avg(x) + 3 * stddev_samp(x) AS hi FROM a, s WHERE train AND x BETWEEN s.lo AND s.hi),
      u AS (SELECT event_id, hi, greatest(lo - ln(1 + abs(x)), x) AS x FROM a, t)
    SELECT event_id, round(least(hi + ln(1 + abs(x)), x), 5) AS x FROM u""")
def _(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    df = table(spark, sf, "events").select("event_id", F.when(e % 500 == 0, v * 1000).when(e % 499 == 0, -v * 1000).otherwise(v).alias("x"))
    return R.fit_soft_clip(df, ["x"], 3.0, e % 4 != 0).transform(df).withColumn("x", F.round("x", 5))


@query("e17_target_scale", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / (stddev_pop(o_totalprice) OVER () + 1e-20::DOUBLE), 6) AS z, round(o_totalprice, 4) AS back FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    fitted = R.fit_target_scale(df, "o_totalprice")
    scaled = fitted.transform(df)
    back = fitted.inverse(scaled)
    return back.select("o_orderkey", F.round("o_totalprice_z", 6).alias("z"), F.round("o_totalprice", 4).alias("back"))


@query("e18_quantile_bins", """WITH e AS (SELECT i, CASE i WHEN 0 THEN 0 ELSE q[i + 1] END AS edge FROM (SELECT quantile_cont(p_retailprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM part), range(11) t(i))
    SELECT p_partkey, CASE WHEN p_retailprice > (SELECT min(edge) FROM e) AND p_retailprice <= (SELECT max(edge) FROM e)
      THEN (SELECT count(*) FROM e WHERE round(edge, 6) < p_retailprice) - 1 END::INTEGER AS p_retailprice_bin FROM part""")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    fitted = R.fit_quantile_bins(df, "p_retailprice")
    fitted = R.Bins(fitted.column, [round(e, 6) for e in fitted.edges], fitted.out)
    return fitted.transform(df).drop("p_retailprice")


@query("e19_bucket_borders", """WITH d AS (SELECT o_totalprice AS y, row_number() OVER (ORDER BY md5('0|' || o_orderkey)) AS r, count(*) OVER () AS n FROM orders),
      o AS (SELECT y, row_number() OVER (ORDER BY y) AS k, (n - n % 64) / 64 AS s FROM d WHERE r <= n - n % 64),
      b AS (SELECT k // s AS i, avg(y) AS border FROM (SELECT y, k::BIGINT AS k, s::BIGINT AS s FROM o WHERE k % s::BIGINT = 0 UNION ALL SELECT y, k::BIGINT - 1, s::BIGINT FROM o WHERE (k - 1) % s::BIGINT = 0 AND k > 1) GROUP BY 1)
    SELECT i::INTEGER AS i, round(CASE WHEN i = 64 THEN (SELECT max(y) FROM o) ELSE border END, 4) AS border FROM b
    UNION ALL SELECT 0, round(min(y), 4) FROM o""")
def _(spark, sf):
    borders = R.bucket_borders(table(spark, sf, "orders"), "o_totalprice", 64, key="o_orderkey")
    return spark.createDataFrame([(i, round(b, 4)) for i, b in enumerate(borders)], "i int, border double")


@query("e19_equal_width_borders", """SELECT i::INTEGER AS i, round(a + i * (b - a) / 50, 4) AS border FROM (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), range(51) t(i)""")
def _(spark, sf):
    borders = R.bucket_borders(table(spark, sf, "orders"), "o_totalprice", 50, equal_mass=False)
    return spark.createDataFrame([(i, round(b, 4)) for i, b in enumerate(borders)], "i int, border double")


@query("e20_median_skew", "SELECT round(3 * (avg(value) - quantile_cont(value, 0.5)) / stddev_pop(value), 6) AS skew FROM events")
def _(spark, sf):
    skew = R.median_skew(table(spark, sf, "events"), ["value"])["value"]
    return spark.createDataFrame([(round(skew, 6),)], "skew double")


SHAPES = {"linenumber": "l_linenumber", "price": "l_extendedprice", "quartic": "pow(l_quantity / 50, 6)",
          "shifted": "pow(l_quantity / 10, 6) + 1", "centred": "pow(l_quantity / 10, 6) - 5",
          "bell": "l_quantity + l_extendedprice / 2000 + l_tax * 300 + l_discount * 300"}


def shaped(spark, sf):
    return table(spark, sf, "lineitem", spread=True).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row"),
                                               *[F.expr(f"cast({x} as double)").alias(c) for c, x in SHAPES.items()])


# the normality statistic is the squared correlation with normal scores (a + 0.375 plotting positions)
@query("e21_column_shape", f"""WITH d AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS row, {', '.join(f'({x})::DOUBLE AS {c}' for c, x in SHAPES.items())} FROM lineitem),
      l AS (UNPIVOT d ON {', '.join(SHAPES)} INTO NAME c VALUE x),
      s AS (SELECT c, count(DISTINCT x) AS u, 3 * (avg(x) - quantile_cont(x, 0.5)) / stddev_pop(x) AS skew, min(x) AS a, max(x) AS b FROM l GROUP BY c),
      t AS (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY x) AS i, count(*) OVER (PARTITION BY c) AS n FROM l),
      w AS (SELECT c, pow(corr(x, {probit_sql('((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE))')}), 2) AS w FROM t GROUP BY c)
    SELECT c AS "column", CASE WHEN u < 10 THEN 'ordinal' WHEN skew > 1.1 AND a >= 0 AND b <= 1 THEN 'skewed_pos_1_0' WHEN skew > 1.1 AND a > 0 THEN 'skewed_pos'
      WHEN skew > 1.1 THEN 'skewed' WHEN w > 0.95 THEN 'normal' ELSE 'other' END AS shape FROM s JOIN w USING (c)""")
def _(spark, sf):
    shapes = R.column_shape(shaped(spark, sf), list(SHAPES), "row")
    return spark.createDataFrame(list(shapes.items()), "column string, shape string")


@query("e22_adaptive")
def _(spark, sf):
    df = shaped(spark, sf)
    return R.fit_adaptive(df, list(SHAPES), "row").transform(df).select("row", *[F.round(c, 6).alias(c) for c in SHAPES])
