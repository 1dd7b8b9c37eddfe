"""Predictions of member ensembles, end to end with fixed linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import ensemble as G, predict as P, steps as S
from .bars import BORDERS, FULL_MEAN, q_sql
from .base import query, table
from .steps import KEY_SQL

COLS = ["l_extendedprice", "l_quantity", "l_tax"]
CONFIGS = [S.PrepConfig("robust", "none"), S.PrepConfig("1_plus_log", "none")]
OPTIONS = S.StepOptions(fingerprint=False, order="rotate")
FEATURES = {"robust": "({c} - a_{c}) / b_{c}", "1_plus_log": "ln(1 + {c})"}
TRAIN = "l_linenumber <= 4"
# rows as they come, with the medians and quartile ranges of the training rows
BASE = f"""m AS (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS a_{c}, (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.3489795003921634::DOUBLE AS b_{c}" for c in COLS)} FROM lineitem WHERE {TRAIN}),
  x AS (SELECT {KEY_SQL}, row_number() OVER () AS line, l_returnflag, l_linenumber, {', '.join(f"{FEATURES[k].format(c=c)} AS {k[0] if k == 'robust' else 'l'}_{c}" for k in FEATURES for c in COLS)} FROM lineitem, m)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])).alias("key"),
        *COLS, "l_linenumber", "l_returnflag")


def feature_sql(member: G.Member) -> list[str]:
    """The member's features in its own order."""
    order = S.feature_order(sorted(COLS), "rotate", member.options.shift, member.options.seed)
    return [f"{'r' if member.config.name == 'robust' else 'l'}_{c}" for c in order]


PLAN_MEMBERS = G.plan_members("classification", 8, 3, CONFIGS, OPTIONS, "shuffle", seed=3)


# every planned member's features over all rows, weighted by their place, and its class order
@query("g3_member_plan", f"WITH {BASE}" + " UNION ALL ".join(
    f"""SELECT {m.member} AS member, '{m.config.name}' AS transform, {m.options.shift} AS shift, '{"".join(map(str, m.permutation))}' AS classes,
      count(*) AS n, round(sum({" + ".join(f"{j + 1} * {c}" for j, c in enumerate(feature_sql(m)))}) / count(*), 6) AS mean FROM x"""
    for m in PLAN_MEMBERS))
def _(spark, sf):
    df = lines(spark, sf)
    fitted = G.fit_ensemble(df.where(TRAIN), "key", COLS, [], PLAN_MEMBERS)
    weighted = F.aggregate(F.transform("features", lambda x, j: x * (j + 1)), F.lit(0.0), lambda s, x: s + x)
    sums = fitted.features(df, "key").groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.avg(weighted).alias("mean"))
    plan = G.members_table(spark, PLAN_MEMBERS).select("member", "transform", "shift", F.array_join("permutation", "").alias("classes"))
    return plan.join(sums, "member").withColumn("mean", F.round("mean", 6))


CLASS_SEED = 5
CLASS_WEIGHTS = [[((7 * j + 3 * c) % 5 - 2) / 4 for c in range(3)] for j in range(3)]
CLASS_MEMBERS = G.plan_members("classification", 4, 3, CONFIGS, OPTIONS, "rotate", seed=CLASS_SEED)


def class_sql() -> str:
    parts = []
    for m in CLASS_MEMBERS:
        f = feature_sql(m)
        logits = [" + ".join(f"{f[j]} * {CLASS_WEIGHTS[j][m.permutation[c]]}::DOUBLE" for j in range(3)) for c in range(3)]
        e = [f"exp(({z}) / 0.9::DOUBLE)" for z in logits]
        parts.append(f"SELECT key, " + ", ".join(f"{v} / ({' + '.join(e)}) AS p{c}" for c, v in enumerate(e)) + " FROM x")
    return f"""WITH {BASE}, s AS ({' UNION ALL '.join(parts)}),
      f AS (SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS c, count(*) / sum(count(*)) OVER () AS f FROM lineitem WHERE {TRAIN} GROUP BY 1),
      w AS (SELECT {', '.join(f"max(f) FILTER (WHERE c = {c}) AS w{c}, max(l_returnflag) FILTER (WHERE c = {c}) AS n{c}" for c in range(3))} FROM f),
      a AS (SELECT key, {', '.join(f"avg(p{c}) AS p{c}" for c in range(3))} FROM s GROUP BY key),
      b AS (SELECT key, n0, n1, n2, {', '.join(f"p{c} * w{c} / (p0 * w0 + p1 * w1 + p2 * w2) AS p{c}" for c in range(3))} FROM a, w),
      t AS (SELECT key, n0, n1, n2, {', '.join(f"CASE WHEN p{c} < 0.001 THEN 0 ELSE p{c} END AS p{c}" for c in range(3))} FROM b)
    SELECT key, CASE WHEN p0 >= p1 AND p0 >= p2 THEN n0 WHEN p1 >= p2 THEN n1 ELSE n2 END AS prediction,
      {', '.join(f"round(p{c} / (p0 + p1 + p2), 7) AS p{c}" for c in range(3))} FROM t"""


@query("predict_classes", class_sql())
def _(spark, sf):
    df = lines(spark, sf)
    fitted = P.fit_classifier(df.where(TRAIN), "key", COLS, "l_returnflag", P.linear(CLASS_WEIGHTS, "key"), n=4, configs=CONFIGS,
                              seed=CLASS_SEED, options=OPTIONS, class_shift="rotate", balance=True)
    return fitted.predict(df).select("key", "prediction", *[F.round(F.get("probs", F.lit(c)), 7).alias(f"p{c}") for c in range(3)])


BAR_SEED = 2
BAR_WEIGHTS = [[(j + 1) * (i - 31.5) / 40 for i in range(64)] for j in range(3)]
BAR_MEMBERS = G.plan_members("regression", 2, None, CONFIGS, OPTIONS, target_transforms=(None,), seed=BAR_SEED)


def bar_sql(average: str) -> str:
    """``average`` combines the members' masses p of one bar."""
    parts = [f"SELECT key, line, {m.member} AS m, i, exp((" + " + ".join(f"{c} * {j + 1}" for j, c in enumerate(feature_sql(m)))
             + ") * (i - 31.5::DOUBLE) / 40 / 0.9::DOUBLE) AS e FROM x, (SELECT unnest(range(64)) AS i)" for m in BAR_MEMBERS]
    return f"""WITH {BASE}, s AS ({' UNION ALL '.join(parts)}), n AS (SELECT key, i, e / sum(e) OVER (PARTITION BY line, m) AS p FROM s),
      a AS (SELECT key, i, {average} AS p FROM n GROUP BY key, i), z AS (SELECT key, i, p / sum(p) OVER (PARTITION BY key) AS p FROM a),
      C AS (SELECT key, i, p, round(-3.2 + 0.1::DOUBLE * i, 1)::DOUBLE AS l, round(-3.1 + 0.1::DOUBLE * i, 1)::DOUBLE AS r, 0.1::DOUBLE AS w,
        sum(p) OVER o AS c1, sum(p) OVER o - p AS c0 FROM z WINDOW o AS (PARTITION BY key ORDER BY i)),
      y AS (SELECT avg(l_linenumber) AS m, stddev_pop(l_linenumber) AS d FROM lineitem WHERE {TRAIN})
    SELECT key, round(any_value(m) + any_value(d) * sum(p * ({FULL_MEAN})), 5) AS mean, round(any_value(m) + any_value(d) * {q_sql(0.5)}, 5) AS median,
      round(any_value(m) + any_value(d) * {q_sql(0.25)}, 5) AS q_0_25 FROM C, y GROUP BY key"""


def predicted(spark, sf, before_softmax):
    df = lines(spark, sf)
    fitted = P.fit_regressor(df.where(TRAIN), "key", COLS, "l_linenumber", P.linear(BAR_WEIGHTS, "key"), BORDERS, n=2, configs=CONFIGS,
                             seed=BAR_SEED, options=OPTIONS, target_transforms=(None,), before_softmax=before_softmax)
    found = fitted.predict(df, ["mean", "median", "quantiles"], [0.25])
    return found.withColumns({c: F.round(c, 5) for c in ("mean", "median", "q_0_25")})


@query("predict_distribution", bar_sql("avg(p)"))
def _(spark, sf):
    return predicted(spark, sf, False)


@query("predict_distribution_of_mean_logits", bar_sql("exp(avg(ln(greatest(p, 1e-300))))"))
def _(spark, sf):
    return predicted(spark, sf, True)
