"""J: metrics of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_unit, seeded_hash
from ..functions.vectors import softmax
from ..operators import metrics as M
from .base import CLASS_SCORES, class_scores, query, table

# class predictions: softmax of ten times the class scores of every embedding
P = CLASS_SCORES + """, P AS (SELECT key, y_true, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM (SELECT vec_id AS key, label AS y_true,
    list_transform(v, lambda x: exp(10 * x)) AS e FROM CV)),
  Q AS (SELECT key, y_true, probs, (list_position(probs, list_max(probs)) - 1)::INTEGER AS y_pred FROM P)"""
# scored binary rows: quality mixed with a hashed uniform, rounded so that scores tie
B = """B AS (SELECT doc_id, quality AS y_true, toxic, round(0.25::DOUBLE * quality + 0.7::DOUBLE * (('0x' || substr(md5('1|' || doc_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE), 2) AS score FROM labels)"""
R = """R AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS y_true, l_quantity * 2100 AS y_pred, l_tax FROM lineitem)"""


def predictions(spark, sf):
    scaled = F.transform("scores", lambda x: x * 10)
    return class_scores(spark, sf).select(F.col("vec_id").alias("key"), F.col("label").alias("y_true"), softmax(scaled).alias("probs"))


def scored(spark, sf):
    u = hash_unit(seeded_hash(1, "doc_id"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y_true"), "toxic",
                                             F.round(F.col("quality") * 0.25 + u * 0.7, 2).alias("score"))


def regression(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 2100).alias("y_pred"), "l_tax")


def rounded(df, digits=8, cols=("score", "error")):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def metric_rows(parts, source):
    """SQL rows (metric, score, error) from name -> (expression, sign, optimum)."""
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round({s} * ({x}), 8)::DOUBLE AS score, round({s} * {o} - {s} * ({x}), 8)::DOUBLE AS error FROM {source}"
        for m, (x, s, o) in parts.items())


REG = {
    "r2": ("1 - sum(pow(y_true - y_pred, 2)) / (count(*) * var_pop(y_true))", 1, 1),
    "mean_squared_error": ("avg(pow(y_true - y_pred, 2)) / 1e6", -1, 0),
    "root_mean_squared_error": ("sqrt(avg(pow(y_true - y_pred, 2)))", -1, 0),
    "mean_absolute_error": ("avg(abs(y_true - y_pred))", -1, 0),
    "mean_absolute_percentage_error": ("avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16))", -1, 0),
    "symmetric_mean_absolute_percentage_error": ("avg(abs(y_true - y_pred) / greatest(abs(y_true) + abs(y_pred), 2.220446049250313e-16))", -1, 0),
}


@query("j1_regression_errors", f"WITH {R}, t AS ({metric_rows(REG, 'R')}) SELECT metric, round(score, 6) AS score, round(error, 6) AS error FROM t")
def _(spark, sf):
    out = M.evaluate(regression(spark, sf), list(REG))
    scale = F.when(F.col("metric") == "mean_squared_error", 1e6).otherwise(1.0)
    return rounded(out.withColumns({c: F.col(c) / scale for c in ("score", "error")}), 6)


@query("j2_median_absolute_error", f"""WITH {R} SELECT flag, 'median_absolute_error' AS metric, round(-quantile_cont(abs(y_true - y_pred), 0.5), 6) AS score,
    round(quantile_cont(abs(y_true - y_pred), 0.5), 6) AS error FROM R GROUP BY flag""")
def _(spark, sf):
    return rounded(M.evaluate(regression(spark, sf), ["medae"], by=["flag"]), 6)


@query("j3_correlations", f"""WITH {R}, k AS (SELECT rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2 AS a,
      rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2 AS b FROM R)
    SELECT 'pearsonr' AS metric, round(corr(y_true, y_pred), 6) AS score, round(1 - corr(y_true, y_pred), 6) AS error FROM R
    UNION ALL SELECT 'spearmanr', round(corr(a, b), 6), round(1 - corr(a, b), 6) FROM k""")
def _(spark, sf):
    return rounded(M.evaluate(regression(spark, sf), ["pearsonr", "spearmanr"]), 6)


@query("j5_confusion_matrix", f"""WITH {P}, c AS (SELECT y_true AS t, y_pred AS p, count(*) AS n FROM Q WHERE y_true BETWEEN 1 AND 8 AND y_pred BETWEEN 1 AND 8 GROUP BY 1, 2),
      g AS (SELECT a AS t, b AS p, coalesce(n, 0) AS n FROM range(1, 9) x(a), range(1, 9) y(b) LEFT JOIN c ON c.t = a AND c.p = b)
    SELECT t, p, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY t), 0), 0), 8)::DOUBLE AS value FROM g""".replace(
        "FROM range(1, 9) x(a), range(1, 9) y(b) LEFT JOIN", "FROM (SELECT a, b FROM range(1, 9) x(a), range(1, 9) y(b)) LEFT JOIN"))
def _(spark, sf):
    df = predictions(spark, sf).withColumn("y_pred", F.expr("cast(array_position(probs, array_max(probs)) - 1 as int)"))
    return rounded(M.confusion_matrix(df, range(1, 9), "true"), 8, ["value"])


CLASS_CTE = f"""{P}, c AS (SELECT y_true AS t, y_pred AS p, count(*)::DOUBLE AS n FROM Q GROUP BY 1, 2),
  k AS (SELECT class, sum(t) AS t, sum(m) AS m, sum(tp) AS tp FROM (SELECT t AS class, n AS t, 0 AS m, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM c
    UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY class),
  s AS (SELECT *, coalesce(tp / nullif(m, 0), 0) AS prec, coalesce(tp / nullif(t, 0), 0) AS rec, 2 * tp / (t + m) AS f FROM k)"""
CLASS = {
    "accuracy": ("sum(tp) / sum(t)", 1, 1),
    "balanced_accuracy": ("avg(greatest(tp, 1e-15::DOUBLE) / greatest(t, 1e-15::DOUBLE))", 1, 1),
    "mcc": ("(sum(tp) * sum(t) - sum(t * m)) / sqrt((pow(sum(t), 2) - sum(m * m)) * (pow(sum(t), 2) - sum(t * t)))", 1, 1),
    "quadratic_kappa": ("1 - (SELECT sum(pow(t - p, 2) * n) FROM c) / (SELECT sum(pow(a.class - b.class, 2) * a.t * b.m) / (SELECT sum(n) FROM c) FROM k a, k b) + 0 * sum(t)", 1, 1),
    "precision_macro": ("avg(prec)", 1, 1), "recall_macro": ("avg(rec)", 1, 1), "f1_macro": ("avg(f)", 1, 1),
    "precision_micro": ("sum(tp) / sum(m)", 1, 1), "recall_micro": ("sum(tp) / sum(t)", 1, 1), "f1_micro": ("2 * sum(tp) / (sum(t) + sum(m))", 1, 1),
    "precision_weighted": ("sum(prec * t) / sum(t)", 1, 1), "recall_weighted": ("sum(rec * t) / sum(t)", 1, 1), "f1_weighted": ("sum(f * t) / sum(t)", 1, 1),
}


def register_class_metrics():
    groups = {"j7_accuracy": ["accuracy"], "j8_balanced_accuracy": ["balanced_accuracy"],
              "j9_precision_recall_f1": [m for m in CLASS if m.split("_")[0] in ("precision", "recall", "f1")],
              "j10_matthews": ["mcc"], "j11_quadratic_kappa": ["quadratic_kappa"]}
    for name, metrics in groups.items():
        @query(name, f"WITH {CLASS_CTE} " + metric_rows({m: CLASS[m] for m in metrics}, "s"))
        def _(spark, sf, metrics=metrics):
            return rounded(M.evaluate(predictions(spark, sf), metrics))


register_class_metrics()


@query("j9_binary_precision_recall_f1", f"""WITH {B}, h AS (SELECT y_true, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM B),
      c AS (SELECT sum(y_true * p)::DOUBLE AS tp, sum(p)::DOUBLE AS m, sum(y_true)::DOUBLE AS t FROM h)
    """ + metric_rows({"precision": ("tp / m", 1, 1), "recall": ("tp / t", 1, 1), "f1": ("2 * tp / (t + m)", 1, 1)}, "c"))
def _(spark, sf):
    return rounded(M.evaluate(scored(spark, sf), ["precision", "recall", "f1"], problem=M.BINARY))


@query("j12_log_loss", f"""WITH {P} """ + metric_rows({"log_loss": ("avg(-ln(least(greatest(probs[y_true + 1], 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)))", -1, 0)}, "P"))
def _(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), ["nll"]))


BIN_LOSS = "avg(-(y_true * ln(least(greatest(score, {e}), 1 - {e})) + (1 - y_true) * ln(1 - least(greatest(score, {e}), 1 - {e}))))"


@query("j12_log_loss_binary", f"WITH {B} " + metric_rows({"log_loss": (BIN_LOSS.format(e="1e-15::DOUBLE"), -1, 0)}, "B"))
def _(spark, sf):
    return rounded(M.evaluate(scored(spark, sf), ["log_loss"], problem=M.BINARY))


@query("j13_probabilistic_accuracy", f"""WITH {P}, l AS (SELECT avg(-ln(least(greatest(probs[y_true + 1], 3e-8::DOUBLE), 1 - 3e-8::DOUBLE))) AS l FROM P),
      z AS (SELECT -sum(f * ln(f)) AS z FROM (SELECT count(*) / sum(count(*)) OVER () AS f FROM P GROUP BY y_true)), a AS (SELECT l, z FROM l, z)
    """ + metric_rows({"pac": ("(exp(-l) - exp(-z)) / greatest(1e-7::DOUBLE, 1 - exp(-z))", 1, 1)}, "a"))
def _(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), ["pac"]))


@query("j13_probabilistic_accuracy_binary", f"""WITH {B}, l AS (SELECT {BIN_LOSS.format(e="3e-8::DOUBLE")} AS l, avg(y_true) AS f FROM B),
      a AS (SELECT l, -(f * ln(f) + (1 - f) * ln(1 - f)) AS z FROM l)
    """ + metric_rows({"pac": ("(exp(-l) - exp(-z)) / greatest(1e-7::DOUBLE, 1 - exp(-z))", 1, 1)}, "a"))
def _(spark, sf):
    return rounded(M.evaluate(scored(spark, sf), ["pac"], problem=M.BINARY))


AUC = """(SELECT sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*)
    FROM B a, B b WHERE a.y_true = 1 AND b.y_true = 0)"""


@query("j14_roc_auc", f"WITH {B} " + metric_rows({"roc_auc": (AUC, 1, 1)}, "(SELECT 1)"))
def _(spark, sf):
    return rounded(M.evaluate(scored(spark, sf), ["roc_auc"], problem=M.BINARY))


@query("j14_roc_auc_by_group", f"""WITH {B} SELECT toxic, 'roc_auc' AS metric, round(v, 8) AS score, round(1 - v, 8) AS error FROM (
    SELECT a.toxic, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS v
    FROM B a JOIN B b ON a.toxic = b.toxic WHERE a.y_true = 1 AND b.y_true = 0 GROUP BY a.toxic)""")
def _(spark, sf):
    return rounded(M.evaluate(scored(spark, sf), ["roc_auc"], by=["toxic"], problem=M.BINARY))


MULTI_AUC = f"""{P}, x AS (SELECT key, y_true, c, probs[c + 1] AS p FROM P, (SELECT unnest(range(10)) AS c)),
  r AS (SELECT a.c AS a, b.y_true AS b, sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) AS wins, count(*) AS pairs
    FROM x a JOIN x b ON a.c = b.c AND a.y_true = a.c AND b.y_true <> a.c GROUP BY 1, 2),
  n AS (SELECT y_true AS c, count(*) AS n FROM P GROUP BY 1),
  ovr AS (SELECT a, sum(wins) / sum(pairs) AS auc, any_value(n) AS n FROM r JOIN n ON c = a GROUP BY a),
  ovo AS (SELECT a, b, wins / pairs AS auc, x.n + y.n AS n FROM r JOIN n x ON x.c = a JOIN n y ON y.c = b),
  mic AS (SELECT sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS auc FROM x a, x b WHERE a.y_true = a.c AND b.y_true <> b.c)"""


@query("j15_roc_auc_multiclass", f"WITH {MULTI_AUC} " + metric_rows({
    "roc_auc_ovr": ("(SELECT avg(auc) FROM ovr)", 1, 1), "roc_auc_ovr_weighted": ("(SELECT sum(auc * n) / sum(n) FROM ovr)", 1, 1),
    "roc_auc_ovr_micro": ("(SELECT auc FROM mic)", 1, 1), "roc_auc_ovo": ("(SELECT avg(auc) FROM ovo)", 1, 1),
    "roc_auc_ovo_weighted": ("(SELECT sum(auc * n) / sum(n) FROM ovo)", 1, 1)}, "(SELECT 1)"))
def _(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), ["roc_auc_ovr", "roc_auc_ovr_weighted", "roc_auc_ovr_micro",
                                                       "roc_auc_ovo", "roc_auc_ovo_weighted"]))


@query("j16_average_precision", f"""WITH {B}, v AS (SELECT score, sum(y_true) AS pos, count(*) AS n FROM B GROUP BY score),
      k AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS prec FROM v), a AS (SELECT sum(pos * prec) / sum(pos) AS ap FROM k)
    """ + metric_rows({"average_precision": ("ap", 1, 1)}, "a"))
def _(spark, sf):
    return rounded(M.evaluate(scored(spark, sf), ["average_precision"], problem=M.BINARY))


RANK = "(1 + len(list_filter(probs, lambda v: v > probs[y_true + 1])))"


@query("j17_top_k_accuracy", f"""WITH {P}, r AS (SELECT y_true, {RANK} AS r FROM P), m AS (SELECT avg((r <= 1)::INTEGER) AS a, avg((r <= 5)::INTEGER) AS b FROM r GROUP BY y_true)
    """ + metric_rows({"top_1": ("avg((r <= 1)::INTEGER)", 1, 1), "top_5": ("avg((r <= 5)::INTEGER)", 1, 1)}, "r") + " UNION ALL "
       + metric_rows({"top_1_macro": ("avg(a)", 1, 1), "top_5_macro": ("avg(b)", 1, 1)}, "m"))
def _(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), ["top_1", "top_5", "top_1_macro", "top_5_macro"]))


@query("j17_top_k_per_class", f"""WITH {P} SELECT y_true AS class, count(*) AS n, round(avg(({RANK} <= 1)::INTEGER), 8) AS top_1, round(avg(({RANK} <= 5)::INTEGER), 8) AS top_5 FROM P GROUP BY 1""")
def _(spark, sf):
    return rounded(M.classwise_top_k(predictions(spark, sf), [1, 5]), 8, ["top_1", "top_5"])


@query("j18_multilabel_hit_rate", f"""WITH {P}, t AS (SELECT CASE key % 3 WHEN 0 THEN [] WHEN 1 THEN [y_true] ELSE [y_true, (y_true + 1) % 10] END AS labels,
      list_transform(list_sort([{{'p': -probs[j + 1], 'j': j}} for j in range(10)]), lambda s: s.j) AS o FROM P)
    SELECT count(*) AS n, round(avg(list_has_any(o[1:1], labels)::INTEGER), 8) AS top_1, round(avg(list_has_any(o[1:5], labels)::INTEGER), 8) AS top_5 FROM t WHERE len(labels) > 0""")
def _(spark, sf):
    y = F.col("y_true")
    df = predictions(spark, sf).withColumn("labels", F.when(F.col("key") % 3 == 0, F.array().cast("array<int>"))
        .when(F.col("key") % 3 == 1, F.array(y)).otherwise(F.array(y, (y + 1) % 10)))
    return rounded(M.multilabel_hit_rate(df, "labels", "probs", [1, 5]), 8, ["top_1", "top_5"])


@query("j19_brier", f"WITH {P} " + metric_rows({"brier": ("avg(list_sum([pow(probs[j + 1] - (j = y_true)::INTEGER, 2) for j in range(10)]))", -1, 0)}, "P"))
def _(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), ["brier"]))


@query("j20_calibration_error", f"""WITH {P}, t AS (SELECT list_max(probs) AS conf, (list_position(probs, list_max(probs)) - 1 = y_true)::INTEGER AS hit FROM P),
      b AS (SELECT avg(conf) AS conf, avg(hit) AS acc, count(*) AS n FROM t GROUP BY least(greatest(ceil(round(conf * 15, 9)) - 1, 0), 14))
    """ + metric_rows({"expected_calibration_error": ("sum(n * abs(conf - acc)) / sum(n)", -1, 0)}, "b"))
def _(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), ["ece"]))


@query("j21_thresholded_scores", f"""WITH {B}, h AS (SELECT y_true AS y, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM B),
      c AS (SELECT sum(y * p)::DOUBLE AS tp, sum(p)::DOUBLE AS m, sum(y)::DOUBLE AS t, count(*)::DOUBLE AS n FROM h)
    SELECT round((tp / t + (n - t - m + tp) / (n - t)) / 2, 8) AS balanced_accuracy, round(tp / t * tp / m + (1 - tp / t) * t / n, 8) AS average_precision FROM c""")
def _(spark, sf):
    return rounded(M.threshold_scores(scored(spark, sf)), 8, ["balanced_accuracy", "average_precision"])


@query("j22_scorer_registry", f"WITH {CLASS_CTE} " + metric_rows({m: CLASS[m] for m in ("accuracy", "mcc", "f1_macro", "quadratic_kappa")}, "s")
       + " UNION ALL " + metric_rows({"log_loss": ("avg(-ln(probs[y_true + 1]))", -1, 0),
                                      "top_5": (f"avg(({RANK} <= 5)::INTEGER)", 1, 1)}, "P"))
def _(spark, sf):
    return rounded(M.evaluate(predictions(spark, sf), ["acc", "mcc", "f1_macro", "quadratic_kappa", "nll", "top_5"], problem=M.MULTICLASS))


@query("j22_weighted_scores", f"""WITH {P}, c AS (SELECT y_true, y_pred, (1 + key % 3)::DOUBLE AS w, probs FROM Q)
    """ + metric_rows({"accuracy": ("sum(w * (y_true = y_pred)::INTEGER) / sum(w)", 1, 1),
                       "log_loss": ("sum(-w * ln(probs[y_true + 1])) / sum(w)", -1, 0)}, "c"))
def _(spark, sf):
    df = predictions(spark, sf).withColumn("w", 1 + F.col("key") % 3)
    return rounded(M.evaluate(df, ["accuracy", "log_loss"], weight="w"))


@query("m1_custom_metric", f"""WITH {R} SELECT status, 'bias' AS metric, round(-abs(avg(y_pred - y_true)), 6) AS score, round(abs(avg(y_pred - y_true)), 6) AS error FROM R GROUP BY status""")
def _(spark, sf):
    if "bias" not in M.REGISTRY:
        M.register_metric("bias", lambda y, p, w: F.abs(M.wmean(p - y, w)), 0.0, False, problems=[M.REGRESSION])
    return rounded(M.evaluate(regression(spark, sf), ["bias"], by=["status"], problem=M.REGRESSION), 6)


LEVELS = (0.1, 0.5, 0.9)


@query("m1_quantile_metric", f"""WITH d AS (SELECT l_linestatus AS status, l_extendedprice AS y, [l_quantity * 1000, l_quantity * 1500, l_quantity * 2000] AS q FROM lineitem),
      e AS (SELECT status, ({' + '.join(f'greatest({a}::DOUBLE * (y - q[{i + 1}]), ({a}::DOUBLE - 1) * (y - q[{i + 1}]))' for i, a in enumerate(LEVELS))}) / {len(LEVELS)} AS loss FROM d)
    SELECT status, 'pinball' AS metric, round(-avg(loss), 6) AS score, round(avg(loss), 6) AS error FROM e GROUP BY status""")
def _(spark, sf):
    if "pinball" not in M.REGISTRY:
        M.register_metric("pinball", M.pinball_loss, 0.0, False, "quantile", problems=[M.REGRESSION])
    x = F.col("l_quantity")
    df = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("y_true"),
                                             F.array(x * 1000, x * 1500, x * 2000).alias("quantiles"))
    return rounded(M.evaluate(df, ["pinball"], by=["status"], problem=M.REGRESSION, quantile_levels=LEVELS), 6)
