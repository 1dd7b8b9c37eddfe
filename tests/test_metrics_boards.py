from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tabwright.operators import boards as B, metrics as M


def scores(df):
    return {r["metric"]: r["score"] for r in df.collect()}


def test_direction_and_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0)], "y_true double, y_pred double")
    out = {r["metric"]: (r["score"], r["error"]) for r in M.evaluate(df, ["mse", "r2"]).collect()}
    assert out["mean_squared_error"] == (-2.0, 2.0)
    assert out["r2"] == (-7.0, 8.0)


def test_percentage_errors_guard_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0)], "y_true double, y_pred double")
    assert scores(M.evaluate(df, ["smape"])) == {"symmetric_mean_absolute_percentage_error": -0.5}


def test_balanced_accuracy_counts_predicted_only_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y_true int, y_pred int")
    cells = M.confusion(df)
    assert math.isclose(M.confusion_scores(cells).first()["balanced_accuracy"], (0.5 + 1 + 1) / 3)
    assert math.isclose(M.confusion_scores(cells, strict=True).first()["balanced_accuracy"], 0.75)


def test_binary_balanced_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y_true int, y_pred int")
    assert scores(M.evaluate(df, ["balanced_accuracy"], problem=M.BINARY))["balanced_accuracy"] == 0.75


def test_roc_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y_true int, score double")
    assert scores(M.evaluate(df, ["roc_auc"], problem=M.BINARY))["roc_auc"] == 0.875
    with pytest.raises(Exception, match="only one class"):
        M.evaluate(df.where("y_true = 1"), ["roc_auc"], problem=M.BINARY).collect()


def test_roc_auc_with_one_hot_score(spark):
    """A third of all rows on one score is one point of the curve."""
    df = spark.range(3000).select((F.col("id") % 2).alias("y_true"),
                                  F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 3000).alias("score"))
    pdf = df.toPandas()
    pos, neg = pdf[pdf.y_true == 1].score.to_numpy(), pdf[pdf.y_true == 0].score.to_numpy()
    brute = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert math.isclose(scores(M.evaluate(df, ["roc_auc"], problem=M.BINARY))["roc_auc"], brute, abs_tol=1e-12)


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (5.0, 9.0)], "y_true double, y_pred double")
    assert math.isclose(scores(M.evaluate(df, ["spearmanr"]))["spearmanr"], 0.8333333333333334)


def test_classes_follow_from_probabilities(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8]), (0, [0.4, 0.6])], "y_true int, probs array<double>")
    assert scores(M.evaluate(df, ["accuracy"]))["accuracy"] == 0.5
    binary = spark.createDataFrame([(1, 0.5), (1, 0.51)], "y_true int, score double")
    assert scores(M.evaluate(binary, ["accuracy"], problem=M.BINARY))["accuracy"] == 0.5


def test_perfect_probabilities_have_pac_one(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "y_true int, probs array<double>")
    out = scores(M.evaluate(df, ["pac", "log_loss"]))
    assert math.isclose(out["pac"], 1, abs_tol=1e-6) and abs(out["log_loss"]) < 1e-12


def test_true_class_rank_ties(spark):
    df = spark.createDataFrame([(2, [0.4, 0.3, 0.3])], "y int, p array<double>")
    assert df.select(M.true_class_rank(F.col("y"), F.col("p"))).first()[0] == 3


def test_registry_errors_name_valid_choices():
    with pytest.raises(ValueError, match="unknown metric 'nope'"):
        M.get_metric("nope")
    with pytest.raises(ValueError, match="not a regression metric"):
        M.get_metric("accuracy", M.REGRESSION)
    with pytest.raises(ValueError, match="is taken"):
        M.register_metric("acc", lambda y, p, w: F.avg(y))
    assert M.get_metric("rmse").name == "root_mean_squared_error" and M.get_metric("rmse").sign == -1


def test_matthews_zero_when_undefined(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y_true int, y_pred int")
    assert scores(M.evaluate(df, ["mcc", "quadratic_kappa"])) == {"mcc": 0.0, "quadratic_kappa": 0.0}


def test_confusion_matrix_normalisation_and_empty_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "y_true int, y_pred int")
    got = {(r["t"], r["p"]): r["value"] for r in M.confusion_matrix(df, [0, 1], "true").collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.0, (1, 1): 0.0}


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("d", "a", 0.90004), ("d", "b", 0.90001), ("d", "c", 0.1), ("e", "a", 0.5), ("e", "b", 0.4), ("e", "c", 0.3)],
                               "dataset string, method string, score double")
    got = {r["method"]: (r["mean_rank"], r["wins"]) for r in B.ranks_and_wins(df).collect()}
    assert got == {"a": (1.25, 1), "b": (1.75, 0), "c": (3.0, 0)}


def test_seed_summary_skips_failed_runs(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("x", 3.0)], "m string, score double")
    assert tuple(B.seed_summary(df, ["m"]).first()) == ("x", 2.0, 1.0, 2)


def test_grid_scores_invalid_cells_zero(spark):
    runs = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.6), (1, 2, 0.9)], "a int, b int, score double")
    got = {(r["a"], r["b"]): (r["valid"], r["mean"], r["best"]) for r in B.grid_table(runs, [1, 2], [1, 2]).collect()}
    assert got[(1, 2)] == (False, 0.0, False) and got[(2, 1)] == (True, 0.6, True) and got[(2, 2)][1] is None


def test_input_checks_report(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, float("nan"))], "x double, y double")
    got = {r["check"]: r["status"] for r in B.input_checks(df, ["x"], "y", classification=False).collect()}
    assert got == {"min_rows": "ok", "min_features": "ok", "finite_target": "error", "max_rows": "ok", "max_features": "ok"}


def test_groups_may_have_any_name(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.1), ("y", 1, 0.2), ("y", 0, 0.7)], "s string, y_true int, score double")
    for name in ("s", "t", "a", "p", "class"):
        out = M.evaluate(df.withColumnRenamed("s", name), ["roc_auc", "accuracy", "log_loss"], by=[name], problem=M.BINARY)
        got = {(r[name], r["metric"]): r["score"] for r in out.collect()}
        assert got[("x", "roc_auc")] == 1.0 and got[("y", "accuracy")] == 0.0


def test_labels_that_are_no_class_are_no_hits(spark):
    from tabwright.operators.metrics import top_k_hit
    rows = [(0, [0.7, 0.3]), (1, [0.8, 0.2]), (5, [0.5, 0.5]), (-1, [0.5, 0.5]), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "y int, p array<double>")
    got = [r[0] for r in df.select(top_k_hit(F.col("y"), F.col("p"), 1)).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_not_finite_values_are_not_ranked(spark):
    from tabwright.operators.ordered import quantiles
    rows = [(float(i),) if i % 3 else (float("nan"),) for i in range(100)] + [(float("inf"),), (None,)]
    finite = sorted(float(i) for i in range(100) if i % 3)
    df = spark.createDataFrame(rows, "x double")
    assert quantiles(df, ["x"], [0.0, 1.0])["x"] == [finite[0], finite[-1]]


def test_one_code_per_number_whatever_its_type(spark):
    from tabwright.operators.encode import fit_codes, fit_onehot
    ints = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    doubles = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (3.5,)], "x double")
    codes = fit_codes(ints, ["x"], unknown=-1)
    assert [r[0] for r in codes.transform(doubles).collect()] == [0.0, 1.0, None, -1.0]
    names = fit_onehot(spark.createDataFrame([("a.b",), ("a_b",), ("c",)], "x string"), ["x"]).names()
    assert len(set(names)) == 3


def test_null_predictions_are_errors(spark):
    from tabwright.operators.metrics import evaluate
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 2.0)], "y double, p double")
    with pytest.raises(Exception, match="null prediction"):
        evaluate(df, ["r2"], y_true="y", y_pred="p").collect()


def test_checksums_tell_shifted_and_null_values_apart(spark):
    from tabwright.sources.tables import table_checksum
    sums = {tuple(table_checksum(spark.createDataFrame([r], "a string, b string")).first())
            for r in [("a|", "b"), ("a", "|b"), ("", "x"), (None, "x"), ("1:a", ""), ("", "1:a")]}
    assert len(sums) == 6


def brute_areas(rows, classes):
    """AUC of every ordered pair, one-vs-rest and micro curve by comparing all pairs of rows, with weights."""
    def area(pos, neg):
        total = sum(w * v for _, w in pos for _, v in neg)
        won = sum(w * v * ((s > t) + 0.5 * (s == t)) for s, w in pos for t, v in neg)
        return won / total if total else None
    ovo = {(a, b): area([(p[a], w) for y, p, w in rows if y == a], [(p[a], w) for y, p, w in rows if y == b])
           for a in range(classes) for b in range(classes) if a != b}
    ovr = {a: area([(p[a], w) for y, p, w in rows if y == a], [(p[a], w) for y, p, w in rows if y != a]) for a in range(classes)}
    micro = area([(p[c], w) for y, p, w in rows for c in range(classes) if c == y], [(p[c], w) for y, p, w in rows for c in range(classes) if c != y])
    return ovo, ovr, micro


def test_areas_of_all_classes_from_one_table(spark):
    """Ties, weights, groups and a class without true rows."""
    import random
    rnd = random.Random(11)
    data = [(g, rnd.choice([0, 1, 2]), [round(rnd.random(), 1) for _ in range(4)], float(rnd.choice([1, 2, 5]))) for g in ("a", "b") for _ in range(40)]
    df = spark.createDataFrame(data, "g string, y int, p array<double>, w double")
    ready = df.select("g", F.col("y").cast("double").alias("_y"), F.col("p").alias("_probs"), F.col("w").alias("_w"))
    found = M.class_areas(ready, ["g"]).collect()
    for g in ("a", "b"):
        rows = [(y, p, w) for k, y, p, w in data if k == g]
        ovo, ovr, micro = brute_areas(rows, 4)
        got = {(r["kind"], r["a"], r["b"]): r["auc"] for r in found if r["g"] == g}
        for (a, b), value in ovo.items():
            if value is not None:
                assert abs(got["ovo", a, b] - value) < 1e-12
            else:
                assert got.get(("ovo", a, b)) is None
        assert all(abs(got["ovr", a, -1] - v) < 1e-12 for a, v in ovr.items() if v is not None) and got.get(("ovr", 3, -1)) is None
        assert abs(got["micro", -1, -1] - micro) < 1e-12
        size = {y: sum(w for k, w in [(y2, w2) for y2, _, w2 in rows] if k == y) for y in range(3)}
        scores = {r["metric"]: r["score"] for r in M.evaluate(df.where(F.col("g") == g), ["roc_auc_ovo", "roc_auc_ovo_weighted", "roc_auc_ovr_weighted"],
                                                              y_true="y", probs="p", weight="w").collect()}
        pairs = {k: v for k, v in ovo.items() if v is not None}
        assert abs(scores["roc_auc_ovo"] - sum(pairs.values()) / len(pairs)) < 1e-12
        weights = {(a, b): size[a] + size[b] for a, b in pairs}
        assert abs(scores["roc_auc_ovo_weighted"] - sum(pairs[k] * weights[k] for k in pairs) / sum(weights.values())) < 1e-12
        assert abs(scores["roc_auc_ovr_weighted"] - sum(ovr[a] * size[a] for a in size) / sum(size.values())) < 1e-12


def test_metrics_of_quantiles(spark):
    name = "pinball_test"
    if name not in M.REGISTRY:
        M.register_metric(name, M.pinball_loss, 0.0, False, "quantile", problems=[M.REGRESSION])
    df = spark.createDataFrame([(10.0, [8.0, 11.0], 1.0), (4.0, [5.0, 6.0], 3.0)], "y_true double, quantiles array<double>, w double")
    row = M.evaluate(df, [name], problem=M.REGRESSION, quantile_levels=[0.1, 0.9], weight="w").first()
    each = [(0.1 * 2 + 0.1 * 1) / 2, (0.9 * 1 + 0.1 * 2) / 2]
    assert abs(row["error"] - (each[0] + 3 * each[1]) / 4) < 1e-12 and row["score"] == -row["error"]
    with pytest.raises(ValueError, match="quantile_levels"):
        M.evaluate(df, [name], problem=M.REGRESSION)
    with pytest.raises(Exception, match="quantile"):
        M.evaluate(df, [name], problem=M.REGRESSION, quantile_levels=[0.1, 0.5, 0.9]).collect()
    with pytest.raises(Exception, match="quantile"):
        M.evaluate(df.withColumn("quantiles", F.array(F.lit(1.0), F.lit(None).cast("double"))), [name], problem=M.REGRESSION,
                   quantile_levels=[0.1, 0.9]).collect()
    with pytest.raises(ValueError):
        M.register_metric("odd_kind", M.pinball_loss, needs="interval")
