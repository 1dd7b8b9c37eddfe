"""End-to-end predictions against plain Python, with models that fit in Spark and models that are given."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import combine as C, reshape as R
from tabwright.operators.features import Scale
from tabwright.operators.fitted import Chain
from tabwright.plans import ensemble as G, predict as P, steps as S

PLAIN = S.StepOptions(fingerprint=False, order=None)


@pytest.fixture(scope="module")
def flowers(spark):
    """Three classes of four numbers, a category and rows without a label."""
    rng = np.random.default_rng(0)
    means = np.array([[0, 0, 0, 0], [4, 0, 3, 1], [0, 5, 1, 4]])
    rows = [(i, *map(float, means[i % 3] + rng.normal(size=4) * 0.7), "ab"[i % 2], ["rose", "fern", "moss"][i % 3]) for i in range(150)]
    rows += [(200, 0.0, 0.0, 0.0, 0.0, "a", None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e string, y string")


def test_classes_from_a_model_that_learns(spark, flowers):
    train, test = flowers.where("id % 5 <> 0"), flowers.where("id % 5 = 0 and y is not null")
    model = lambda shown, rows: P.nearest_means(shown, rows, 3, "id")
    for options in ({}, {"before_softmax": True}, {"balance": True}, {"subsample_size": 60}):
        fitted = P.fit_classifier(train, "id", list("abcd"), "y", model, n=4, seed=3, options=S.StepOptions(), **options)
        assert fitted.labels == ["fern", "moss", "rose"]
        got = {r["id"]: r for r in fitted.predict(test).collect()}
        truth = {r["id"]: r["y"] for r in test.collect()}
        assert set(got) == set(truth) and all(math.isclose(sum(r["probs"]), 1) for r in got.values())
        assert np.mean([got[i]["prediction"] == y for i, y in truth.items()]) > 0.9


@pytest.mark.parametrize("method", ["shuffle", "rotate", None])
def test_class_order_is_undone(spark, flowers, method):
    """A model that always answers the second true class, in every member's own class order."""
    def model(shown, rows):
        truth = shown.join(flowers.select("id", "y"), "id").where("y = 'moss'").groupBy("member").agg(F.first("target").cast("int").alias("c"))
        logits = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.when(j == F.col("c"), 5.0).otherwise(0.0))
        return rows.join(truth, "member").select("member", "id", logits.alias("logits"))
    fitted = P.fit_classifier(flowers, "id", ["a", "b"], "y", model, n=6, configs=[S.PrepConfig("none", "none")], options=PLAIN,
                              class_shift=method, seed=1)
    rows = fitted.predict(flowers).collect()
    expected = math.exp(5 / 0.9) / (math.exp(5 / 0.9) + 2)
    assert len(rows) == 151 and {r["prediction"] for r in rows} == {"moss"}
    assert all(math.isclose(r["probs"][1], expected, rel_tol=1e-9) for r in rows)


def test_balancing_multiplies_by_class_shares(spark, flowers):
    train = flowers.where("y <> 'fern' or id < 30")
    model = P.linear([[0.0] * 3] * 2, "id")
    fitted = P.fit_classifier(train, "id", ["a", "b"], "y", model, n=2, configs=[S.PrepConfig("none", "none")], options=PLAIN, balance=True)
    n = {r["y"]: r["count"] for r in train.where("y is not null").groupBy("y").count().collect()}
    (row,) = {tuple(r["probs"]) for r in fitted.predict_proba(flowers).collect()}
    assert np.allclose(row, [n[c] / sum(n.values()) for c in fitted.labels])


def test_numbers_from_bars(spark):
    """A model that puts all mass on one bar per row: mean, median and mode lie in it, on the target's scale."""
    rows = spark.range(60).select("id", (F.col("id") % 12).cast("double").alias("a"), (F.col("id") * 3.0 + 100).alias("y"))
    borders = [-2 + 0.25 * i for i in range(17)]

    def model(shown, asked):
        bar = F.get("features", F.lit(0)).cast("int") + 2
        return asked.select("member", "id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.when(j == bar, 50.0).otherwise(0.0)).alias("logits"))
    for before in (False, True):
        fitted = P.fit_regressor(rows, "id", ["a"], "y", model, borders, n=3, configs=[S.PrepConfig("none", "none")], options=PLAIN,
                                 target_transforms=(None,), before_softmax=before)
        y = np.array([3.0 * i + 100 for i in range(60)])
        for r in fitted.predict(rows, quantiles=[0.25, 0.5]).collect():
            low = (borders[r["id"] % 12 + 2]) * y.std() + y.mean()
            width = 0.25 * y.std()
            assert abs(r["mean"] - low - width / 2) < 1e-6 and abs(r["mode"] - low - width / 2) < 1e-9
            assert abs(r["median"] - low - width / 2) < 1e-6 and abs(r["q_0_25"] - low - width / 4) < 1e-6
    with pytest.raises(ValueError):
        fitted.predict(rows, ["spread"])
    with pytest.raises(ValueError):
        fitted.predict(rows, quantiles=[1.5])


def test_target_transforms_are_undone(spark):
    """Bars around a transformed target come back around the target itself."""
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), F.exp(F.col("id") / 90).alias("y"))
    borders = [-4 + 0.1 * i for i in range(81)]

    def model(shown, asked):   # a bell around the row's own transformed target
        known = shown.select("member", "id", "target")
        logits = F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: -F.pow((i * 0.1 - 3.95 - F.col("target")) / 0.1, 2))
        return asked.join(known, ["member", "id"]).select("member", "id", logits.alias("logits"))
    fitted = P.fit_regressor(rows, "id", ["a"], "y", model, borders, n=2, configs=[S.PrepConfig("none", "none")], options=PLAIN,
                             target_transforms=("safepower",), seed=2)
    moved = fitted.member_borders()[0]
    assert moved != borders and moved == sorted(moved)
    y = np.exp(np.arange(400) / 90)
    for r in fitted.predict(rows, ["median"]).collect():
        # the bars are a tenth wide in the transformed target; the common ones in the target's deviations
        assert abs(r["median"] - y[r["id"]]) < 0.35 * y.std()


@pytest.mark.parametrize("method, lam", [("yeo-johnson", lam) for lam in (-1.3, 0.0, 0.7, 2.0, 3.1)] + [("box-cox", 0.0), ("box-cox", 0.5), ("box-cox", -2.0)])
def test_power_transforms_have_inverses(spark, method, lam):
    x = [0.01, 0.5, 1.0, 3.0, 20.0] + ([] if method == "box-cox" else [-0.01, -0.5, -1.0, -3.0, -20.0, 0.0])
    fitted = R.Power({"x": [lam, 0.3, 1.7]}, method)
    done = [r["x"] for r in fitted.transform(spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)).collect()]
    assert np.allclose(sorted(fitted.inverse_values("x", done)), sorted(x), rtol=1e-9)
    assert Chain([Scale({"x": [2.0, 0.5, 1.0]}), R.Power({"x": [None, 1.0, 2.0]}, method)]).inverse_values("x", [0.25]) == [(0.25 * 2 + 1 - 1) / 0.5 + 2]
    assert any(math.isnan(v) for v in R.Power({"x": [2.0, 0, 1]}, "box-cox").inverse_values("x", [-1.0]))
    with pytest.raises(ValueError):
        R.Elementwise(["x"], "exp").inverse_values("x", [1.0])


def test_unusable_borders_are_repaired():
    """What an inverse cannot give is a masked bar, not a failure."""
    raw = R.Power({"y": [-0.9, 0.0, 1.0]}, "yeo-johnson").inverse_values("y", [-1.0, 0.0, 0.5, 1.0, 1.2, 5.0])
    borders, mask, turned = C.repair_borders(raw)
    assert len(borders) == 6 and borders == sorted(borders) and any(mask) and not turned


def test_members_of_a_plan_follow_one_seed():
    a, b = (G.plan_members("classification", 5, 3, seed=4) for _ in range(2))
    assert a == b and sorted({m.options.shift for m in a}) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("before", [False, True])
def test_outputs_of_models_per_row_are_not_shuffled(spark, before):
    """Rows that share a key, over the ends of batches; the same answers as from a model that promises nothing."""
    rows = spark.range(400).select(F.when(F.col("id") % 9 > 0, F.col("id") % 150).alias("id"), (F.col("id") % 11).cast("double").alias("a"),
                                   F.sin("id").alias("b"), (F.col("id") % 3).alias("c"), F.col("id").cast("double").alias("y"))
    configs, borders = [S.PrepConfig("robust", "none"), S.PrepConfig("none", "none")], [-2 + 0.5 * i for i in range(9)]

    def answers(per_row):
        weights = [[(j + 1) * (i - 3.5) / 4 for i in range(8)] for j in range(2)]
        models = [P.linear(weights, "id"), P.linear([w[:3] for w in weights], "id")]
        models = models if per_row else [lambda t, r, m=m: m(t, r) for m in models]
        bars = P.fit_regressor(rows, "id", ["a", "b"], "y", models[0], borders, n=2, configs=configs, options=PLAIN, target_transforms=(None,),
                               before_softmax=before).predict(rows)
        classes = P.fit_classifier(rows, "id", ["a", "b"], "c", models[1], n=4, configs=configs, options=PLAIN, before_softmax=before).predict_proba(rows)
        for out in (bars, classes):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert (plan.count("Exchange") == 1 and "Aggregate" not in plan) == per_row
        return [sorted(([r["id"], *np.ravel([np.ravel(r[c]) for c in out.columns if c not in ("id", "probs")]), *(r["probs"] if "probs" in out.columns else [])]
                        for r in out.collect()), key=lambda r: (r[0] is None, r[0])) for out in (bars, classes)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        fast, plain = answers(True), answers(False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for x, y in zip(fast, plain):
        assert [r[0] for r in x] == [r[0] for r in y] and x[-1][0] is None
        assert np.allclose(np.array([r[1:] for r in x], float), np.array([r[1:] for r in y], float), rtol=1e-9)
