from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import bars as H, combine as C

BORDERS = [-2.0, -1.0, 0.0, 0.5, 2.0]


@pytest.fixture(scope="module")
def dist(spark):
    rows = [(i, [random.Random(i * 4 + j).gauss(0, 1) for j in range(4)]) for i in range(20)]
    return spark.createDataFrame(rows, "key int, logits array<double>").persist()


def density(p, full):
    """Density function of one distribution, for numeric integration."""
    b = BORDERS
    s0, s1 = (b[1] - b[0]) / H.HALF_NORMAL_MEDIAN, (b[-1] - b[-2]) / H.HALF_NORMAL_MEDIAN

    def f(x):
        out = np.zeros_like(x)
        for i in range(4):
            if full and i == 0:
                d = b[1] - x
                out += np.where(d > 0, p[0] * math.sqrt(2 / math.pi) / s0 * np.exp(-d * d / (2 * s0 * s0)), 0)
            elif full and i == 3:
                d = x - b[-2]
                out += np.where(d > 0, p[3] * math.sqrt(2 / math.pi) / s1 * np.exp(-d * d / (2 * s1 * s1)), 0)
            else:
                out += np.where((x > b[i]) & (x <= b[i + 1]), p[i] / (b[i + 1] - b[i]), 0)
        return out
    return f


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("best", [-1.5, -0.2, 0.7, 3.0])
def test_moments_and_improvement_match_integration(dist, full, best):
    names = ["mean", "variance", "expected_improvement", "improvement_probability"]
    rows = H.distribution_stats(dist, BORDERS, names, best=best, full_support=full).collect()
    grid = np.linspace(-30, 30, 600_001)
    for r in rows[:4]:
        e = np.exp(np.array(r["logits"]))
        w = density(e / e.sum(), full)(grid)
        step = grid[1] - grid[0]
        mean = (grid * w).sum() * step
        assert math.isclose(r["mean"], mean, abs_tol=2e-3)
        assert math.isclose(r["variance"], (grid * grid * w).sum() * step - mean**2, abs_tol=5e-3)
        assert math.isclose(r["expected_improvement"], (np.maximum(grid - best, 0) * w).sum() * step, abs_tol=2e-3)
        assert math.isclose(r["improvement_probability"], ((grid > best) * w).sum() * step, abs_tol=2e-3)


def test_cdf_inverts_quantile(dist):
    d = H.BarDistribution(tuple(BORDERS))
    rows = d.prepare(dist, "logits")
    for q in (0.05, 0.3, 0.5, 0.99):
        back = rows.withColumn("x", d.quantile(q)).select(d.cdf(F.col("x")).alias("c")).collect()
        assert all(math.isclose(r["c"], q, abs_tol=1e-9) for r in back)


def test_bar_index_borders_and_missing(spark):
    d = H.BarDistribution(tuple(BORDERS))
    df = spark.createDataFrame([(y,) for y in (-2.0, -1.0, -0.5, 2.0, 9.0, None)], "y double")
    assert [r[0] for r in df.select(d.bar_index(F.col("y"))).collect()] == [0, 0, 1, 3, 4, None]
    full = H.BarDistribution(tuple(BORDERS), full_support=True)
    assert [r[0] for r in df.select(full.bar_index(F.col("y"))).collect()] == [0, 0, 1, 3, 3, None]


def test_missing_target_costs_nothing(spark):
    df = spark.createDataFrame([([0.0] * 4, None), ([0.0] * 4, 0.25)], "logits array<double>, y double")
    losses = [r["loss"] for r in H.distribution_stats(df, BORDERS, ["loss"], y="y").collect()]
    assert losses[0] == 0 and math.isclose(losses[1], -math.log(0.25 / 0.5))


def test_borders_must_ascend():
    with pytest.raises(ValueError, match="ascend"):
        H.BarDistribution((1.0, 0.0))


def test_samples_follow_the_distribution(spark):
    df = spark.range(4000).select(F.col("id").alias("key"), F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0, -1.0)]).alias("logits"))
    row = H.distribution_stats(df, BORDERS, ["sample", "mean"], key="key").agg(F.avg("sample").alias("s"), F.avg("mean").alias("m")).first()
    assert abs(row["s"] - row["m"]) < 0.05


def test_probabilities_sum_to_one(dist):
    df = C.tidy_probs(C.reweight(C.softmax(dist, "logits", 0.9, 3), "probs", [0.5, 0.3, 0.2], "divide"), "probs")
    assert all(math.isclose(sum(r["probs"]), 1) and len(r["probs"]) == 3 for r in df.collect())


def test_repair_of_broken_borders():
    b, mask, turned = C.repair_borders([math.nan, -5000.0, -1.0, 0.0, 2.0, math.inf])
    assert b == [-2.0, -1.0, -1.0, 0.0, 2.0, 3.0] and mask == [True, True, False, False, True] and not turned
    b, mask, turned = C.repair_borders([3.0, 1.0, 0.0])
    assert b == [0.0, 1.0, 3.0] and turned
    b, _, _ = C.repair_borders([1.0, 1.0, 2.0, 2.0])
    assert b[0] == 0.9 and math.isclose(b[-1], 2.2)
    b, _, _ = C.repair_borders([0.0, 0.0, 1.0])
    assert b[0] < b[1]
    with pytest.raises(ValueError):
        C.repair_borders([math.nan, math.nan, 1.0])


def test_merge_on_own_borders_is_the_mean(dist):
    two = dist.select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("member"), "logits")
    got = {r["key"]: r["probs"] for r in C.merge_distributions(two, "key", "member", "logits", {0: BORDERS, 1: BORDERS}, BORDERS).collect()}
    geo = {r["key"]: r["probs"] for r in C.merge_distributions(two, "key", "member", "logits", {0: BORDERS, 1: BORDERS}, BORDERS, True).collect()}
    for r in dist.collect():
        p = np.exp(r["logits"])
        assert np.allclose(got[r["key"]], p / p.sum()) and np.allclose(geo[r["key"]], p / p.sum())


def test_model_hook_batches_and_setup(spark):
    def fn(rows: pd.DataFrame, state) -> pd.DataFrame:
        return pd.DataFrame({"id": rows["id"], "size": len(rows), "state": state})
    out = C.map_model(spark.range(10).coalesce(1), fn, "id long, size int, state string", batch=4, setup=lambda: "loaded")
    assert [r["size"] for r in out.orderBy("id").collect()] == [4] * 8 + [2] * 2
    assert out.first()["state"] == "loaded"
