from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import history as H, ordered as O, split as S
from tabwright.functions.hashing import seeded_hash


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value and one group."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(1) * 100).alias("x"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(
                                        F.concat(F.lit("g"), F.col("id") % 7)).alias("g")).persist()


def test_quantiles_match_numpy(skewed):
    x = np.array([r["x"] for r in skewed.collect()])
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    assert np.allclose(O.quantiles(skewed, ["x"], probs)["x"], np.quantile(x, probs))


def test_quantiles_ignore_null_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert O.quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": []}


def test_grouped_quantiles(skewed):
    got = {r["g"]: r["m"] for r in O.grouped_quantiles(skewed, ["g"], "x", {"m": 0.3}).collect()}
    pdf = skewed.toPandas()
    for g, x in pdf.groupby("g")["x"]:
        assert np.isclose(got[g], np.quantile(x, 0.3))


def test_running_sum_max_and_next(skewed):
    df = skewed.withColumn("id", F.col("id") * 2)
    pdf = df.toPandas().sort_values("id")
    out = O.running(df, ["g"], "id", {"s": "x"}, {"m": "x"}).toPandas().sort_values("id")
    by = pdf.groupby("g")["x"]
    assert np.allclose(out["s"], (by.cumsum() - pdf["x"]).to_numpy())
    expect = by.transform(lambda v: v.cummax().shift())
    assert np.allclose(out["m"].to_numpy(), expect.to_numpy(), equal_nan=True)
    nxt = O.next_value(df, ["g"], "id", "n").toPandas().sort_values("id")
    assert np.allclose(nxt["n"].to_numpy(float), pdf.groupby("g")["id"].shift(-1).to_numpy(), equal_nan=True)


def test_hash_rank_is_a_permutation_for_any_prefix(skewed):
    df = skewed.withColumn("h", seeded_hash(3, "id"))
    ranks = [{r["id"]: r["r"] for r in O.hash_rank(df, "h", "r", ["g"], d).collect()} for d in (1, 3)]
    assert ranks[0] == ranks[1]
    assert sorted(v for k, v in ranks[0].items() if k % 3 == 0) == list(range(1, 1001))


def test_split_sizes_are_exact_and_stable(spark):
    df = spark.range(1003)
    a = S.three_way_split(df, "id", seed=1)
    counts = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"train": 802, "valid": 80, "test": 121}
    assert sorted(a.collect()) == sorted(S.three_way_split(df.repartition(9), "id", seed=1).collect())
    assert sorted(a.collect()) != sorted(S.three_way_split(df, "id", seed=2).collect())


def test_stratified_split_keeps_shares_with_a_hot_class(skewed):
    out = S.stratified_split(skewed, "id", "g", 0.2)
    assert out.where("split = 'test'").count() == 600
    shares = out.groupBy("g").agg(F.avg((F.col("split") == "test").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r["s"] - 0.2) <= 1 / r["n"] for r in shares)


def test_folds_are_disjoint_complete_and_equal(spark):
    df = spark.range(103).withColumn("y", F.col("id") % 4)
    folds = S.kfold(df, "id", 5, "y", repeats=2)
    assert folds.groupBy("repeat", "id").count().where("count <> 1").count() == 0
    sizes = [r["count"] for r in folds.groupBy("repeat", "fold").count().collect()]
    assert len(sizes) == 10 and set(sizes) <= {20, 21}
    equal = S.kfold(df, "id", 5, equal_size=True).groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in equal} == {-1: 3, 0: 20, 1: 20, 2: 20, 3: 20, 4: 20}


def test_subsample_sizes(spark):
    df = spark.range(100)
    sizes = {r["member"]: r["count"] for r in S.subsample(df, "id", 0.25, 3).groupBy("member").count().collect()}
    assert sizes == {0: 26, 1: 26, 2: 26}
    with pytest.raises(ValueError):
        S.subsample(df, "id", 101, 1)


def test_per_class_sample_takes_small_classes_whole(spark):
    df = spark.range(30).withColumn("y", F.when(F.col("id") < 4, 0).otherwise(1))
    got = {(r["try"], r["y"]): r["count"] for r in S.per_class_sample(df, "id", "y", 10, 2).groupBy("try", "y").count().collect()}
    assert got == {(0, 0): 4, (0, 1): 10, (1, 0): 4, (1, 1): 10}


def test_epoch_order_and_resume(spark):
    df = spark.range(10)
    epoch = S.epoch_order(df, "id", 25, shards=4, epoch=1)
    assert epoch.count() == 25
    assert {r["shard"]: r["count"] for r in epoch.groupBy("shard").count().collect()} == {0: 7, 1: 6, 2: 6, 3: 6}
    whole = S.shard_order(df, "id", 2, seed=3)
    rest = S.shard_order(df, "id", 2, seed=3, advance=2)
    keep = {(r["shard"], r["position"]): r["id"] for r in whole.collect() if r["position"] >= 2}
    assert keep == {(r["shard"], r["position"]): r["id"] for r in rest.collect()}
    assert S.shard_order(df, "id", 2, seed=3, advance=10).first()["pass"] == 1


def test_meter_blocks_do_not_change_results(skewed):
    a = H.smoothed_meter(skewed, ["g"], "id", "x", block_rows=64).orderBy("id").toPandas()
    b = H.smoothed_meter(skewed, ["g"], "id", "x").orderBy("id").toPandas()
    assert np.allclose(a[["median", "avg", "global_avg", "max"]], b[["median", "avg", "global_avg", "max"]])


def test_lower_median_for_even_counts(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 4.0)], "t int, v double").withColumn("s", F.lit("a"))
    assert [r["median"] for r in H.smoothed_meter(df, ["s"], "t", "v").orderBy("t").collect()] == [1.0, 1.0]


def test_early_stop_follows_adaptive_patience(spark):
    scores = [0.1, 0.5] + [0.4] * 70
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "run string, step int, score double")
    row = H.early_stop(df, ["run"]).first()
    assert (row["stop_step"], row["best_step"], row["best_score"]) == (51, 1, 0.5)
    rising = df.withColumn("score", F.col("step").cast("double"))
    row = H.early_stop(rising, ["run"]).first()
    assert (row["stop_step"], row["best_step"]) == (None, 71)


def test_best_step_earliest_on_ties(spark):
    df = spark.createDataFrame([("r", 3, 1.0), ("r", 1, 1.0), ("r", 2, 0.5)], "run string, step int, score double")
    assert H.best_step(df, ["run"]).first()["best_step"] == 1


def test_running_centre_blocks(spark):
    df = spark.range(900).select(F.lit("d").alias("d"), F.col("id").alias("b"), (F.col("id") % 13).cast("double").alias("v"))
    got = [r["centre"] for r in H.running_centre(df, ["d"], "b", "v", block_rows=450).orderBy("b").collect()]
    c, expect = 0.0, []
    for i in range(900):
        c = c * 0.9 + (i % 13) * 0.1
        expect.append(c)
    assert np.allclose(got, expect)


def test_order_statistics_cut_buckets_again(spark):
    """Buckets above the limit are cut in further levels; frequent values, ties and values that are not finite included."""
    values = [float((i * 7919) % 5000) for i in range(6000)] + [17.5] * 3000 + [-1e300, 1e300, float("nan"), float("inf"), None] * 3
    df = spark.createDataFrame([(v, None if v is None else -v) for v in values], "a double, b double").repartition(5)
    finite = sorted(v for v in values if v is not None and math.isfinite(v))
    ranks = [0, 1, 2, 3, 4, 77, 2500, 4000, 8999, 9003, len(finite) - 1, len(finite)]
    expected = {r: finite[r] for r in ranks if r < len(finite)}
    calls = []
    for limit in (1, 40, 10**6):
        got = O.order_statistics(df, {"a": ranks, "b": lambda n: [n - 1 - r for r in ranks if r < n]}, bucket_rows=limit)
        assert got["a"] == (len(finite), expected)
        assert got["b"] == (len(finite), {len(finite) - 1 - r: -v for r, v in expected.items()})
    refined = O._refined

    def counted(*args):
        calls.append(args)
        return refined(*args)
    O._refined = counted
    try:
        one = spark.range(200_000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
        assert O.order_statistics(one, {"v": [0, 123_456, 199_999]}, bucket_rows=3)["v"][1] == {r: float(r * r) for r in (0, 123_456, 199_999)}
    finally:
        O._refined = refined
    assert len(calls) >= 2


def test_long_hash_prefixes_are_counted_in_levels(spark):
    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("g"))
    order = sorted((r["h"], r["id"]) for r in df.collect())
    place = {i: k + 1 for k, (_, i) in enumerate(order)}
    for digits in (2, 4, 5, 9):
        assert {r["id"]: r["r"] for r in O.hash_rank(df, "h", "r", digits=digits).collect()} == place
        wanted = spark.createDataFrame([(0,), (1,), (1500,), (3000,)], "rank long")
        got = {r["rank"]: r["threshold"] for r in O.hash_thresholds(df, "h", wanted, digits=digits).collect()}
        assert got == {0: "", 1: order[0][0], 1500: order[1499][0], 3000: order[-1][0]}
        by = spark.createDataFrame([(g, 1000) for g in range(3)], "g long, rank long")
        got = {r["g"]: r["threshold"] for r in O.hash_thresholds(df, "h", by, ["g"], digits=digits).collect()}
        assert got == {g: max(h for h, i in order if i % 3 == g) for g in range(3)}
