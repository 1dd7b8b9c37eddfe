from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import reshape as R
from tabwright.operators.fitted import Chain, Fitted
from tabwright.plans import ensemble as G, steps as S


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(2000).select(
        F.col("id").alias("key"), F.exp(F.randn(3)).alias("skewed"), (F.randn(4) * 3 + 1).alias("normal"),
        F.when(F.col("id") % 3 == 0, 2.0).otherwise(F.rand(5)).alias("hot"), (F.col("id") % 5).cast("double").alias("cat")).persist()


def column(df, c):
    return np.array([r[c] for r in df.orderBy("key").select(c).collect()], dtype=float)


def test_kdi_close_to_direct_smoothing(data):
    x = column(data, "normal")
    out = column(R.fit_kdi(data, ["normal"], 0.5).transform(data), "normal")
    h = 0.5 * x.std(ddof=1)
    cdf = np.array([np.mean([0.5 * math.erfc((xi - v) / h / math.sqrt(2)) for xi in x]) for v in x[:200]])
    lo = np.mean([0.5 * math.erfc((xi - x.min()) / h / math.sqrt(2)) for xi in x])
    hi = np.mean([0.5 * math.erfc((xi - x.max()) / h / math.sqrt(2)) for xi in x])
    assert np.abs((cdf - lo) / (hi - lo) - out[:200]).max() < 2e-3
    assert out.min() == 0 and out.max() == 1


def test_kdi_keeps_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "x double")
    assert [r["x"] is None for r in R.fit_kdi(df, ["x"]).transform(df).collect()] == [False, False, True, False]


def test_quantile_transform_of_tied_value_is_its_middle(data):
    out = R.fit_quantile(data, ["hot"], 101).transform(data)
    x, y = column(data, "hot"), column(out, "hot")
    assert set(y[x == 2.0]) == {1.0}  # the hot value is also the largest
    other = R.fit_quantile(data.withColumn("hot", F.when(F.col("hot") == 2, 0.5).otherwise(F.col("hot"))), ["hot"], 101)
    hit = other.transform(data.limit(1).withColumn("hot", F.lit(0.5))).first()["hot"]
    assert 0.45 < hit < 0.55


def test_quantile_normal_is_clipped(data):
    out = column(R.fit_named(data, ["skewed"], "quantile_norm").transform(data), "skewed")
    assert np.isclose(out.min(), -R.PROBIT_CLIP) and np.isclose(out.max(), R.PROBIT_CLIP)


def test_power_has_unit_variance_and_lowers_skew(data):
    fitted = Fitted.from_json(R.fit_power(data, ["skewed"]).to_json())
    y = column(fitted.transform(data), "skewed")
    assert abs(y.mean()) < 1e-9 and abs(y.var() - 1) < 1e-9
    x = column(data, "skewed")
    assert abs(((y - y.mean()) ** 3).mean()) < abs((((x - x.mean()) / x.std()) ** 3).mean())


def test_power_expression_forms_agree(spark):
    df = spark.createDataFrame([(x, l) for x in (-3.0, -0.5, 0.0, 2.5) for l in (-1.0, 0.0, 0.7, 2.0)], "x double, l double")
    x, lam = F.col("x"), F.col("l")
    out = df.select(R.power_expr(x, lam, "yeo-johnson").alias("a"),
                    R._power_of_log(x, F.log1p(F.abs(x)), lam, "yeo-johnson").alias("b")).collect()
    assert all(math.isclose(r["a"], r["b"], abs_tol=1e-12) for r in out)


def test_safe_power_leaves_a_constant_column(spark):
    df = spark.range(10).select(F.lit(4.0).alias("c"))
    assert R.fit_power(df, ["c"], safe=True).params["c"] == [None, 0.0, 1.0]


def test_power_exponents_have_no_bounds(spark):
    from statistics import NormalDist
    z = np.array([3 + 0.3 * NormalDist().inv_cdf((i + 0.5) / 500) for i in range(500)])
    # the exponents 5, -4 and 30 bring the bell back
    data = {"five": z ** (1 / 5) - 1, "minus": (z / 10) ** (-1 / 4) - 1, "thirty": z ** (1 / 30) - 1}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], list(data))
    params = R.fit_power(df, list(data)).params
    for c, x in data.items():
        grid = [k / 100 for k in range(-5000, 5001) if k]
        ll = [-len(x) / 2 * math.log(((x + 1) ** k / k).var()) + (k - 1) * np.log1p(x).sum() for k in grid]
        best = grid[int(np.argmax(ll))]
        assert abs(best) > 2.1 and math.isclose(params[c][0], best, abs_tol=0.011), (c, params[c], best)
    # Box-Cox after min-max: a column pressed against its maximum
    steep = spark.createDataFrame([(float(((i + 0.5) / 500) ** 0.1),) for i in range(500)], "x double")
    assert R.fit_box_cox(steep, ["x"]).steps[1].params["x"][0] > 2.2


def test_svd_matches_numpy(data):
    cols = ["skewed", "normal", "hot", "cat"]
    fitted = R.fit_svd(data, cols)
    out = fitted.transform(data)
    x = np.stack([column(data, c) for c in cols], axis=1)
    x = x / x.std(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    for j, name in enumerate(fitted.names()):
        got, want = column(out, name), u[:, j] * s[j]
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert len(fitted.names()) == 2 and R.fit_svd(data, ["hot"]) is None


def test_pca_is_centred_and_orthogonal(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda x: x + 3))
    rows = R.fit_pca(df, "embedding", 4).transform(df).collect()
    z = np.array([r["pca"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    assert np.allclose(z.mean(axis=0), 0, atol=1e-6)
    top = np.linalg.eigvalsh(np.cov(x.T))[::-1][:4]
    assert np.allclose(z.var(axis=0, ddof=1), top, rtol=1e-6)


def test_soft_clip_order(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1000.0,), (-1000.0,)], "x double")
    clip = R.SoftClip({"x": [-1.0, 1.0]})
    assert [round(r["x"], 6) for r in clip.transform(df).collect()] == [
        0.0, 0.0, round(1 + math.log1p(1000), 6), round(-1 - math.log1p(1000), 6)]


def test_quantile_bins_outside_is_null(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    fitted = R.fit_quantile_bins(df, "x", 2)
    assert [r["x_bin"] for r in fitted.transform(df).collect()] == [None, 0, 0, 1, 1]


def test_bucket_borders_need_rows(spark):
    df = spark.range(4).select(F.col("id").cast("double").alias("y"), "id")
    assert R.bucket_borders(df, "y", 2, key="id") == [0.0, 1.5, 3.0]
    assert R.bucket_borders(df, "y", 2, key="id", widen=2.0) == [0.0, 3.0, 6.0]
    with pytest.raises(ValueError, match="too few"):
        R.bucket_borders(df, "y", 4)


def test_unknown_and_undefined_names(data):
    with pytest.raises(ValueError, match="fixed bandwidth"):
        R.fit_named(data, ["hot"], "kdi_random_alpha")
    with pytest.raises(ValueError, match="unknown transform"):
        R.fit_named(data, ["hot"], "nope")


@pytest.mark.parametrize("name", ["none", "power", "safepower", "power_box", "safepower_box", "log", "1_plus_log", "exp", "robust",
                                  "quantile_uni_coarse", "quantile_norm_coarse", "quantile_uni", "quantile_uni_fine", "kdi",
                                  "kdi_alpha_0.3_uni", "norm_and_kdi", "adaptive"])
def test_named_transforms_do_not_depend_on_partitioning(data, name):
    cols = ["skewed", "hot"]
    fitted = R.fit_named(data, cols, name, key="key")
    again = R.fit_named(data.repartition(7), cols, name, key="key")
    names = fitted.names() if isinstance(fitted, R.Union) else cols
    a, b = fitted.transform(data), Fitted.from_json(again.to_json()).transform(data.repartition(5))
    for c in names:
        assert np.allclose(column(a, c), column(b, c), equal_nan=True, atol=1e-9)


def test_adaptive_applies_by_class(data):
    shapes = R.column_shape(data, ["skewed", "normal", "cat"], "key")
    assert shapes["normal"] == "normal" and shapes["cat"] == "ordinal"
    out = R.fit_adaptive(data, ["normal", "cat"], "key").transform(data)
    assert np.allclose(column(out, "normal"), column(data, "normal"))


def test_column_shape_reads_all_rows(spark):
    from statistics import NormalDist
    n, inv = 20_000, NormalDist().inv_cdf
    scores = np.array([inv((i + 1 - 0.375) / (n + 0.25)) for i in range(n)])
    # two far values that a sample of 3,000 rows misses, and one value held by a third of the rows
    far = [(-1.0) ** i * 40 if i in (1, 2) else float(scores[i]) for i in range(n)]
    tied = [0.0 if i % 3 == 0 else float(scores[i]) for i in range(n)]
    df = spark.createDataFrame([(i, far[i], tied[i], None) for i in range(n)], "key long, far double, tied double, empty double")
    got = R._normality(df, ["empty", "far", "tied"])
    assert got["empty"] == 0.0
    for c, x in {"far": far, "tied": tied}.items():
        assert math.isclose(got[c], np.corrcoef(np.sort(x), scores)[0, 1] ** 2, rel_tol=1e-6)
    assert got["far"] < 0.95
    assert R.column_shape(df, ["far"], "key") == {"far": "other"}


def test_steps_append_svd_and_shuffled_order(data):
    cfg = S.PrepConfig("quantile_uni_coarse", "ordinal_very_common_categories_shuffled", True, -1, "svd")
    fitted = S.fit_features(data, ["skewed", "hot", "cat"], ["cat"], cfg, S.StepOptions(shift=1), key="key")
    assert sorted(fitted.columns) == sorted(["skewed", "hot", "cat", "skewed__t", "hot__t", "svd_0", "svd_1", "fingerprint"])
    assert fitted.categorical == ["cat"]
    again = Fitted.from_json(fitted.to_json())
    a, b = fitted.select(data, ["key"]), again.select(data.repartition(3), ["key"])
    assert a.columns == b.columns == ["key", *fitted.columns]
    for c in fitted.columns:
        assert np.allclose(column(a, c), column(b, c))


def test_feature_subsample_repeats_columns(data):
    cfg = S.PrepConfig("none", "numeric", subsample_features=1.5)
    fitted = S.fit_features(data, ["skewed", "hot"], [], cfg, S.StepOptions(fingerprint=False, order=None))
    assert len(fitted.columns) == 4 and fitted.select(data, []).columns == fitted.columns
    cut = S.fit_features(data, ["skewed", "hot", "normal"], [], S.PrepConfig(subsample_features=0.4), S.StepOptions(fingerprint=False))
    assert len(cut.columns) == 2


def test_feature_order():
    assert S.feature_order("abcd", "rotate", 1) == ["d", "a", "b", "c"]
    assert S.feature_order("abcd", None, 1) == list("abcd")
    assert sorted(S.feature_order("abcd", "shuffle", 1, 2)) == list("abcd")


def test_member_plans_are_balanced():
    members = G.plan_members("classification", 8, 3, seed=1)
    assert [m.config for m in members].count(G.CLASSIFICATION[0]) == 4
    assert len({m.options.shift for m in members}) == 8
    assert all(sorted(m.permutation) == [0, 1, 2] for m in members)
    assert len({m.permutation for m in members}) == 6
    reg = G.plan_members("regression", 8)
    assert len({(m.config, m.target_transform) for m in reg}) == 4
    assert {m.permutation for m in G.plan_members("classification", 3, 4, class_shift="rotate")} <= {
        (0, 1, 2, 3), (1, 2, 3, 0), (2, 3, 0, 1), (3, 0, 1, 2)}


def test_ensemble_shares_fits_and_subsamples(data):
    members = G.plan_members("classification", 4, 5, [S.PrepConfig("robust"), S.PrepConfig("none")], seed=2)
    fitted = G.fit_ensemble(data, "key", ["skewed", "hot"], [], members)
    assert fitted.samples is None and len(set(fitted.shared.values())) == 2
    long = fitted.features(data, "key", "cat", train=True)
    assert long.count() == 4 * 2000 and long.select(F.size("features")).distinct().collect()[0][0] == 3
    perm = members[0].permutation
    pair = long.where("member = 0").join(data.select("key", "cat"), "key").select("target", "cat").distinct().collect()
    assert {(int(r["cat"]), int(r["target"])) for r in pair} == set(enumerate(perm))
    part = G.ensemble_features(data, "key", ["skewed"], [], "classification", n=2, classes=5,
                               configs=[S.PrepConfig("robust")], subsample_size=100)
    assert {r["member"]: r["count"] for r in part.groupBy("member").count().collect()} == {0: 100, 1: 100}


def test_regression_targets_are_transformed(data):
    out = G.ensemble_features(data, "key", ["normal", "cat"], ["cat"], "regression", target="skewed", n=4)
    stats = {r["member"]: (r["m"], r["s"]) for r in out.groupBy("member").agg(
        F.avg("target").alias("m"), F.stddev_pop("target").alias("s")).collect()}
    assert sum(abs(m) < 1e-6 and abs(s - 1) < 1e-6 for m, s in stats.values()) == 2


# ---- many knots, normality by runs ---------------------------------------------

def test_as_of_join(spark):
    from tabwright.operators import ordered as O
    rng = np.random.default_rng(3)
    values = np.unique(np.round(rng.normal(size=700), 2))
    keys = np.unique(np.concatenate([np.round(rng.normal(size=300) * 2, 3), values[:50], [-99.0, 99.0]]))
    table = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, place int").repartition(4)
    found = O.as_of(spark.createDataFrame([(float(k),) for k in keys], "k double"), "k", table, "v").collect()
    assert len(found) == len(keys)
    for r in found:
        at = int(np.searchsorted(values, r["k"], "right"))
        assert (r["prev"] and r["prev"]["place"]) == (at - 1 if at else None)
        assert (r["next"] and r["next"]["place"]) == (at if at < len(values) else None)
    assert O.as_of(spark.createDataFrame([(1.0,)], "k double"), "k", table.where("false"), "v").first()["prev"] is None
    given = O.as_of(spark.createDataFrame([(float(k),) for k in keys], "k double"), "k", table, "v", [-0.5, 0.1, 40.0])
    assert sorted(map(str, given.collect())) == sorted(map(str, found))


def plain_quantile_map(train, x, m):
    """Both-sided interpolation between exact quantiles."""
    train = np.sort(train)
    at = np.arange(m) * (len(train) - 1) / (m - 1)
    knots, levels = np.interp(at, np.arange(len(train)), train), np.linspace(0, 1, m)
    out = (np.interp(x, knots, levels) - np.interp(-x, -knots[::-1], -levels[::-1])) / 2
    return np.where(x <= knots[0], 0, np.where(x >= knots[-1], 1, out))


@pytest.mark.parametrize("share", [1, 2, 5])
def test_written_knots_are_those_of_plain_quantiles(spark, monkeypatch, share):
    monkeypatch.setattr(R, "INLINE_KNOTS", 10)
    rng = np.random.default_rng(share)
    a = np.round(rng.normal(size=900), 1)
    a[::3] = 0.5                                        # a third of all rows have one value
    b = np.exp(rng.normal(size=900))
    rows = [(float(x), float(y), 7.0) for x, y in zip(a, b)] + [(None, float("nan"), 7.0), (float("inf"), None, 7.0)]
    train = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    fitted = R.fit_quantile(train, ["a", "b", "c"], lambda n: max(n // share, 2))
    assert set(fitted.tables) == {"a", "b", "c"} and fitted.per_batch and Chain([fitted]).per_batch
    again = Fitted.from_json(fitted.to_json())
    asked = np.concatenate([a, rng.normal(size=50), [-100, 100]])
    other = np.resize(np.concatenate([b, rng.normal(size=50)]), len(asked))
    df = spark.createDataFrame([(i, float(x), float(y), 7.0) for i, (x, y) in enumerate(zip(asked, other))], "i int, a double, b double, c double")
    got = again.transform(df).orderBy("i").collect()
    assert np.allclose([r["a"] for r in got], plain_quantile_map(a, asked, max(len(a) // share, 2)), atol=1e-9)
    assert np.allclose([r["b"] for r in got], plain_quantile_map(b, other, max(len(b) // share, 2)), atol=1e-9)
    assert {r["c"] for r in got} == {0.0}
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),)], "a double")
    one = R.KnotMap({}, False, {"a": fitted.tables["a"]})
    assert [r["a"] for r in one.transform(odd).collect()] == [None, 1.0, 0.0]


def test_written_knots_on_a_stream(spark, monkeypatch, tmp_path):
    from tabwright.streaming import apply as A
    monkeypatch.setattr(R, "INLINE_KNOTS", 3)
    rows = spark.range(40).select("id", (F.col("id") * F.col("id")).cast("double").alias("x"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    fitted = R.fit_quantile(rows, ["x"], lambda n: n)
    stream = A.read_files(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    A.apply_fitted(stream, fitted, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r["id"], round(r["x"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(i, round(i / 39, 9)) for i in range(40)]


def test_sums_of_normal_scores(spark):
    from statistics import NormalDist
    for n in (5, 40, 3000):
        score = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        runs = [(a, b) for a in (1, 2, 5, 9, 30, n // 2, n - 3, n) for b in (1, 4, 8, 9, 20, n // 2 + 1, n - 9, n - 1, n) if 1 <= a <= b <= n]
        df = spark.createDataFrame(runs, "a long, b long").withColumn("s", R._score_sum(F.col("a"), F.col("b"), F.lit(n).cast("long")))
        for r in df.collect():
            assert abs(r["s"] - sum(score[r["a"] - 1:r["b"]])) < 2e-4
        assert abs(R._score_squares(n, 500) - sum(z * z for z in score)) < 1e-3


def test_shapes_follow_all_rows(spark):
    """Rare far values decide the shape of a column whose bulk is normal; ties are runs."""
    from statistics import NormalDist
    n = 4000
    bell = [round(NormalDist().inv_cdf((i + 0.5) / n), 1) for i in range(n)]
    tails = [v * (2000 if i % 997 == 0 else 1) * (-1) ** (i // 997) for i, v in enumerate(bell)]
    df = spark.createDataFrame([(a, b, float(i % 7), float("nan") if i % 2 else None) for i, (a, b) in enumerate(zip(bell, tails))],
                               "bell double, tails double, few double, none double")
    assert R.column_shape(df, ["bell", "tails", "few", "none"]) == {"bell": "normal", "tails": "other", "few": "ordinal", "none": "ordinal"}


# ---- kernel CDF with far values, wide tables ------------------------------------

@pytest.mark.parametrize("alpha", [0.05, 0.5, 2.0])
def test_kernel_cdf_of_a_heavy_tail(spark, alpha):
    """Within 1e-3 of the exact kernel sum everywhere, however far some values lie."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=1500), np.repeat(0.25, 700), [4e3, -2e4, 5e5], rng.standard_cauchy(300) * 10])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    h = alpha * x.std(ddof=1)
    exact = lambda at: np.array([R._normal_cdf((v - x) / h).mean() for v in at])
    ends = exact([x.min(), x.max()])
    asked = np.unique(np.concatenate([x[:200], x[-305:], np.linspace(-3 * h, 3 * h, 200), rng.uniform(x.min(), x.max(), 100)]))
    asked = asked[(asked > x.min()) & (asked < x.max())]
    got = R.fit_kdi(df, ["x"], alpha).transform(spark.createDataFrame([(float(v), float(v)) for v in asked], "at double, x double"))
    got = np.array([r["x"] for r in got.orderBy("at").collect()])
    assert np.abs(got - (exact(asked) - ends[0]) / (ends[1] - ends[0])).max() < 1e-3


def test_range_vectors_of_a_wide_table(spark, monkeypatch):
    """1,000 columns without their Gram matrix or an expression per term."""
    rng = np.random.default_rng(6)
    n, f, k = 150, 1000, 4
    x = rng.normal(size=(n, 6)) * [9, 7, 5, 3, 1, 0.5] @ rng.normal(size=(6, f)) + 0.01 * rng.normal(size=(n, f))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>")
    vectors = R.range_vectors(df, F.col("v"), f, k)
    exact = np.linalg.svd(x, full_matrices=False)[2][:k]
    assert np.allclose(np.abs(vectors.T @ exact.T), np.eye(k), atol=1e-6)
    monkeypatch.setattr(R, "GRAM_WIDTH", 100)
    wide = df.select("i", *[F.col("v")[j].alias(f"c{j}") for j in range(200)])
    fitted = R.fit_svd(wide, [f"c{j}" for j in range(200)], 3)
    assert len(fitted.cols) * len(fitted.loadings) > R.PRODUCT_TERMS
    got = np.array([list(r)[1:] for r in fitted.transform(wide).select("i", *fitted.names()).orderBy("i").collect()])
    a = x[:, :200]
    a = a / np.sqrt(a.var(axis=0))
    scores = a @ np.linalg.svd(a, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(scores), rtol=1e-5, atol=1e-5)


def test_products_equal_expressions(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [tuple(float(v) for v in r) for r in rng.normal(size=(40, 5))] + [(None, float("nan"), 1.0, 2.0, float("inf"))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    fitted = R.fit_svd(df, list("abcde"), 2)
    written_out = [tuple(r) for r in fitted.transform(df).select(*fitted.names()).collect()]
    monkeypatch.setattr(R, "PRODUCT_TERMS", 0)
    assert np.allclose([tuple(r) for r in fitted.transform(df).select(*fitted.names()).collect()], written_out)


def test_knot_maps_of_odd_values_run_on_batches(spark):
    """Levels of nulls, NaN, infinities, knots and values between; no column becomes an expression of its own."""
    knots = R.KnotMap({"x": [[0.0, 1.0, 4.0], [0.0, 0.25, 1.0], [0.0, 0.5, 1.0]]})
    values = [None, float("nan"), -math.inf, math.inf, -1.0, 0.0, 0.5, 1.0, 2.5, 4.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.x for r in knots.transform(df).orderBy("i").collect()]
    assert got == [None, 1.0, 0.0, 1.0, 0.0, 0.0, 0.125, 0.375, 0.75, 1.0]
    normal = [r.x for r in R.KnotMap(knots.knots, True).transform(df).orderBy("i").collect()]
    assert normal[0] is None and normal[1] == -normal[4] == R.PROBIT_CLIP
    assert math.isclose(normal[8], NormalDist().inv_cdf(0.75), abs_tol=1e-8)
    assert "ArrowEvalPython" in knots.transform(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("method", ["yeo-johnson", "box-cox"])
def test_power_profiles_are_merged_over_batches(spark, method):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(size=400), np.repeat(1e6, 30)] + ([-rng.lognormal(size=70)] if method != "box-cox" else []))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.inf,)], "x double").repartition(5)
    lams = [-2.0, 0.0, 0.5, 2.0]
    got = R._power_profile(df, ["x"], {"x": lams}, method)["x"]
    for lam in lams:
        def one(v):
            if method == "box-cox":
                return math.log(v) if lam == 0 else (v ** lam - 1) / lam
            if v >= 0:
                return math.log1p(v) if lam == 0 else ((v + 1) ** lam - 1) / lam
            return -math.log1p(-v) if lam == 2 else -((1 - v) ** (2 - lam) - 1) / (2 - lam)
        y = np.array([one(v) for v in x])
        log = np.sign(x) * np.log1p(np.abs(x)) if method != "box-cox" else np.log(x)
        ll = -len(x) / 2 * np.log(y.var()) + (lam - 1) * log.sum()
        assert np.allclose(got[lam], (ll, y.mean(), y.std(), y.max()), rtol=1e-8)


def test_many_knots_on_few_values_are_literals(spark, monkeypatch):
    rows = spark.range(12_000).select((F.pmod(F.xxhash64("id"), F.lit(7)) * 1.5).alias("x"), F.rand(3).alias("y"))
    probe = spark.createDataFrame([(v / 4, 0.5) for v in range(-4, 44)] + [(None, None)], "x double, y double")
    fitted = R.fit_quantile(rows, ["x", "y"], lambda n: n // 2)
    assert set(fitted.knots) == {"x"} and set(fitted.tables) == {"y"}
    monkeypatch.setattr(R, "_few_knots", lambda df, tables: {})
    joined = R.fit_quantile(rows, ["x", "y"], lambda n: n // 2)
    assert set(joined.tables) == {"x", "y"}
    key = lambda r: (r.x is not None, r.x)
    got, want = (sorted(f.transform(probe).collect(), key=key) for f in (fitted, joined))
    assert [r.x for r in got] == pytest.approx([r.x for r in want], abs=1e-12)


def test_knots_in_files_give_the_joined_levels_without_moving_rows(spark, monkeypatch):
    """Several files per column, values on, between and beyond knots; the joined map is the one before."""
    monkeypatch.setattr(R, "INLINE_KNOTS", 10)
    monkeypatch.setattr(R, "PIECE_KNOTS", 60)
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(size=700), 2), np.exp(rng.normal(size=700))
    a[::4] = 0.25
    train = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.25, float(a.min()), float(a.max()), 1e-300]
    asked = [*odd, *a.tolist(), *rng.normal(size=200).tolist()]
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(asked)], "i int, a double, b double")
    for output in ("uniform", "normal"):
        fitted = Fitted.from_json(R.fit_quantile(train, ["a", "b"], lambda n: n // 2, output).to_json())
        assert set(fitted.tables) == {"a", "b"} and fitted.per_row
        pieces, firsts = R._knot_pieces(fitted.tables["b"][5], fitted.tables["b"][1])
        assert len(pieces) > 2 and (np.diff(firsts[:, 0]) > 0).all()
        joined = R.KnotMap(fitted.knots, fitted.normal, {c: t[:5] for c, t in fitted.tables.items()})
        assert not joined.per_row
        out = fitted.transform(df)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        same = [tuple(r) for r in joined.transform(df).orderBy("i").collect()]
        assert [repr(tuple(r)) for r in out.orderBy("i").collect()] == [repr(r) for r in same]


def test_prepared_training_rows_are_not_written(spark, monkeypatch, tmp_path):
    """Numbering copies moves the given columns and prepares rows again; values are those of rows prepared once."""
    from tabwright.operators import features as X
    monkeypatch.setattr(R, "INLINE_KNOTS", 10)
    rows = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("key"), (F.col("id") % 70).cast("double").alias("x"),
                                   (F.col("id") % 2).cast("double").alias("y")).repartition(3)
    fitted = S.fit_features(rows, ["x", "y"], ["y"], S.PrepConfig("quantile_uni", "ordinal"), S.StepOptions(seed=1))
    assert R.KnotMap in {type(s) for s in Chain(fitted.steps).steps} | {type(s) for step in fitted.steps for s in getattr(step, "steps", [])}
    made = []
    monkeypatch.setattr(S, "written", lambda df, name: made.append(name) or df)
    got = fitted.select(rows, ["key"], "key")
    plain = fitted.fingerprint.transform_train(Chain(fitted.steps).transform(rows), "key").select("key", *fitted.columns)
    assert made == [] and sorted(got.collect()) == sorted(plain.collect())
    monkeypatch.setattr(X, "COPIES_AT_ONCE", 3)
    assert sorted(fitted.select(rows, ["key"], "key").collect()) == sorted(plain.collect())


@pytest.mark.parametrize("at_once", [50_000, 5])
def test_members_share_one_move_of_training_rows(spark, monkeypatch, at_once):
    """Samples of repeated rows, in windows of a class or of its prefixes; rows are those of members moved one by one."""
    from tabwright.operators import features as X
    monkeypatch.setattr(X, "COPIES_AT_ONCE", at_once)
    n = F.col("id") % 40
    rows = spark.range(600).select(F.md5(F.col("id").cast("string")).alias("key"), F.when(n < 20, 3.0).otherwise(n).alias("x"),
                                   F.when(n > 37, None).otherwise(n % 2).cast("double").alias("c"), (F.col("id") % 90).cast("double").alias("y"))
    rows = rows.repartition(3).localCheckpoint()
    members = G.plan_members("regression", 4, seed=2)
    fitted = G.fit_ensemble(rows, "key", ["x", "c"], ["c"], members, "y", 0.5, 2)
    moved = fitted.features(rows, "key", "y", train=True)
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    monkeypatch.setattr(G, "numbered_by_class", lambda *a: None)
    monkeypatch.setattr(X, "numbered_by_class", lambda *a: None)
    one_by_one = fitted.features(rows, "key", "y", train=True)
    assert moved.columns == one_by_one.columns and sorted(map(str, moved.collect())) == sorted(map(str, one_by_one.collect()))


def test_classes_that_are_prepared_alike_are_not_numbered_apart(spark):
    """A map that joins different rows, or rows that mostly differ, leave copies to the prepared rows."""
    from tabwright.operators import features as X
    rows = spark.range(200).select(F.md5(F.col("id").cast("string")).alias("key"), (F.col("id") % 10).cast("double").alias("x"))
    mark = X.Fingerprint(["h"], 1)
    apart, alike = (lambda d: d.withColumn("h", F.col("x") * 2)), (lambda d: d.withColumn("h", F.floor(F.col("x") / 2)))
    assert X.numbered_by_class(rows, "key", ["x"], [F.lit(True)], [(apart, mark)]) is not None
    assert X.numbered_by_class(rows, "key", ["x"], [F.lit(True)], [(apart, mark), (alike, mark)]) is None
    assert X.numbered_by_class(rows, "key", ["key"], [F.lit(True)], [(apart, mark)]) is None
    numbered, back = X.numbered_by_class(rows, "key", ["x"], [F.lit(True)], [(apart, mark)])
    got = mark.of_copy(apart(numbered.withColumns(back)), "_copy_0").select("key", "x", "fingerprint")
    assert sorted(got.collect()) == sorted(mark.transform_train(apart(rows), "key").select("key", "x", "fingerprint").collect())
