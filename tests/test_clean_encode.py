from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabwright.operators import clean as C, encode as E, features as X, joins as J
from tabwright.operators.fitted import Fitted


def test_sentinel_fit_on_train_and_empty_column(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    fitted = C.fit_sentinel(train, ["a", "b"])
    test = spark.createDataFrame([(None, None), (-9.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in fitted.transform(test).collect()] == [(0.0, -1.0), (-9.0, 2.0)]


def test_missing_indicator_tells_infinities_apart(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (5.0,)], "x double")
    assert [r["x_missing"] for r in C.missing_indicator(df, ["x"]).collect()] == [-2, -2, 2, 4, 0]
    assert [r["x"] for r in C.finite(df, ["x"]).collect()] == [None, None, None, None, 5.0]


def test_last_year_and_casts(spark):
    df = spark.createDataFrame([("born 1999, died 2020 x",), ("no year",), (None,)], "t string")
    assert [r[0] for r in df.select(C.last_year(F.col("t"))).collect()] == [2020, None, None]
    pct = spark.createDataFrame([("95%",), ("n/a",)], "t string")
    assert [r[0] for r in pct.select(C.strip_cast(F.col("t"), "%")).collect()] == [95, None]


def test_normalise_types_refuses_dates(spark):
    with pytest.raises(ValueError, match="not supported"):
        C.normalise_types(spark.sql("select current_date() d"))


def test_onehot_to_label_takes_first_flag(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(C.onehot_to_label(["a", "b"])).collect()] == ["a", "b", None]


def test_codes_strict_unknown_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r[0] for r in E.fit_codes(train, ["c"], unknown=-1).transform(test).collect()] == [0.0, -1.0, None]
    assert [r[0] for r in E.fit_codes(train, ["c"], unknown=None).transform(test).collect()] == [0.0, None, None]
    with pytest.raises(Exception, match="unknown value"):
        E.fit_codes(train, ["c"]).transform(test).collect()


def test_numeric_labels_sort_as_numbers_and_round_trip(spark):
    df = spark.createDataFrame([(10,), (2,), (1,)], "y int")
    fitted = Fitted.from_json(E.fit_label(df, "y", "_c").to_json())
    coded = fitted.transform(df)
    assert {(r["y"], r["y_c"]) for r in coded.collect()} == {(1, 0.0), (2, 1.0), (10, 2.0)}
    assert {(r["y"], r["back"]) for r in fitted.inverse(coded, "y", "back", "int").collect()} == {(1, 1), (2, 2), (10, 10)}


def test_large_vocabulary_matches_small(spark):
    df = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 173).alias("c"))
    small = E.fit_codes(df, ["c"], suffix="_k").transform(df).distinct()
    large = E.fit_codes(df, ["c"], suffix="_k", limit=10).transform(df).distinct()
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.count() == 173
    shuffled = [E.fit_codes(df, ["c"], suffix="_k", shuffle_seed=4, limit=n).transform(df).distinct() for n in (10, 1000)]
    assert sorted(shuffled[0].collect()) == sorted(shuffled[1].collect())


def test_gate_leaves_rare_columns(spark):
    df = spark.range(400).select((F.col("id") % 4).cast("string").alias("often"), F.col("id").cast("string").alias("once"))
    assert list(E.fit_codes(df, ["often", "once"], gate="common").values) == ["often"]


def test_one_hot_guard_and_binary(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "q"), ("z", "p")], "a string, b string")
    fitted = E.fit_onehot(df, ["a", "b"])
    assert fitted.names() == ["a=x", "a=y", "a=z", "b=q"]
    unseen = spark.createDataFrame([("new", "q")], "a string, b string")
    assert tuple(fitted.transform(unseen).first()) == (0, 0, 0, 1)
    assert E.fit_onehot(df, ["a", "b"], max_cells=10) is None


def test_infer_categorical_rules(spark):
    df = spark.range(101).select((F.col("id") % 3).alias("few"), (F.col("id") % 31).alias("listed31"),
                                 (F.col("id") % 30).alias("listed30"), F.col("id").alias("many"))
    assert E.infer_categorical(df, df.columns, ["listed31", "listed30"]) == ["few", "listed30"]
    assert E.infer_categorical(df.limit(100), ["few"]) == []


def test_target_rank_large_equals_small(spark):
    train = spark.createDataFrame([(1.0,), (5.0,), (5.0,), (7.0,)], "y double")
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (5.0,), (9.0,), (None,)], "y double")
    small = {r["y"]: r["r"] for r in E.fit_target_rank(train, "y", "r").transform(df).collect()}
    large = {r["y"]: r["r"] for r in E.rank_against(df, train, "y", "r").collect()}
    assert small == large == {0.0: 0, 1.0: 0, 3.0: 1, 5.0: 1, 9.0: 3, None: None}


def test_class_permutation_and_inverse(spark):
    df = spark.createDataFrame([(0, [0.5, 0.3, 0.2])], "y int, p array<double>")
    perm = F.array(F.lit(2), F.lit(0), F.lit(1))
    row = df.select(E.permute_class(F.col("y"), perm), E.unpermute_probs(F.col("p"), perm)).first()
    assert row[0] == 2 and row[1] == [0.2, 0.5, 0.3]


def test_ngrams_words_of_two_letters(spark):
    df = spark.createDataFrame([("A bc de, bc de!",)], "t string")
    grams = df.select(E.ngrams(E.words("t"), 1, 3).alias("g")).first()["g"]
    assert grams == ["bc", "de", "bc", "de", "bc de", "de bc", "bc de", "bc de bc", "de bc de"]
    vocab = {r["gram"]: (r["df"], r["tf"]) for r in E.ngram_vocabulary(df, "t", min_df=1).collect()}
    assert vocab["bc de"] == (1, 2)


def test_constant_and_duplicate_columns(spark):
    df = spark.range(10).select(F.col("id").alias("a"), F.lit(1).alias("one"), F.when(F.col("id") > 3, 1).alias("gap"),
                                F.lit(None).cast("int").alias("none"), (F.col("id") * 3).alias("copy"))
    assert X.fit_drop_constant(df, df.columns).dropped == ["one", "none"]
    assert X.fit_drop_duplicate(df, ["a", "copy"]).dropped == ["copy"]
    with pytest.raises(ValueError, match="constant"):
        X.fit_drop_constant(df, ["one", "none"])


def test_fingerprints_tell_copies_apart_even_if_hot(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("x"))
    out = X.Fingerprint(["x"], 1).transform_train(df, "id")
    row = out.agg(F.countDistinct("fingerprint").alias("d"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).first()
    assert row["d"] == 900 and 0 <= row["a"] and row["b"] < 1
    again = X.Fingerprint(["x"], 1).transform_train(df.repartition(7), "id")
    assert sorted(out.collect()) == sorted(again.collect())


def test_crosses_are_capped_by_seed(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "a double, b double")
    assert len(X.fit_crosses(df, ["a", "b"]).pairs) == 3
    two = X.fit_crosses(df, ["a", "b"], max_features=2, seed=3)
    assert len(two.pairs) == 2 and two.pairs == X.fit_crosses(df, ["a", "b"], max_features=2, seed=3).pairs


def test_fixed_vector_groups(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    row = X.to_fixed_vector(df, ["a", "b", "c"], width=4, group=2, used=1).first()["vector"]
    assert row == [[2.0, 4.0], [6.0, 0.0]]
    assert X.group_positions(["a", "b", "c"], ["b", "c"], 2) == [[1], [0]]


def test_join_features_needs_unique_keys(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, x double")
    with pytest.raises(ValueError, match="more than once"):
        J.join_features(a, a.withColumnRenamed("x", "y"), "k")


def test_null_and_nan_are_one_category(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "x double")
    fitted = E.fit_onehot(df, ["x"])
    assert fitted.values == {"x": ["1", None]} and fitted.names() == ["x="]
    assert [r[0] for r in fitted.transform(df).collect()] == [0, 1, 1, 0]
    assert E.unique_counts(df, ["x"], 5) == (4, {"x": 2})
    assert sorted(r["feature"] for r in E.onehot_long(df.withColumn("k", F.lit(1)), "k", ["x"]).collect()) == ["x=1", "x=1"]


def test_a_number_has_one_text_whatever_its_type(spark):
    whole = spark.createDataFrame([(1,), (2,), (10,)], "x int")
    codes = E.fit_codes(whole, ["x"], unknown=-1)
    for kind in ("decimal(10,2)", "double", "bigint", "decimal(38,0)"):
        same = whole.select(F.col("x").cast(kind))
        assert [r["x"] for r in codes.transform(same).collect()] == [0.0, 1.0, 2.0]
    parts = spark.createDataFrame([("1.50",), ("0.05",), ("100.00",), (None,)], "t string")
    texts = [d.select(E.cell_text(d, "x").alias("s")) for d in (parts.select(F.col("t").cast(k).alias("x")) for k in ("decimal(10,4)", "double"))]
    assert [[r["s"] for r in t.collect()] for t in texts] == [["1.5", "0.05", "100", None]] * 2


def test_levels_of_ngrams_lose_none(spark):
    """The same as counting every n-gram, for any top, least number of texts and range of lengths."""
    import random
    rnd = random.Random(4)
    texts = [None, "", "a b c", "11 22"] + [" ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "Aa", "x", "é1"]) for _ in range(rnd.randrange(40)))
                                            for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    tokens = df.where("t is not null").select(E.words("t").alias("w"))
    for lo, hi, least, top in ((1, 3, 1, 10), (1, 3, 5, 300), (2, 3, 3, 12), (1, 1, 2, 4), (3, 3, 1, 1000), (1, 4, 2, 25)):
        found = E.ngram_vocabulary(df, "t", lo, hi, least, top).collect()
        assert found == E.all_ngrams(tokens, lo, hi, least, top).collect()


def test_many_words_fall_back_to_all_ngrams(spark, monkeypatch):
    df = spark.createDataFrame([("aa bb cc aa bb",), ("aa bb",)], "t string")
    expected = E.ngram_vocabulary(df, "t", min_df=1).collect()
    monkeypatch.setattr(E, "MOST_WORDS", 1)
    assert E.ngram_vocabulary(df, "t", min_df=1).collect() == expected


@pytest.mark.parametrize("block", [2, 1024])
def test_correlations_by_blocks(spark, block):
    import numpy as np
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 5)) + 1e4
    x[:, 3] = x[:, 0] * 2 + 1e-4 * x[:, 1]
    x[:, 4] = 7
    rows = [tuple(None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = X.correlations(df, list("abcde"), block)
    assert len(got) == 10
    for (p, q), value in got.items():
        both = [(r["abcde".index(p)], r["abcde".index(q)]) for r in rows]
        both = np.array([v for v in both if None not in v])
        if "e" in (p, q):
            assert value is None
        else:
            assert abs(value - np.corrcoef(both.T)[0, 1]) < 1e-9
    assert X.fit_drop_duplicate(df, list("abcd")).dropped == ["d"]


def test_many_targets_are_ranked_from_a_table(spark):
    values = [float((i * 37) % 101) / 4 for i in range(300)]
    train = spark.createDataFrame([(v,) for v in values] + [(None,)], "y double")
    asked = spark.createDataFrame([(float(i), v) for i, v in enumerate([*values[:40], -1.0, 1e9, 0.1, None])], "i double, y double")
    inline, written = E.fit_target_rank(train, "y", "r"), E.fit_target_rank(train, "y", "r", limit=10)
    assert inline.table is None and written.per_batch and written.targets == []
    again = Fitted.from_json(written.to_json())
    known = sorted(set(values))
    got = {r["i"]: r["r"] for r in again.transform(asked).collect()}
    assert got == {r["i"]: r["r"] for r in inline.transform(asked).collect()}
    assert got[40.0] == 0 and got[41.0] == len(known) and got[43.0] is None and got[42.0] == 1


def test_copies_get_fingerprints_of_their_own(spark):
    """Only repeated rows are ranked; unique rows keep the fingerprint they have when seen later."""
    rows = [(i, float(i % 50 if i < 100 else i)) for i in range(160)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(4)
    mark = X.Fingerprint(["x"], 3)
    seen = {r["k"]: r["fingerprint"] for r in mark.transform(df).collect()}
    trained = {r["k"]: r["fingerprint"] for r in mark.transform_train(df, "k").collect()}
    assert len(set(trained.values())) == len(trained) == 160
    assert all(trained[i] == seen[i] for i in range(100, 160))
    assert sum(trained[i] == seen[i] for i in range(100)) == 50


def test_ngrams_look_at_few_words_at_a_time():
    """Pieces of a batch have bounded words, keep every text whole and lose none."""
    import pyarrow as pa

    texts = [["a"] * n for n in (3, 0, 4, 12, 1, 1, 0, 5)]
    lists = pa.array([["cut", "off"], *texts], pa.list_(pa.string())).slice(1)
    pieces = E._pieces(lists, 5)
    assert [t for p in pieces for t in p.to_pylist()] == texts
    assert all(len(p.flatten()) <= 5 or len(p) == 1 for p in pieces)
    assert E._pieces(lists.slice(0, 0)) == []


def test_copies_are_numbered_alike_in_one_window_or_many(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("x"))
    mark = X.Fingerprint(["x"], 1)
    monkeypatch.setattr(X, "hash_rank", None)     # a few copies need no ranks of prefixes
    one = {r["k"]: r["fingerprint"] for r in mark.transform_train(df, "k").collect()}
    monkeypatch.undo()
    monkeypatch.setattr(X, "COPIES_AT_ONCE", 20)
    assert one == {r["k"]: r["fingerprint"] for r in mark.transform_train(df, "k").collect()}
    assert len(set(one.values())) == 400


@pytest.mark.parametrize("at_once", [50_000, 20])
def test_keys_of_any_kind_are_held_and_had_again(spark, monkeypatch, at_once):
    """Hex digits of either case, odd lengths, other texts and missing keys number copies as whole rows do."""
    monkeypatch.setattr(X, "COPIES_AT_ONCE", at_once)
    texts = ["0aff", "0AFF", "abc", "", None, "zz", "ab c1", "00", "00 "] + [f"{i:032x}" for i in range(91)]
    df = spark.createDataFrame([(k, float(i % 3 if i < 80 else i)) for i, k in enumerate(texts)], "k string, x double").repartition(3)
    double = lambda d: d.withColumn("y", F.col("x") * 2)
    mark = X.Fingerprint(["y"], 2)
    got = mark.transform_train(df, "k", double)
    whole = mark.transform_train(double(df), "k")
    order = lambda d: sorted(map(str, d.select("k", "x", "y", "fingerprint").collect()))
    assert got.columns == whole.columns and order(got) == order(whole) and len(set(order(got))) == 100
    assert got.schema["k"].dataType == df.schema["k"].dataType
    number = df.select(F.monotonically_increasing_id().alias("k"), "x").localCheckpoint()
    assert order(mark.transform_train(number, "k", double)) == order(mark.transform_train(double(number), "k"))
    assert "fingerprint" in mark.transform_train(df.where("false"), "k", double).columns


def test_moved_rows_carry_no_prepared_columns(spark):
    df = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 5).cast("double").alias("x"))
    out = X.Fingerprint(["y0", "y1"], 2).transform_train(df, "k", lambda d: d.withColumns({"y0": F.col("x") + 0.1, "y1": F.sqrt("x")}))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].splitlines()[1]
    assert "y0" not in below.split("AS _row")[-1] and "_in_0" in below and plan.count("RepartitionByExpression") == 1
