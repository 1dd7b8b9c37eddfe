"""B: projection, filter, cleaning, derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C, features as X
from .base import query, table

DOC_LABELS = "documents d LEFT JOIN labels l USING (doc_id)"
INJECTED = """(SELECT event_id, value, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE
    WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE ELSE value END AS x FROM events)"""


def doc_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


def injected(spark, sf):
    """Events with nulls, infinities and NaN put in at fixed places."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", "value", F.when(e % 7 == 0, None)
        .when(e % 11 == 0, float("inf")).when(e % 13 == 0, float("-inf")).when(e % 17 == 0, float("nan"))
        .otherwise(F.col("value")).alias("x"))


@query("b1_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    return C.project(table(spark, sf, "orders"), drop=["o_orderstatus", "o_orderdate", "o_orderpriority"])


@query("b2_rename", "SELECT o_orderkey AS key, o_totalprice AS label FROM orders")
def _(spark, sf):
    return C.rename(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                    {"o_orderkey": "key", "o_totalprice": "label"})


@query("b3_row_filter", f"""SELECT doc_id, lang, source FROM {DOC_LABELS}
    WHERE NOT (quality IS NULL AND toxic IS NULL) AND length(text) > 0 AND lang IN ('en', 'de')""")
def _(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return df.where((F.col("quality").isNotNull() | F.col("toxic").isNotNull())
                    & (F.length("text") > 0) & F.col("lang").isin("en", "de")).select("doc_id", "lang", "source")


@query("b4_fill_text", f"SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN source END, '') AS source FROM {DOC_LABELS}")
def _(spark, sf):
    df = doc_labels(spark, sf).select("doc_id", F.when(F.col("quality") == 1, F.col("source")).alias("source"))
    return C.fill_text(df, ["source"])


@query("b5_drop_incomplete", f"SELECT doc_id, quality, toxic FROM {DOC_LABELS} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, sf):
    return C.drop_incomplete(doc_labels(spark, sf).select("doc_id", "quality", "toxic"))


@query("b6_fill_constant", f"SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM {DOC_LABELS}")
def _(spark, sf):
    return C.fill_constant(doc_labels(spark, sf).select("doc_id", "quality", "toxic"), ["quality", "toxic"], 0)


@query("b7_sentinel_impute", f"""WITH t AS (SELECT doc_id, quality, toxic, CASE WHEN quality IS NOT NULL THEN n_chars END AS n_chars
      FROM {DOC_LABELS})
    SELECT doc_id, coalesce(quality::DOUBLE, (SELECT min(quality)::DOUBLE - 1 FROM t)) AS quality,
      coalesce(n_chars::DOUBLE, (SELECT min(n_chars)::DOUBLE - 1 FROM t)) AS n_chars FROM t""")
def _(spark, sf):
    df = doc_labels(spark, sf).select("doc_id", F.col("quality").cast("double"),
                                      F.when(F.col("quality").isNotNull(), F.col("n_chars")).cast("double").alias("n_chars"))
    return C.fit_sentinel(df, ["quality", "n_chars"]).transform(df)


@query("b7_sentinel_per_split", f"""WITH t AS (SELECT doc_id, doc_id % 5 = 0 AS test, CASE WHEN quality IS NOT NULL THEN n_chars END::DOUBLE AS n_chars
      FROM {DOC_LABELS})
    SELECT doc_id, test, coalesce(n_chars, min(n_chars) OVER (PARTITION BY test) - 1) AS n_chars FROM t""")
def _(spark, sf):
    df = doc_labels(spark, sf).select("doc_id", (F.col("doc_id") % 5 == 0).alias("test"),
                                      F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("n_chars"))
    return C.sentinel_per_split(df, ["n_chars"], "test")


@query("b8_mean_impute", f"""WITH t AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN n_chars END::DOUBLE AS n_chars, NULL::DOUBLE AS empty
      FROM {DOC_LABELS})
    SELECT doc_id, round(coalesce(n_chars, (SELECT avg(n_chars) FROM t)), 6) AS n_chars, 0.0::DOUBLE AS empty FROM t""")
def _(spark, sf):
    df = doc_labels(spark, sf).select("doc_id", F.when(F.col("quality").isNotNull(), F.col("n_chars")).cast("double").alias("n_chars"),
                                      F.lit(None).cast("double").alias("empty"))
    return C.fit_mean_impute(df, ["n_chars", "empty"]).transform(df).withColumn("n_chars", F.round("n_chars", 6))


@query("b9_finite", f"""SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS x FROM {INJECTED}""")
def _(spark, sf):
    return C.finite(injected(spark, sf).select("event_id", "x"), ["x"])


@query("b10_missing_indicator", f"""SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN -2.0 WHEN x = 'inf'::DOUBLE THEN 2.0
    WHEN x = '-inf'::DOUBLE THEN 4.0 ELSE 0.0 END::DOUBLE AS x_missing FROM {INJECTED}""")
def _(spark, sf):
    return C.missing_indicator(injected(spark, sf).select("event_id", "x"), ["x"]).drop("x")


@query("b11_concat_text", "SELECT conv_id, turn, md5(role || ' ' || text) AS joined FROM conversations")
def _(spark, sf):
    df = C.concat_text(table(spark, sf, "conversations"), ["role", "text"], "joined")
    return df.select("conv_id", "turn", F.md5("joined").alias("joined"))


@query("b12_extract_year", r"""SELECT o_orderkey, nullif(regexp_extract(strftime(o_orderdate, '%d.%m.%Y'), '.*(\d{4})', 1), '')::INTEGER AS year FROM orders""")
def _(spark, sf):
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    return table(spark, sf, "orders").select("o_orderkey", C.last_year(text).alias("year"))


@query("b13_normalise_types", """SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_tax, l_returnflag FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag")
    return C.normalise_types(df, categorical=["l_linenumber"])


@query("b14_strip_cast", "SELECT p_partkey, replace(p_brand, 'Brand#', '')::INTEGER AS brand FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.strip_cast(F.col("p_brand"), "Brand#").alias("brand"))


@query("b15_first_token", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1)::INTEGER AS priority FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.first_token(F.col("o_orderpriority")).alias("priority"))


@query("b16_contains_label", "SELECT p_partkey, contains(p_name, 'widget')::INTEGER AS is_widget FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.contains_label(F.col("p_name"), "widget").alias("is_widget"))


@query("b17_merge_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf):
    return C.replace_values(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"P": "O"})


@query("b18_onehot_to_label", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' WHEN event_type IN ('click', 'purchase') THEN 'act' END AS label FROM events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", *[
        (F.col("event_type") == t).cast("int").alias(t) for t in ("view", "click", "purchase")])
    return df.select("event_id", C.onehot_to_label({"view": "view", "click": "act", "purchase": "act"}).alias("label"))


@query("b19_rescale", "SELECT event_id, round(value / 100 - 1, 8) AS y FROM events")
def _(spark, sf):
    scaled = X.Scale({"value": [0.0, 0.01, -1.0]}, "_y").transform(table(spark, sf, "events"))
    return scaled.select("event_id", F.round("value_y", 8).alias("y"))


@query("b20_path_parts", r"""WITH p AS (SELECT page_id, url, split(url, '/') AS s FROM pages)
    SELECT page_id, s[len(s) - 1] AS dir_name, s[len(s)] AS base_name,
      regexp_extract(s[len(s)], '^(.*?)(\.[^.]*)?$', 1) AS stem, regexp_extract(s[len(s)], '\.([^.]*)$', 1) AS extension FROM p""")
def _(spark, sf):
    return C.path_parts(table(spark, sf, "pages"), "url").select("page_id", "dir_name", "base_name", "stem", "extension")


@query("b21_elementwise", """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS lg,
    round(ln(1 + l_tax), 8) AS lp, round(exp(l_discount), 8) AS ex, CASE WHEN l_tax > 0 THEN round(ln(l_tax), 8) END AS lt FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    df = C.elementwise(df, ["l_extendedprice", "l_tax"], "log", "_lg")
    df = C.elementwise(C.elementwise(df, ["l_tax"], "log1p", "_lp"), ["l_discount"], "exp", "_ex")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice_lg", 6).alias("lg"),
                     F.round("l_tax_lp", 8).alias("lp"), F.round("l_discount_ex", 8).alias("ex"),
                     F.round("l_tax_lg", 8).alias("lt"))


@query("b22_minmax_opacity", """SELECT l_orderkey, l_linenumber, l_partkey, round(0.2 + 0.8::DOUBLE * (l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem))
    / ((SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem)), 7) AS alpha FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    scaled = X.fit_range(df, ["l_extendedprice"], 0.2, 1.0, suffix="_a").transform(df)
    return scaled.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice_a", 7).alias("alpha"))


@query("b23_frequency_features", """SELECT l_orderkey, l_linenumber, l_partkey, """ + ", ".join(
    f"round(sin(2 * pi() * l_quantity / {w}), 7) AS s{i}, round(cos(2 * pi() * l_quantity / {w}), 7) AS c{i}"
    for i, w in enumerate((0.5, 1.0, 2.0, 4.0))) + " FROM lineitem")
def _(spark, sf):
    df = X.frequency_features(table(spark, sf, "lineitem"), ["l_quantity"], k=4)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[
        f for i in range(4) for f in (F.round(f"l_quantity_sin{i}", 7).alias(f"s{i}"), F.round(f"l_quantity_cos{i}", 7).alias(f"c{i}"))])


NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query("b24_feature_crosses", "WITH s AS (SELECT " + ", ".join(f"stddev_pop({c}) AS s{i}" for i, c in enumerate(NUM))
       + " FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"round({NUM[i]} / s{i} * {NUM[j]} / s{j}, 6) AS x{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM lineitem, s")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    fitted = X.fit_crosses(df, NUM)
    out = fitted.transform(df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[
        F.round(n, 6).alias(f"x{NUM.index(a)}{NUM.index(b)}") for n, (a, b) in zip(fitted.names(), fitted.pairs)])


@query("b25_row_fingerprint", """WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
      row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('7|' || o_orderkey)) - 1 AS copy FROM orders)
    SELECT o_orderkey, (('0x' || substr(md5('7|' || o_orderstatus || '|' || o_orderpriority || '|' || copy), 1, 15))::BIGINT % 1000000000000)
      / 1e12::DOUBLE AS fingerprint FROM t""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    step = X.Fingerprint(["o_orderstatus", "o_orderpriority"], salt=7)
    return step.transform_train(df, "o_orderkey").select("o_orderkey", "fingerprint")


@query("b26_drop_constant", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
    CASE WHEN l_linenumber > 1 THEN 5 END AS some_null FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(3.0).alias("fixed"),
        F.lit(None).cast("double").alias("empty"), F.when(F.col("l_linenumber") > 1, 5).alias("some_null"))
    return X.fit_drop_constant(df, ["l_quantity", "fixed", "empty", "some_null"]).transform(df)


@query("b27_drop_duplicate", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                             (F.col("l_quantity") * 2 + 1).alias("copy"), "l_tax")
    return X.fit_drop_duplicate(df, ["l_quantity", "copy", "l_tax"]).transform(df)


@query("b30_fixed_vector", """SELECT l_orderkey, l_linenumber, l_partkey, pos::INTEGER AS pos, round(CASE pos WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice
    WHEN 2 THEN l_discount ELSE 0 END * sqrt(5 / 3::DOUBLE), 6) AS value, (pos // 2)::INTEGER AS grp
    FROM lineitem, (SELECT unnest(range(6)) AS pos)""")
def _(spark, sf):
    df = X.to_fixed_vector(table(spark, sf, "lineitem"), NUM, width=5, group=2)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    groups = df.select(*keys, F.posexplode("vector").alias("grp", "part"))
    return groups.select(*keys, "grp", F.posexplode("part").alias("i", "value")).select(
        *keys, "grp", (F.col("grp") * 2 + F.col("i")).alias("pos"), F.round("value", 6).alias("value"))
