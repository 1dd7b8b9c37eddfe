"""D: encoding and column typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from .base import query, table
from .clean import DOC_LABELS


def seeded_codes_sql(source, key, col, seed):
    return f"""(SELECT {col}, row_number() OVER (ORDER BY md5('{seed}|' || {col})) - 1 AS code
        FROM (SELECT DISTINCT {col} FROM {source}))"""


@query("d1_label_encode", """SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code, o_orderpriority AS back FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    enc = E.fit_label(df, "o_orderpriority", "_code")
    out = enc.inverse(enc.transform(df), "o_orderpriority", "back")
    return out.select("o_orderkey", F.col("o_orderpriority_code").alias("code"), "back")


@query("d1_label_encode_numbers", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_size) - 1)::DOUBLE AS code FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    return E.fit_label(df, "p_size", "_code").transform(df).select("p_partkey", F.col("p_size_code").alias("code"))


@query("d1_label_encode_large", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS code FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    enc = E.fit_codes(df, ["c_name"], suffix="_code", limit=100)
    return enc.transform(df).select("c_custkey", F.col("c_name_code").alias("code"))


@query("d2_ordinal_strict", """SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment,
    (dense_rank() OVER (ORDER BY c_nationkey) - 1)::DOUBLE AS c_nationkey FROM customer""")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return E.fit_codes(df, ["c_mktsegment", "c_nationkey"]).transform(df)


@query("d3_ordinal_unknown_code", """WITH v AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
      FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'))
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE coalesce(code, -1)::DOUBLE END AS priority
    FROM orders LEFT JOIN v ON p = o_orderpriority""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    enc = E.fit_codes(df.where("priority <> '5-LOW'"), ["priority"], unknown=-1)
    return enc.transform(df.withColumn("priority", F.when(F.col("o_orderkey") % 7 != 0, F.col("priority"))))


@query("d4_ordinal_gated", """WITH v AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code
      FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus <> 'P'))
    SELECT o_orderkey, code::DOUBLE AS o_orderstatus, o_custkey FROM orders LEFT JOIN v ON s = o_orderstatus""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    # customer keys are rare values, so the gate leaves that column alone
    enc = E.fit_codes(df.where("o_orderstatus <> 'P'"), ["o_orderstatus", "o_custkey"], unknown=None, gate="very_common")
    return enc.transform(df)


@query("d5_ordinal_shuffled", f"""SELECT o_orderkey, code::DOUBLE AS code FROM orders JOIN
    {seeded_codes_sql('orders', 'o_orderkey', 'o_orderpriority', 3)} USING (o_orderpriority)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return E.fit_codes(df, ["o_orderpriority"], suffix="_c", shuffle_seed=3).transform(df).select(
        "o_orderkey", F.col("o_orderpriority_c").alias("code"))


@query("d6_one_hot", f"""SELECT doc_id, """ + ", ".join(
    f"(lang = '{v}')::INTEGER AS \"lang={v}\"" for v in ("de", "en", "es", "fr")) + f""",
    (quality IS NULL)::INTEGER AS "quality=", coalesce(quality = 0, false)::INTEGER AS "quality=0", coalesce(quality = 1, false)::INTEGER AS "quality=1",
    (CASE WHEN n_chars > 500 THEN 'long' ELSE 'brief' END = 'long')::INTEGER AS "size=long" FROM {DOC_LABELS}""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 500, "long").otherwise("brief").alias("size"))
    df = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return E.fit_onehot(df, ["lang", "quality", "size"]).transform(df)


@query("d6_one_hot_long", """SELECT c_custkey, 'c_mktsegment=' || c_mktsegment AS feature FROM customer
    UNION ALL SELECT c_custkey, 'c_nationkey=' || c_nationkey FROM customer""")
def _(spark, sf):
    return E.onehot_long(table(spark, sf, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("d7_least_common_count", "SELECT min(n) AS least_common FROM (SELECT count(*) AS n FROM part GROUP BY p_type)")
def _(spark, sf):
    return E.least_common_count(table(spark, sf, "part"), "p_type")


LINE_COLS = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query("d8_infer_categorical", """SELECT name, ((name IN ('l_linenumber', 'l_quantity', 'l_returnflag') AND u <= 30)
      OR (name NOT IN ('l_linenumber', 'l_quantity', 'l_returnflag') AND n > 100 AND u < 4)) AS categorical FROM ("""
       + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS u, count(*) AS n FROM lineitem" for c in LINE_COLS) + ")")
def _(spark, sf):
    found = E.infer_categorical(table(spark, sf, "lineitem"), LINE_COLS, listed=["l_linenumber", "l_quantity", "l_returnflag"])
    return spark.createDataFrame([(c, c in found) for c in LINE_COLS], "name string, categorical boolean")


@query("d9_infer_roles", """SELECT name, CASE WHEN txt OR u < 4 THEN 'categorical' ELSE 'numeric' END AS role FROM (
    SELECT 'o_custkey' AS name, false AS txt, count(DISTINCT o_custkey) AS u FROM orders UNION ALL
    SELECT 'o_orderstatus', true, count(DISTINCT o_orderstatus) FROM orders UNION ALL
    SELECT 'o_totalprice', false, count(DISTINCT o_totalprice) FROM orders UNION ALL
    SELECT 'is_even', false, count(DISTINCT o_orderkey % 2) FROM orders UNION ALL
    SELECT 'o_orderpriority', true, count(DISTINCT o_orderpriority) FROM orders)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                                           (F.col("o_orderkey") % 2).alias("is_even"))
    return spark.createDataFrame(list(E.infer_roles(df).items()), "name string, role string")


TARGET_RANK = """SELECT p_partkey, (SELECT count(DISTINCT t.p_size) FROM part t WHERE t.p_partkey % 4 <> 0 AND t.p_size % 3 <> 0 AND t.p_size < part.p_size) AS below FROM part"""


@query("d10_target_rank", TARGET_RANK)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    fitted = E.fit_target_rank(df.where("p_partkey % 4 <> 0 and p_size % 3 <> 0"), "p_size", "below")
    return fitted.transform(df).select("p_partkey", F.col("below").cast("long").alias("below"))


@query("d10_target_rank_large", TARGET_RANK)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    return E.rank_against(df, df.where("p_partkey % 4 <> 0 and p_size % 3 <> 0"), "p_size", "below").select(
        "p_partkey", F.col("below").cast("long").alias("below"))


@query("d11_class_priors", """SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8)::DOUBLE AS prior FROM embeddings GROUP BY label""")
def _(spark, sf):
    return E.class_priors(table(spark, sf, "embeddings"), "label").withColumn("prior", F.round("prior", 8))


PERM = (3, 1, 4, 0, 5, 9, 2, 6, 8, 7)


@query("d12_class_permutation", """WITH p AS (SELECT vec_id, label, [3,1,4,0,5,9,2,6,8,7] AS perm, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS probs FROM embeddings)
    SELECT vec_id, perm[label + 1]::INTEGER AS permuted, c::INTEGER AS class, round(probs[perm[c + 1] + 1], 6) AS prob
    FROM p, (SELECT unnest(range(10)) AS c)""")
def _(spark, sf):
    perm = F.array(*[F.lit(p) for p in PERM])
    df = table(spark, sf, "embeddings").select("vec_id", E.permute_class(F.col("label"), perm).alias("permuted"),
        F.posexplode(E.unpermute_probs(F.col("embedding").cast("array<double>"), perm)).alias("class", "prob"))
    return df.withColumn("prob", F.round("prob", 6))


GRAMS_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
  g AS (SELECT doc_id, unnest(t) AS gram FROM w
    UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) FROM w
    UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]) FROM w),
  v AS (SELECT gram, count(DISTINCT doc_id) AS df, count(*) AS tf FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= 30
    ORDER BY tf DESC, gram LIMIT 300)"""


@query("d13_ngram_vocabulary", f"WITH {GRAMS_SQL} SELECT gram, df, tf FROM v")
def _(spark, sf):
    return E.ngram_vocabulary(table(spark, sf, "documents", spread=True), "text")


@query("d13_ngram_counts", f"WITH {GRAMS_SQL} SELECT doc_id, gram, count(*)::DOUBLE AS n FROM g JOIN v USING (gram) GROUP BY doc_id, gram")
def _(spark, sf):
    docs = table(spark, sf, "documents", spread=True).select("doc_id", "text")
    fitted = E.fit_ngrams(docs, "text")
    grams = F.array(*[F.lit(g) for g in fitted.vocabulary])
    counts = fitted.transform(docs).select("doc_id", F.posexplode_outer("ngram_counts").alias("i", "n")).where("n > 0")
    return counts.select("doc_id", F.get(grams, F.col("i")).alias("gram"), "n")
