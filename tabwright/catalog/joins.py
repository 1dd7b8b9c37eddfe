"""C: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .base import query, table


@query("c1_attach_assets", "SELECT d.doc_id, d.lang, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return J.attach_assets(docs, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("c2_keep_known", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return J.keep_known(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id")


@query("c3_missing_assets", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return J.missing_assets(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("c3_missing_slots", """
    SELECT o_orderkey FROM orders LEFT JOIN
      (SELECT l_orderkey, count(DISTINCT l_linenumber) n FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey
    WHERE coalesce(n, 0) < 3""")
def _(spark, sf):
    index = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("slot"))
    return J.missing_assets(table(spark, sf, "orders"), index, "o_orderkey", slots=3)


@query("c4_label_name", """
    SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    names = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return J.with_label_name(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), names,
                             "c_nationkey", "n_nationkey")


@query("c5_join_features", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status_code,
           round(o_totalprice / 1000, 6) AS price_k FROM orders""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    cats = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0)
                         .when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("status_code"))
    nums = orders.select("o_orderkey", F.round(F.col("o_totalprice") / 1000, 6).alias("price_k"))
    return J.join_features(cats, nums, "o_orderkey")


@query("c6_concat_tokens", """
    SELECT vec_id, pos::INTEGER AS pos, round(embedding[1 + pos % 64]::DOUBLE, 6) * CASE WHEN pos < 64 THEN 1 ELSE -1 END AS value
    FROM embeddings, (SELECT unnest(range(128)) AS pos) p""")
def _(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("tokens"))
    other = emb.withColumn("tokens", F.transform("tokens", lambda x: -x))
    both = J.concat_tokens(emb, other, "vec_id", "tokens")
    return both.select("vec_id", F.posexplode("tokens").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("c7_stack_roles", """
    SELECT o_orderkey, o_totalprice, 'train' AS role FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice, 'test' FROM orders WHERE o_orderstatus <> 'F'""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_totalprice"]
    return J.stack(orders.where("o_orderstatus = 'F'").select(cols), orders.where("o_orderstatus <> 'F'").select(cols))


@query("c8_distinct_classes", "SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL")
def _(spark, sf):
    return J.distinct_values(table(spark, sf, "embeddings"), "label")
