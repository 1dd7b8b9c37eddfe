"""F: sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as S
from .base import query, table


@query("f1_exact_split", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('5|' || o_orderkey)) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(spark, sf):
    return S.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=5)


@query("f2_three_way_split", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('5|' || o_orderkey)) AS r, floor(0.8 * count(*) OVER ()) AS t FROM orders)
    SELECT o_orderkey, CASE WHEN r <= t THEN 'train' WHEN r <= t + floor(0.1 * t) THEN 'valid' ELSE 'test' END AS split FROM r""")
def _(spark, sf):
    return S.three_way_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=5)


def stratified_sql(tbl, key, y, frac, seed):
    return f"""WITH c AS (SELECT {y}, count(*) AS n FROM {tbl} GROUP BY 1),
      q AS (SELECT {y}, n * ceil({frac} * sum(n) OVER ())::DOUBLE / sum(n) OVER () AS share, ceil({frac} * sum(n) OVER ()) AS take FROM c),
      p AS (SELECT {y}, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, {y})
        <= take - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM q)
    SELECT {key}, {y}, CASE WHEN row_number() OVER (PARTITION BY {y} ORDER BY md5('{seed}|' || {key})) <= quota THEN 'test' ELSE 'train' END AS split
    FROM {tbl} JOIN p USING ({y})"""


@query("f3_stratified_split", stratified_sql("embeddings", "vec_id", "label", 0.2, 1))
def _(spark, sf):
    return S.stratified_split(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.2, seed=1)


@query("f3_stratified_split_share", stratified_sql("labels", "doc_id", "quality", 0.33, 2))
def _(spark, sf):
    return S.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.33, seed=2)


FOLDS = """SELECT r, vec_id, label, count(*) OVER (PARTITION BY r, label) AS n,
      row_number() OVER (PARTITION BY r, label ORDER BY md5((4 + r) || '|' || vec_id)) AS k FROM embeddings, (VALUES (0), (1)) s(r)"""


def fold_sql(final):
    """Class-sorted rows dealt to folds in turn; within a class, lower hashes go to lower folds."""
    return f"""WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) - count(*) AS s FROM embeddings GROUP BY label),
      z AS (SELECT label, f, (SELECT count(*) FROM range(s::BIGINT, (s + n)::BIGINT) t(p) WHERE p % 5 = f) AS size FROM c, (SELECT unnest(range(5)) AS f)),
      e AS (SELECT label, f, sum(size) OVER (PARTITION BY label ORDER BY f) AS hi, sum(size) OVER (PARTITION BY label ORDER BY f) - size AS lo FROM z),
      o AS ({FOLDS}),
      a AS (SELECT r AS repeat, vec_id, o.label, f AS fold FROM o JOIN e ON o.label = e.label AND k > lo AND k <= hi)
      {final}"""


@query("f5_stratified_kfold", fold_sql("SELECT repeat, vec_id, label, fold::INTEGER AS fold FROM a"))
def _(spark, sf):
    return S.kfold(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 5, "label", seed=4, repeats=2)


@query("f5_kfold", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('9|' || o_orderkey)) - 1 AS r, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, 0 AS repeat, (CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE (r - n % 7) // (n // 7) END)::INTEGER AS fold FROM r""")
def _(spark, sf):
    return S.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, seed=9)


@query("f6_equal_folds", """WITH r AS (SELECT o_orderkey, md5('9|' || o_orderkey) AS h, row_number() OVER (ORDER BY md5('9|' || o_orderkey)) - 1 AS r, count(*) OVER () AS n FROM orders),
      f AS (SELECT *, (CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE (r - n % 7) // (n // 7) END)::INTEGER AS fold FROM r)
    SELECT o_orderkey, 0 AS repeat, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY h) <= count(*) OVER (PARTITION BY fold) - n // 7 THEN -1 ELSE fold END AS fold FROM f""")
def _(spark, sf):
    return S.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, seed=9, equal_size=True)


@query("f7_member_subsample", """SELECT o_orderkey, m::INTEGER AS member FROM (SELECT o_orderkey, m, row_number() OVER (PARTITION BY m ORDER BY md5((11 + m) || '|' || o_orderkey)) AS r,
    count(*) OVER (PARTITION BY m) AS n FROM orders, (VALUES (0), (1), (2), (3)) s(m)) WHERE r <= floor(0.25 * n) + 1""")
def _(spark, sf):
    return S.subsample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.25, 4, seed=11)


@query("f8_per_class_sample", """SELECT vec_id, label, t AS "try" FROM (SELECT vec_id, label, t, row_number() OVER (PARTITION BY t, label ORDER BY md5((2 + t) || '|' || vec_id)) AS r
    FROM embeddings, (VALUES (0), (1), (2)) s(t)) WHERE r <= 20""")
def _(spark, sf):
    return S.per_class_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label", 20, 3, seed=2)


@query("f9_tuning_holdout", """SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('1|' || vec_id)) <= count(*) OVER () // 10 THEN 'tune' ELSE 'train' END AS split FROM embeddings""")
def _(spark, sf):
    return S.tuning_holdout(table(spark, sf, "embeddings").select("vec_id"), "vec_id", seed=1)


@query("f10_epoch_order", """WITH n AS (SELECT count(*) AS n, (5 * count(*)) // 2 AS size FROM documents),
      t AS (SELECT doc_id, tile, size, row_number() OVER (ORDER BY md5('6|' || tile || '|' || doc_id)) - 1 AS r FROM documents, n, (VALUES (0), (1), (2)) s(tile))
    SELECT doc_id, tile, (r % 4)::INTEGER AS shard, r // 4 AS position FROM t WHERE r < size""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return S.epoch_order(docs, "doc_id", docs.count() * 5 // 2, shards=4, epoch=3, seed=2)


@query("f11_shard_order", """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('2|' || doc_id)) - 1 AS r, count(*) OVER () AS n FROM documents),
      s AS (SELECT doc_id, (r % 4)::INTEGER AS shard, n FROM d WHERE r < 4 * (n // 4)),
      p AS (SELECT doc_id, shard, n, row_number() OVER (PARTITION BY shard ORDER BY md5((2 + shard + (1 << 24)) || '|' || doc_id)) - 1 AS position FROM s)
    SELECT doc_id, shard, 1 AS pass, position FROM p WHERE position >= 17""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return S.shard_order(docs, "doc_id", shards=4, seed=2, advance=docs.count() // 4 + 17)
