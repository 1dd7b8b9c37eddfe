"""I: embedding analytics; C9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import embed as E, split as S
from .base import CLASS_SCORES, class_scores, query, table
from .split import stratified_sql

UNIT = """U AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, v FROM
    (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))"""
CENTRED = """U AS (SELECT vec_id, label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM (SELECT vec_id, label,
    list_transform(embedding, lambda x: x::DOUBLE - list_avg(list_transform(embedding, lambda y: y::DOUBLE))) AS c FROM embeddings))"""


def emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def halves(spark, sf):
    df = emb(spark, sf)
    return df.where("vec_id % 2 = 0"), df.where("vec_id % 2 = 1")


def profile_sql(where, cte=UNIT, left="", digits=8):
    return f"""WITH {cte}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 12) AS s FROM U a, U b WHERE {where})
    SELECT a AS vec_id, count(*) AS n, round(avg(s), {digits}) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), {digits}) AS low, arg_min(b, (s, b)) AS low_key,
      round(max(s), {digits}) AS high, arg_min(b, (-s, b)) AS high_key FROM p GROUP BY a"""


def rounded_profile(df):
    return df.withColumns({c: F.round(c, 6 if c == "std" else 8) for c in ("mean", "std", "low", "high")})


@query("c9_upper_pair_profile", profile_sql("a.vec_id < b.vec_id"))
def _(spark, sf):
    df = emb(spark, sf)
    return rounded_profile(E.row_similarity(E.pair_profile(df, df, "vec_id", "embedding", "cosine", upper=True), "vec_id"))


@query("i1_cosine_profile", profile_sql("a.vec_id % 2 = 0 AND b.vec_id % 2 = 1"))
def _(spark, sf):
    a, b = halves(spark, sf)
    return rounded_profile(E.row_similarity(E.pair_profile(a, b, "vec_id", "embedding"), "vec_id"))


@query("i1_nearest_by_cosine", f"""WITH {UNIT}, p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.u, b.u), 12) AS sim FROM U a, U b WHERE a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM p)
    SELECT vec_id, rank::INTEGER AS rank, neighbour, round(sim, 8) AS sim FROM r WHERE rank <= 10""")
def _(spark, sf):
    df = emb(spark, sf)
    out = E.nearest(df, df, "vec_id", "embedding", 10, exclude_self=True)
    return out.select("vec_id", "rank", "neighbour", F.round("sim", 8).alias("sim"))


@query("i2_pearson_profile", profile_sql("a.vec_id % 2 = 0 AND b.vec_id % 2 = 1", CENTRED))
def _(spark, sf):
    a, b = halves(spark, sf)
    return rounded_profile(E.row_similarity(E.pair_profile(a, b, "vec_id", "embedding", "pearson"), "vec_id"))


@query("i3_cosine_of_means", """WITH m AS (SELECT label, list(v ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)
    SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 8) AS similarity FROM m a, m b""")
def _(spark, sf):
    return E.group_similarity(emb(spark, sf), "label", "embedding").withColumn("similarity", F.round("similarity", 8))


@query("i3_mean_pair_cosine", f"""WITH {UNIT} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(avg(list_dot_product(a.u, b.u)), 8) AS similarity FROM U a, U b GROUP BY 1, 2""")
def _(spark, sf):
    return E.group_similarity(emb(spark, sf), "label", "embedding", "pair_cosine").withColumn("similarity", F.round("similarity", 8))


def aligned(spark, sf):
    """The set and a copy of it with a tenth of the reversed vector mixed in."""
    df = emb(spark, sf)
    mixed = F.zip_with(V.as_double("embedding"), F.reverse(V.as_double("embedding")), lambda x, y: x + y * 0.1)
    return df, df.withColumn("embedding", mixed)


ALIGNED = """(SELECT i - 1 AS dim, embedding[i]::DOUBLE AS x, embedding[i]::DOUBLE + embedding[65 - i]::DOUBLE * 0.1::DOUBLE AS y FROM embeddings, range(1, 65) t(i))"""


@query("i3_flat_correlation", f"SELECT round(corr(x, y), 8) AS correlation FROM {ALIGNED}")
def _(spark, sf):
    a, b = aligned(spark, sf)
    return E.flat_correlation(a, b, "vec_id", "embedding").withColumn("correlation", F.round("correlation", 8))


@query("i4_dimension_correlation", f"SELECT dim::INTEGER AS dim, round(corr(x, y), 8) AS correlation FROM {ALIGNED} GROUP BY dim")
def _(spark, sf):
    a, b = aligned(spark, sf)
    return E.dimension_correlation(a, b, "vec_id", "embedding").withColumn("correlation", F.round("correlation", 8))


@query("i5_similarity_summary", f"""WITH {UNIT}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 12) AS s FROM U a, U b WHERE a.vec_id < b.vec_id)
    SELECT count(*) AS n_pairs, round(avg(s), 8) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), 8) AS low, arg_min(a, (s, a, b)) AS low_a, arg_min(b, (s, a, b)) AS low_b,
      round(max(s), 8) AS high, arg_min(a, (-s, a, b)) AS high_a, arg_min(b, (-s, a, b)) AS high_b FROM p""")
def _(spark, sf):
    df = emb(spark, sf)
    return rounded_profile(E.pair_summary(df, "vec_id", "embedding", "cosine"))


@query("i6_energy_distance", f"""WITH {UNIT}, d AS (SELECT a.vec_id % 2 AS x, b.vec_id % 2 AS y, avg(list_distance(a.v, b.v)) AS m FROM U a, U b GROUP BY 1, 2)
    SELECT round(2 * sum(m) FILTER (WHERE x = 0 AND y = 1) - sum(m) FILTER (WHERE x = y), 8) AS energy_distance FROM d""")
def _(spark, sf):
    a, b = halves(spark, sf)
    return E.energy_distance(a, b, "vec_id", "embedding").withColumn("energy_distance", F.round("energy_distance", 8))


def split_embeddings(spark, sf):
    df = S.stratified_split(emb(spark, sf), "vec_id", "label", 0.2, seed=1)
    return df.where("split = 'train'").drop("split"), df.where("split = 'test'").drop("split")


NEAR = f"""{UNIT}, sp AS ({stratified_sql('embeddings', 'vec_id', 'label', 0.2, 1)}),
  p AS (SELECT a.vec_id, b.vec_id AS nb, b.label, round(list_dot_product(a.u, b.u), 12) AS sim FROM U a JOIN sp x ON x.vec_id = a.vec_id AND x.split = 'test'
    CROSS JOIN U b JOIN sp y ON y.vec_id = b.vec_id AND y.split = 'train'),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nb) AS rank FROM p),
  w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY vec_id)) / 0.07::DOUBLE) AS e FROM r WHERE rank <= 20),
  v AS (SELECT vec_id, k, label AS class, sum(e / t) AS mass FROM (SELECT *, sum(e) OVER (PARTITION BY vec_id) AS t FROM w), (VALUES (5), (10), (20)) z(k) WHERE rank <= k GROUP BY 1, 2, 3)"""


@query("i7_knn_vote", f"WITH {NEAR} SELECT vec_id, k, class, round(mass, 8) AS mass FROM v")
def _(spark, sf):
    train, test = split_embeddings(spark, sf)
    votes = E.knn_classify(train, test, "vec_id", "embedding", "label", [5, 10, 20])
    return votes.withColumn("mass", F.round("mass", 8))


# a class without votes has mass 0; the true class counts when fewer classes beat it, ties by class id
KNN_HITS = """j AS (SELECT q.vec_id, q.k, e.label AS y, c, coalesce(mass, 0) AS mass FROM (SELECT DISTINCT vec_id, k FROM v) q JOIN embeddings e USING (vec_id)
    CROSS JOIN (SELECT unnest(range(10)) AS c) LEFT JOIN v ON v.vec_id = q.vec_id AND v.k = q.k AND v.class = c),
  t AS (SELECT vec_id, k, 1 + count(*) FILTER (WHERE j.mass > m OR (j.mass = m AND c < y)) AS rank FROM
    (SELECT *, max(CASE WHEN c = y THEN mass END) OVER (PARTITION BY vec_id, k) AS m FROM j) j GROUP BY vec_id, k)"""


@query("i8_knn_grid", f"WITH {NEAR}, {KNN_HITS} SELECT -1 AS n_per_class, k, round(avg((rank <= 1)::INTEGER), 8) AS top_1, round(avg((rank <= 5)::INTEGER), 8) AS top_5 FROM t GROUP BY k")
def _(spark, sf):
    train, test = split_embeddings(spark, sf)
    out = E.knn_eval(train, test, "vec_id", "embedding", "label", [5, 10, 20], [-1], 1, 10)
    return out.withColumns({c: F.round(c, 8) for c in ("top_1", "top_5")})


@query("i8_knn_grid_tries")
def _(spark, sf):
    train, test = split_embeddings(spark, sf)
    return E.knn_eval(train, test, "vec_id", "embedding", "label", [5, 20], [5, 20, -1], 3, 10)


@query("i9_l2_normalise", f"WITH {UNIT} SELECT vec_id, (i - 1)::INTEGER AS dim, round(u[i], 7) AS value FROM U, range(1, 65) t(i)")
def _(spark, sf):
    return emb(spark, sf).select("vec_id", F.posexplode(V.l2_normalise("embedding")).alias("dim", "value")).withColumn(
        "value", F.round("value", 7))


@query("i10_spread_score", f"""WITH {UNIT}, n AS (SELECT a.vec_id, arg_min(b.u, (-round(list_dot_product(a.u, b.u), 12), b.vec_id)) AS o, any_value(a.u) AS u FROM U a JOIN U b ON a.vec_id <> b.vec_id GROUP BY 1)
    SELECT round(-avg(ln(list_distance(u, o) + 1e-8::DOUBLE)), 8) AS spread FROM n""")
def _(spark, sf):
    return E.spread_score(emb(spark, sf), "vec_id", "embedding").withColumn("spread", F.round("spread", 8))


@query("i11_pool_tokens", """WITH t AS (SELECT vec_id // 10 AS item, (vec_id % 10) // 5 AS layer, vec_id % 5 AS token, embedding FROM embeddings),
      h AS (SELECT item, layer * 64 + i - 1 AS pos, embedding[i]::DOUBLE AS v FROM t, range(1, 65) r(i) WHERE token = 0),
      m AS (SELECT item, 128 + i - 1 AS pos, avg(embedding[i]::DOUBLE) AS v FROM t, range(1, 65) r(i) WHERE token > 0 AND layer = 1 GROUP BY 1, 2)
    SELECT item, pos::INTEGER AS pos, round(v, 7) AS value FROM (SELECT * FROM h UNION ALL SELECT * FROM m)""")
def _(spark, sf):
    i = F.col("vec_id")
    tokens = emb(spark, sf).select(F.floor(i / 10).alias("item"), F.floor((i % 10) / 5).alias("layer"), (i % 5).alias("token"),
                                   F.col("embedding").alias("vec"))
    out = E.pool_tokens(tokens, "item", layers=2)
    return out.select("item", F.posexplode("pooled").alias("pos", "value")).withColumn("value", F.round("value", 7))


@query("i12_balanced_assign", f"WITH {CLASS_SCORES}" + """, e AS (SELECT vec_id, k, exp((v[k + 1] - (SELECT max(list_max(v[1:8])) FROM CV)) / 0.1::DOUBLE) AS e FROM CV, (SELECT unnest(range(8)) AS k)),
      n AS (SELECT count(*) AS n FROM embeddings),
      c1 AS (SELECT k, 1 / (8 * sum(e)) AS c FROM e GROUP BY k),
      s1 AS (SELECT vec_id, k, e * c / (sum(e * c) OVER (PARTITION BY vec_id) * n) AS q, c FROM e JOIN c1 USING (k), n),
      c2 AS (SELECT k, any_value(c) / (8 * sum(q)) AS c FROM s1 GROUP BY k),
      s2 AS (SELECT vec_id, k, e * c / (sum(e * c) OVER (PARTITION BY vec_id) * n) AS q, c FROM e JOIN c2 USING (k), n),
      c3 AS (SELECT k, any_value(c) / (8 * sum(q)) AS c FROM s2 GROUP BY k)
    SELECT vec_id, k::INTEGER AS prototype, round(e * c / sum(e * c) OVER (PARTITION BY vec_id), 8) AS mass FROM e JOIN c3 USING (k)""")
def _(spark, sf):
    df = class_scores(spark, sf).withColumn("scores", F.slice("scores", 1, 8))      # eight prototypes
    out = E.balanced_assign(df, "scores", 0.1)
    return out.select("vec_id", F.posexplode("assignment").alias("prototype", "mass")).withColumn("mass", F.round("mass", 8))


@query("i13_probe_sweep")
def _(spark, sf):
    train, rest = split_embeddings(spark, sf)
    return E.probe_sweep(train, rest, "embedding", "label", parallelism=8)[0]
