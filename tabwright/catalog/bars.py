"""H: statistics of histogram-shaped distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import softmax
from ..operators import bars as H
from .base import query, table
from .metrics import rounded

BORDERS = [round(-3.2 + 0.1 * i, 1) for i in range(65)]
S = 0.1 / 0.6744897501960817  # half-normal scale of the end bars

# long bars: p, cumulative mass before (c0) and up to (c1) each bar, target y
BARS = f"""D AS (SELECT vec_id, label, (label - 4.5) * 0.65::DOUBLE AS y, list_transform(embedding, lambda x: exp(4 * x::DOUBLE)) AS e FROM embeddings),
  G AS (SELECT vec_id, label, y, i, e[i + 1] / list_sum(e) AS p, round(-3.2 + 0.1::DOUBLE * i, 1)::DOUBLE AS l, round(-3.1 + 0.1::DOUBLE * i, 1)::DOUBLE AS r FROM D, (SELECT unnest(range(64)) AS i)),
  C AS (SELECT *, sum(p) OVER w AS c1, sum(p) OVER w - p AS c0, r - l AS w FROM G WINDOW w AS (PARTITION BY vec_id ORDER BY i))"""


def dists(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", ((F.col("label") - 4.5) * 0.65).alias("y"),
        F.transform("embedding", lambda x: x.cast("double") * 4).alias("logits"))


def stat(spark, sf, names, digits=7, **kw):
    df = H.distribution_stats(dists(spark, sf), BORDERS, names, y="y", key="vec_id", **kw)
    cols = [c for c in df.columns if c not in ("vec_id", "label", "y", "logits")]
    return rounded(df.select("vec_id", *cols), digits, [c for c in cols if c != "bar"])


def fold_sql(parts, digits=7):
    return f"WITH {BARS} SELECT vec_id, " + ", ".join(f"round({x}, {digits}) AS {n}" for n, x in parts.items()) + " FROM C GROUP BY vec_id, y"


def q_sql(q):
    return f"arg_min(l + w * ({q} - c0) / p, i) FILTER (WHERE c1 >= {q})"


@query("h1_cdf", fold_sql({"cdf": "sum(p * least(greatest((y - l) / w, 0), 1))"}))
def _(spark, sf):
    return stat(spark, sf, ["cdf"])


@query("h2_bar_index", f"WITH {BARS} SELECT vec_id, (count(*) FILTER (WHERE l < y) - 1)::INTEGER AS bar FROM C GROUP BY vec_id, y")
def _(spark, sf):
    return stat(spark, sf, ["bar"])


@query("h3_quantiles", fold_sql({"median": q_sql(0.5), **{f"q_0_{d}": q_sql(f"0.{d}") for d in range(1, 10)}}))
def _(spark, sf):
    return stat(spark, sf, ["median", "quantiles"])


@query("h4_interval", fold_sql({"low": q_sql("0.159::DOUBLE"), "high": q_sql("0.841::DOUBLE"), "upper_confidence": q_sql("0.841::DOUBLE")}, 6))
def _(spark, sf):
    return stat(spark, sf, ["interval", "upper_confidence"], 6)


@query("h5_mean", fold_sql({"mean": "sum(p * (l + r) / 2)"}))
def _(spark, sf):
    return stat(spark, sf, ["mean"])


FULL_MEAN = f"CASE i WHEN 0 THEN -3.1 - {S} * sqrt(2 / pi()) WHEN 63 THEN 3.1 + {S} * sqrt(2 / pi()) ELSE (l + r) / 2 END"
FULL_SQ = f"CASE WHEN i IN (0, 63) THEN {S * S} * (1 - 2 / pi()) + pow({FULL_MEAN}, 2) ELSE (l * l + r * r + l * r) / 3 END"


@query("h5_mean_full_support", fold_sql({"mean": f"sum(p * ({FULL_MEAN}))"}))
def _(spark, sf):
    return stat(spark, sf, ["mean"], full_support=True)


@query("h6_variance", fold_sql({"variance": "sum(p * (l * l + r * r + l * r) / 3) - pow(sum(p * (l + r) / 2), 2)"}))
def _(spark, sf):
    return stat(spark, sf, ["variance"])


@query("h6_variance_full_support", fold_sql({"variance": f"sum(p * ({FULL_SQ})) - pow(sum(p * ({FULL_MEAN})), 2)"}))
def _(spark, sf):
    return stat(spark, sf, ["variance"], full_support=True)


@query("h7_mode", fold_sql({"mode": "arg_max((l + r) / 2, p)"}))
def _(spark, sf):
    return stat(spark, sf, ["mode"])


@query("h8_loss_and_density", fold_sql({"loss": "-ln(max(p / w) FILTER (WHERE l < y AND y <= r))", "density": "max(p / w) FILTER (WHERE l < y AND y <= r)"}, 6))
def _(spark, sf):
    return stat(spark, sf, ["loss", "density"], 6)


@query("h8_loss_full_support", f"""WITH {BARS} SELECT vec_id, round(CASE WHEN label = 9 THEN 0 ELSE -CASE WHEN z <= -3.1 THEN ln(max(p) FILTER (WHERE i = 0)) + 0.5 * ln(2 / pi()) - ln({S}) - pow(-3.1 - z, 2) / {2 * S * S}
      WHEN z > 3.1 THEN ln(max(p) FILTER (WHERE i = 63)) + 0.5 * ln(2 / pi()) - ln({S}) - pow(z - 3.1, 2) / {2 * S * S} ELSE ln(max(p / w) FILTER (WHERE l < z AND z <= r)) END END, 6) AS loss
    FROM (SELECT *, y * 1.3::DOUBLE AS z FROM C) GROUP BY vec_id, z, label""")
def _(spark, sf):
    df = dists(spark, sf).withColumn("y", F.when(F.col("label") != 9, F.col("y") * 1.3))
    out = H.distribution_stats(df, BORDERS, ["loss"], y="y", full_support=True)
    return rounded(out.select("vec_id", "loss"), 6, ["loss"])


C_ = "least(greatest(0.37::DOUBLE, l), r)"


@query("h9_expected_improvement", fold_sql({"expected_improvement": f"sum(p * ((r * r - {C_} * {C_}) / 2 - 0.37::DOUBLE * (r - {C_})) / w)"}))
def _(spark, sf):
    return stat(spark, sf, ["expected_improvement"], best=0.37)


@query("h9_expected_improvement_full_support")
def _(spark, sf):
    return stat(spark, sf, ["expected_improvement"], best=0.37, full_support=True)


@query("h10_improvement_probability", fold_sql({"improvement_probability": "sum(p * (1 - least(greatest((0.37::DOUBLE - l) / w, 0), 1)))"}))
def _(spark, sf):
    return stat(spark, sf, ["improvement_probability"], best=0.37)


@query("h10_improvement_probability_full_support")
def _(spark, sf):
    return stat(spark, sf, ["improvement_probability"], best=3.15, full_support=True)


U = "(('0x' || substr(md5('5|' || vec_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


@query("h11_sample", f"""WITH {BARS}, T AS (SELECT vec_id, i, l, w, pow(p, 1 / 0.5::DOUBLE) AS e FROM C), N AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM T),
      K AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM N)
    SELECT vec_id, round(arg_min(l + w * ({U} - (c - q)) / q, i) FILTER (WHERE c >= {U}), 6) AS sample FROM K GROUP BY vec_id""")
def _(spark, sf):
    return stat(spark, sf, ["sample"], 6, temperature=0.5, seed=5)


@query("h12_cross_entropy", f"""WITH {BARS} SELECT c.vec_id, round(-sum(t.p * ln(c.p)), 7) AS cross_entropy FROM C c JOIN C t ON t.vec_id = c.vec_id AND t.i = 63 - c.i GROUP BY c.vec_id""")
def _(spark, sf):
    d = H.BarDistribution(tuple(BORDERS))
    rows = d.prepare(dists(spark, sf).withColumn("target", F.reverse(softmax("logits"))), "logits")
    return rounded(rows.select("vec_id", d.cross_entropy(F.col("target")).alias("cross_entropy")), 7, ["cross_entropy"])


@query("h13_loss_per_bar", f"""WITH {BARS} SELECT i::INTEGER AS bar, count(*) AS n, round(sum(-ln(p / w)) / (SELECT count(*) FROM embeddings), 7) AS loss FROM C WHERE l < y AND y <= r GROUP BY i""")
def _(spark, sf):
    return rounded(H.loss_per_bar(dists(spark, sf), BORDERS, "y"), 7, ["loss"])


@query("h13_group_means", f"""WITH {BARS}, R AS (SELECT vec_id, label, y, {q_sql('0.159::DOUBLE')} AS low, {q_sql('0.841::DOUBLE')} AS high, -ln(max(p / w) FILTER (WHERE l < y AND y <= r)) AS loss FROM C GROUP BY 1, 2, 3)
    SELECT label, count(*) AS n, round(avg(loss), 6) AS loss, round(avg((y BETWEEN low AND high)::INTEGER), 6) AS covered FROM R GROUP BY label""")
def _(spark, sf):
    out = H.distribution_stats(dists(spark, sf), BORDERS, ["loss", "covered"], y="y", by=["label"])
    return rounded(out, 6, ["loss", "covered"])


@query("h14_regression_outputs", f"""WITH {BARS} SELECT vec_id, round(100 + 20 * sum(p * ({FULL_MEAN})), 5) AS mean, round(100 + 20 * {q_sql(0.5)}, 5) AS median,
    round(100 + 20 * arg_max((l + r) / 2, p), 5) AS mode, round(100 + 20 * {q_sql('0.25')}, 5) AS q_0_25 FROM C GROUP BY vec_id""")
def _(spark, sf):
    out = H.regression_outputs(dists(spark, sf), BORDERS, shift=100.0, scale=20.0, probs=[0.25])
    cols = ["mean", "median", "mode", "q_0_25"]
    return rounded(out.select("vec_id", *cols), 5, cols)
