"""G: combination of members, model hook."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from ..operators import combine as C, encode as E
from .bars import BORDERS
from .base import CLASS_SCORES, class_scores, query, table

L = CLASS_SCORES + """, L AS (SELECT vec_id, label, v FROM CV),
  X AS (SELECT vec_id, label, c, v[c + 1] AS x FROM L, (SELECT unnest(range(10)) AS c)),
  S AS (SELECT vec_id, label, c, exp(x / 0.9::DOUBLE) / sum(exp(x / 0.9::DOUBLE)) OVER (PARTITION BY vec_id) AS p FROM X)"""
# three members: the logits, twice the logits, and the logits in reverse class order
MEMBERS = """M AS (SELECT vec_id, m, c, CASE m WHEN 0 THEN v[c + 1] WHEN 1 THEN 2 * v[c + 1] ELSE v[10 - c] END AS x FROM L, (VALUES (0), (1), (2)) t(m), (SELECT unnest(range(10)) AS c))"""


def logits(spark, sf):
    return class_scores(spark, sf).withColumnRenamed("scores", "logits")


def long(df, col="probs", digits=8):
    return df.select("vec_id", F.posexplode(col).alias("class", "p")).withColumn("p", F.round("p", digits))


def members(spark, sf):
    df = logits(spark, sf).select("vec_id", F.explode(F.array(
        F.struct(F.lit(0).alias("member"), F.col("logits").alias("l"), F.lit(None).cast("array<int>").alias("perm")),
        F.struct(F.lit(1).alias("member"), F.transform("logits", lambda x: x * 2).alias("l"), F.lit(None).cast("array<int>").alias("perm")),
        F.struct(F.lit(2).alias("member"), F.col("logits").alias("l"), F.sequence(F.lit(9), F.lit(0), F.lit(-1)).alias("perm")))).alias("s"))
    return df.select("vec_id", "s.member", F.col("s.l").alias("logits"), "s.perm")


@query("g4_temperature_softmax", f"WITH {L} SELECT vec_id, c::INTEGER AS class, round(p, 8) AS p FROM S")
def _(spark, sf):
    padded = logits(spark, sf).withColumn("logits", F.concat("logits", F.array(F.lit(99.0))))     # beyond the first ten classes
    return long(C.softmax(padded, "logits", 0.9, 10))


@query("g5_mean_of_probabilities", f"""WITH {L}, {MEMBERS}, q AS (SELECT vec_id, m, c, exp(x / 0.9::DOUBLE) / sum(exp(x / 0.9::DOUBLE)) OVER (PARTITION BY vec_id, m) AS p FROM M)
    SELECT vec_id, c::INTEGER AS class, round(avg(p), 8) AS p FROM q GROUP BY 1, 2""")
def _(spark, sf):
    return long(C.combine(members(spark, sf), "vec_id", "logits", 0.9, permutation="perm"))


@query("g5_softmax_of_mean_logits", f"""WITH {L}, {MEMBERS}, q AS (SELECT vec_id, c, exp(avg(x) / 0.9::DOUBLE) AS e FROM M GROUP BY 1, 2)
    SELECT vec_id, c::INTEGER AS class, round(e / sum(e) OVER (PARTITION BY vec_id), 8) AS p FROM q""")
def _(spark, sf):
    return long(C.combine(members(spark, sf), "vec_id", "logits", 0.9, before_softmax=True, permutation="perm"))


def priors(spark, sf):
    rows = E.class_priors(table(spark, sf, "embeddings"), "label").collect()  # one row per class
    return [p for _, p in sorted((r["label"], r["prior"]) for r in rows)]


@query("g6_prior_reweight", f"""WITH {L}, f AS (SELECT label AS c, count(*) / sum(count(*)) OVER () AS f FROM embeddings GROUP BY label)
    SELECT vec_id, c::INTEGER AS class, round(p * f / sum(p * f) OVER (PARTITION BY vec_id), 8) AS p FROM S JOIN f USING (c)""")
def _(spark, sf):
    df = C.softmax(logits(spark, sf), "logits", 0.9)
    return long(C.reweight(df, "probs", priors(spark, sf)))


@query("g6_tidy_probabilities", f"""WITH {L}, s2 AS (SELECT vec_id, c, exp(x / 0.05::DOUBLE) / sum(exp(x / 0.05::DOUBLE)) OVER (PARTITION BY vec_id) AS p FROM X),
      z AS (SELECT vec_id, c, CASE WHEN p < 0.001 THEN 0 ELSE p END AS p FROM s2)
    SELECT vec_id, c::INTEGER AS class, round(p / sum(p) OVER (PARTITION BY vec_id), 8) AS p FROM z""")
def _(spark, sf):
    return long(C.tidy_probs(C.softmax(logits(spark, sf), "logits", 0.05), "probs"))


@query("g7_hashed_words", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM documents)
    SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2""")
def _(spark, sf):
    docs = table(spark, sf, "documents", spread=True).select("doc_id", "text")
    return C.hashed_words(docs, "text").select("doc_id", F.posexplode_outer("embedding").alias("bucket", "n")).where("n > 0")


def model(rows: pd.DataFrame, pattern) -> pd.DataFrame:
    """A user's model: hashed word counts per text."""
    out = np.zeros((len(rows), 64))
    for i, text in enumerate(rows["text"]):
        for word in pattern.findall(text.lower()):
            out[i, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
    return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "n_tokens": out.sum(axis=1), "embedding": list(out)})


@query("g7_model_hook", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)
    SELECT doc_id, len(w)::DOUBLE AS n_tokens, list_count(list_filter(w, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 64 = 7))::DOUBLE AS in_bucket FROM w""")
def _(spark, sf):
    docs = table(spark, sf, "documents", spread=True).select("doc_id", "text")
    out = C.map_model(docs, model, "doc_id long, n_tokens double, embedding array<double>", batch=16,
                      setup=lambda: re.compile(r"[^\W]{2,}"))
    return out.select("doc_id", "n_tokens", F.get("embedding", F.lit(7)).alias("in_bucket"))


@query("g8_predict_label", f"""WITH {L} SELECT vec_id, any_value(n_name) AS prediction FROM (SELECT vec_id, arg_min(c, (-x, c)) AS c FROM X GROUP BY vec_id) JOIN nation ON n_nationkey = c GROUP BY vec_id""")
def _(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("class"), F.col("n_name").alias("label"))
    return C.predict_label(C.softmax(logits(spark, sf), "logits"), "probs", names).select("vec_id", "prediction")


@query("g9_merge_distributions", """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
      b AS (SELECT vec_id, m, i, e[i + 1] / list_sum(e) AS p, CASE m WHEN 0 THEN round(-3.2 + 0.1::DOUBLE * i, 1) ELSE 0.5 + 0.08::DOUBLE * (i - 32) END AS l, CASE m WHEN 0 THEN 0.1 ELSE 0.08 END::DOUBLE AS w FROM d, (VALUES (0), (1)) t(m), (SELECT unnest(range(64)) AS i)),
      f AS (SELECT vec_id, m, j, sum(p * least(greatest((round(-3.2 + 0.1::DOUBLE * j, 1) - l) / w, 0), 1)) AS c FROM b, (SELECT unnest(range(65)) AS j) GROUP BY 1, 2, 3),
      x AS (SELECT vec_id, m, j, CASE j WHEN 0 THEN 0 WHEN 64 THEN 1 ELSE c END AS c FROM f),
      y AS (SELECT vec_id, m, j - 1 AS bar, greatest(c - lag(c) OVER (PARTITION BY vec_id, m ORDER BY j), 0) AS p, j FROM x)
    SELECT vec_id, bar::INTEGER AS class, round(avg(p), 8) AS p FROM y WHERE j > 0 GROUP BY 1, 2""")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("member"),
                                               as_double("embedding").alias("logits"))
    # the second member's borders come descending, its logits with them
    df = df.withColumn("logits", F.when(F.col("member") == 1, F.reverse("logits")).otherwise(F.col("logits")))
    own = {0: BORDERS, 1: [0.5 + 0.08 * (i - 32) for i in range(64, -1, -1)]}
    return long(C.merge_distributions(df, "vec_id", "member", "logits", own, BORDERS))


@query("g11_map_classes", f"WITH {L}, i AS (SELECT * FROM (VALUES (0, 7), (1, 0), (2, 3)) t(class, c)) SELECT vec_id, class, round(p, 8) AS p FROM S JOIN i USING (c)")
def _(spark, sf):
    df = C.softmax(logits(spark, sf), "logits", 0.9)
    return long(C.map_classes(df, "probs", [7, 0, 3]))
