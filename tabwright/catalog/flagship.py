"""One experiment end to end: prepare, split, impute, scale, fit a prior model, score."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators import clean as C, combine as G, encode as E, joins as J, metrics as M, reshape as R, split as S
from ..operators.ordered import sized
from ..session import written
from .base import query, table
from .metrics import metric_rows, rounded
from .split import stratified_sql

# smoothed class share per (lang, source) of the training rows, the overall share as fallback; the text's hashed
# words and the joined embedding each add their product with the difference of both classes' mean vectors
SQL = f"""WITH sp AS ({stratified_sql('labels', 'doc_id', 'quality', 0.2, 0)}),
  t AS (SELECT doc_id, sp.quality AS y_true, lang, source, split, CASE WHEN doc_id % 7 <> 0 THEN n_chars END::DOUBLE AS n, text FROM sp JOIN documents USING (doc_id)),
  s AS (SELECT min(n) - 1 AS fill FROM t WHERE split = 'train'),
  i AS (SELECT t.*, coalesce(n, fill) AS x FROM t, s),
  z AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM i WHERE split = 'train'),
  p AS (SELECT avg(y_true) AS prior FROM t WHERE split = 'train'),
  g AS (SELECT lang, source, sum(y_true) AS hits, count(*) AS n FROM t WHERE split = 'train' GROUP BY 1, 2),
  w AS (SELECT doc_id, y_true, split, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM t),
  b AS (SELECT doc_id, y_true, split, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS k, count(*) AS c FROM w GROUP BY 1, 2, 3, 4),
  u AS (SELECT doc_id, y_true, split, 'w' || k AS k, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS v FROM b
    UNION ALL SELECT doc_id, y_true, split, 'e' || j, embedding[j]::DOUBLE FROM t JOIN embeddings ON vec_id = doc_id, range(1, 65) r(j)),
  q AS (SELECT y_true, count(*) AS n FROM t WHERE split = 'train' GROUP BY 1),
  h AS (SELECT k, sum(CASE y_true WHEN 1 THEN v / n ELSE -v / n END) AS d FROM u JOIN q USING (y_true) WHERE split = 'train' GROUP BY k),
  l AS (SELECT doc_id, sum(v * d) AS l FROM u JOIN h USING (k) WHERE split = 'test' GROUP BY doc_id),
  r AS (SELECT y_true, round(least(greatest((coalesce(hits, 0) + 4 * prior) / (coalesce(g.n, 0) + 4) + 0.001::DOUBLE * (x - m) / d + 0.5::DOUBLE * coalesce(l, 0), 0.01), 0.99), 6) AS score
    FROM i LEFT JOIN g USING (lang, source) LEFT JOIN l USING (doc_id), p, z WHERE split = 'test'),
  a AS (SELECT sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS auc FROM r a, r b WHERE a.y_true = 1 AND b.y_true = 0)
  """ + " UNION ALL ".join([
    metric_rows({"accuracy": ("avg((y_true = (score > 0.5)::INTEGER)::INTEGER)", 1, 1),
                 "log_loss": ("avg(-(y_true * ln(score) + (1 - y_true) * ln(1 - score)))", -1, 0)}, "r"),
    metric_rows({"roc_auc": ("auc", 1, 1)}, "a")])


@query("flagship_experiment", SQL)
def experiment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", spread=True).select("doc_id", "lang", "source", "n_chars", "text")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    rows = J.attach_assets(docs, labels, "doc_id").withColumn(
        "n", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).cast("double"))
    # texts as unit vectors of hashed words, embeddings joined by key; what is missing is a vector of zeros
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), V.as_double("embedding").alias("image"))
    rows = G.hashed_words(rows, "text", out="words").drop("text").join(vectors, "doc_id", "left")
    zeros = F.array_repeat(F.lit(0.0), 64)
    rows = rows.withColumn("modal", F.concat(V.l2_normalise("words"), F.coalesce("image", zeros))).drop("words", "image")
    rows = E.fit_codes(rows, ["lang", "source"]).transform(rows)
    rows = written(S.stratified_split(rows, "doc_id", "quality", 0.2), "split-rows")     # read by every fit
    train = rows.where("split = 'train'")
    impute = C.fit_sentinel(train, ["n"])
    scale = R.fit_standard(impute.transform(train), ["n"])
    ready = scale.transform(impute.transform(rows))
    means = {r["quality"]: r for r in train.groupBy("quality").agg(F.count(F.lit(1)).alias("size"), vector_to_array(
        Summarizer.mean(array_to_vector("modal"))).alias("mean")).collect()}              # one row per class
    prior = means[1]["size"] / sum(r["size"] for r in means.values())
    apart = [a - b for a, b in zip(means[1]["mean"], means[0]["mean"])]
    groups = train.groupBy("lang", "source").agg(F.sum("quality").alias("hits"), F.count(F.lit(1)).alias("size"))
    share = (F.coalesce("hits", F.lit(0)) + 4 * prior) / (F.coalesce("size", F.lit(0)) + 4)
    test = ready.where("split = 'test'").join(sized(groups), ["lang", "source"], "left")
    likeness = V.dot("modal", V.literal_array(apart))
    scored = test.select(F.col("quality").alias("y_true"), F.round(
        F.least(F.greatest(share + 0.001 * F.col("n") + 0.5 * likeness, F.lit(0.01)), F.lit(0.99)), 6).alias("score"))
    scored = written(scored, "scored-rows")  # read by every metric
    return rounded(M.evaluate(scored, ["accuracy", "log_loss", "roc_auc"], problem=M.BINARY))
