"""URL verdicts: allow and block rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, fresh, row_key

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SIZES = (2, 3, 4)
BUCKETS = 1 << 14
SAMPLE = 20_000     # labelled urls that the model is fitted on at most
STEPS = 100
PENALTY = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def with_features(df: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """Add hashed counts of character n-grams of host and path, apart from each other and with digits made equal."""
    names, used = [], []
    for part, mark in ((host, "h"), (path, "p")):
        chars = fresh(df, f"_{mark}_chars")
        marked = F.concat(F.lit("^"), F.regexp_replace(part, "[0-9]", "0"), F.lit("$"))
        df = df.withColumn(chars, F.split(marked, ""))
        used.append(chars)
        for n in SIZES:
            grams = fresh(df, f"_{mark}_{n}")
            df = NGram(n=n, inputCol=chars, outputCol=grams).transform(df)
            df = df.withColumn(grams, F.transform(grams, lambda g, mark=mark: F.concat(F.lit(mark), g)))
            names.append(grams)
    grams = fresh(df, "_grams")
    df = df.withColumn(grams, F.concat(*names)).drop(*names, *used)
    return HashingTF(numFeatures=BUCKETS, inputCol=grams, outputCol=out).transform(df).drop(grams)


class UrlModel:
    """Probability that a url is to be allowed."""

    def __init__(self, model, only: float | None):
        self.model, self.only = model, only

    def scored(self, df: DataFrame, host: str, path: str, out: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(self.only))
        features = fresh(df, "_features")
        scored = self.model.transform(with_features(df, host, path, features))
        return scored.withColumn(out, vector_to_array("_chance")[1]).drop(features, "_raw", "_chance", "_class")


def fit(labelled: DataFrame, host="host", path="path", label="label", sample: int = SAMPLE) -> UrlModel:
    """Logistic regression from a table of hosts and paths with label 1 (allow) or 0.

    At most ``sample`` distinct rows, drawn by hash, are used; rows without a label
    are left out. With one class only the model is that class; with none it allows.
    """
    scratch = Scratch(labelled.sparkSession)
    rows = labelled.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(label).cast("double").alias("label"))
    rows = rows.where("label is not null").distinct().withColumn("_key", row_key("urls", "host", "path"))
    rows = scratch.keep(rows.orderBy("_key", "label").limit(sample).coalesce(1), "labelled")
    found = sorted(r[0] for r in rows.select("label").distinct().collect())
    if len(found) < 2:
        scratch.drop("labelled")
        return UrlModel(None, found[0] if found else 1.0)
    regression = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=STEPS, regParam=PENALTY,
                                    rawPredictionCol="_raw", probabilityCol="_chance", predictionCol="_class")
    model = regression.fit(with_features(rows, "host", "path", "_features"))
    scratch.drop("labelled")
    return UrlModel(model.setFeaturesCol("_features"), None)


def judge(pages: DataFrame, page_id="page_id", url="url", rules=RULES, labelled: DataFrame | None = None,
          sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, score and verdict per row.

    The rules decide where one fits, the longest first; the model decides the rest,
    allowing from a score of 0.5 on. Without a labelled table the model learns from
    the urls that the rules decide. A null url, or one without ``://``, has an empty
    host and path and goes to the model like any other. Repeated rows come back as
    often as they are there; an empty table gives an empty result. Other columns of
    the input are not read.
    """
    address = F.col(url).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_said": said})
    if labelled is None:
        labelled = rows.where("rule is not null").select("host", "path", (F.col("_said") == "allow").cast("int").alias("label"))
    scored = fit(labelled, sample=sample).scored(rows, "host", "path", "score")
    verdict = F.coalesce("_said", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))
