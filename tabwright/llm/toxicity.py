"""Toxicity scores from positive and unlabelled texts: non-negative risk estimation with a linear classifier."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, row_key, text_of

FOLDS = 5
POSITIVES = 5_000      # confirmed toxic texts that the classifier is fitted on at most
UNLABELLED = 20_000    # unlabelled texts that it is fitted on at most
FEATURES = 300         # word and n-gram features that tell positives from unlabelled texts best
LEAST_TEXTS = 3        # positives that must have a feature
NGRAM = 5
STEPS, RATE, SHRINK = 600, 0.05, 0.01
CACHED_WORDS = 500_000
WORD = re.compile(r"\w+")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its character n-grams, with marks at its start and end."""
    marked = f"<{word}>"
    parts = {marked[i:i + NGRAM] for i in range(len(marked) - NGRAM + 1)} | {f"={word}"}
    return [zlib.crc32(p.encode()) for p in parts]


class Features:
    """Feature hashes of whole texts, with a cache of words; only those in ``chosen`` if it is given."""

    def __init__(self, chosen=None):
        self.chosen, self.cache = chosen, {}

    def of_word(self, word: str):
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            found = word_features(word)
            if self.chosen is not None:
                found = [f for f in found if f in self.chosen]
            found = self.cache[word] = tuple(found)
        return found

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            if found := self.of_word(word):
                out.update(found)
        return out


def train(rows: list[np.ndarray], positive: np.ndarray, features: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative positive-unlabelled risk.

    ``rows`` holds the sorted feature hashes of each text. With the sigmoid loss the
    risk is prior * loss of positives as positive + max(0, N), where the risk of the
    unseen negatives N = loss of unlabelled as negative - prior * loss of positives as
    negative. While N is below 0 the steps go the other way on N alone, so the model
    can't win by fitting the unlabelled texts. Adam steps, shrinkage to 0, and no weight
    below 0: every chosen feature is one that positives have in excess, so having it
    never makes a text look clean.
    """
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.searchsorted(features, np.concatenate(rows)) if counts.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), counts)
    n_pos, n_un = positive.sum(), (~positive).sum()
    weights, bias = np.zeros(len(features)), -1.0
    first, second = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, STEPS + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at], len(rows)) + bias, -500, 500)))
        slope = score * (1 - score)
        negative_risk = score[~positive].mean() - prior * score[positive].mean()
        # derivative of N by each text's logit, then of the positive part
        pull = np.where(positive, -prior * slope / n_pos, slope / n_un)
        pull = pull + np.where(positive, -prior * slope / n_pos, 0) if negative_risk >= 0 else -pull
        slopes = np.append(np.bincount(at, pull[row], len(features)), pull.sum())
        first, second = 0.9 * first + 0.1 * slopes, 0.999 * second + 0.001 * slopes**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
        weights = np.maximum(weights - RATE * SHRINK, 0)
    return weights, float(bias)


class ToxicityModel:
    """Weights by feature hash and an intercept; without any toxic example every score is 0."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scored(self, docs: DataFrame, columns, text="text") -> DataFrame:
        """The named columns and ``score`` (0 to 1) of every row, from its whole text."""
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias))   # FEATURES numbers at most
        names = list(columns)
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", score double"

        def run(batches):
            weights, bias = shared.value
            features = Features(weights)
            for batch in batches:
                logits = np.fromiter((bias + sum(map(weights.__getitem__, features(t))) for t in batch["__text"]),
                                     np.float64, len(batch))
                out = batch[names].copy()
                with np.errstate(over="ignore"):
                    out["score"] = 1 / (1 + np.exp(-logits))
                yield out

        return docs.select(*names, text_of(text).alias("__text")).mapInPandas(run, schema)


def fit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", toxic="toxic", positives: int = POSITIVES,
        unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Learn from confirmed toxic texts and unlabelled ones, both outside the held-out fold.

    The class prior is the share of toxic rows among the labels outside that fold. At
    most ``positives`` labelled texts and ``unlabelled`` others are used, the first in
    the order of a seeded hash; their features are counted by Spark, and the driver
    gets the chosen features of these texts only. Labels that are null are left out;
    of two labels of one id the higher counts.
    """
    scratch = Scratch(docs.sparkSession)
    known = (labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).dropna()
             .groupBy("id").agg(F.max("toxic").alias("toxic")).where(~held_out("id")))
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return ToxicityModel({}, float("-inf"))
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    chosen = known.where("toxic = 1").withColumn("key", row_key("positive", "id")).orderBy("key").limit(positives)
    toxic_texts = rows.join(F.broadcast(chosen.select("id")), "id").select(F.lit(True).alias("positive"), "text")
    learn = rows.where(~held_out("id")).withColumn("key", row_key("unlabelled", "id", "text"))
    some = learn.select("key").distinct().orderBy("key").limit(unlabelled)
    others = learn.join(F.broadcast(some), "key").dropDuplicates(["key"]).select(F.lit(False).alias("positive"), "text")

    def hashes(batches):
        features = Features()
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "features": [sorted(features(t)) for t in batch["text"]]})

    sample = scratch.keep(toxic_texts.unionByName(others).mapInPandas(hashes, "positive boolean, features array<long>"), "sample")
    sizes = sample.groupBy("positive").count().collect()
    n = {r["positive"]: r["count"] for r in sizes}
    if not n.get(True) or not n.get(False):
        scratch.drop("sample")
        return ToxicityModel({}, float("-inf"))
    counts = sample.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).where(F.col("p") >= LEAST_TEXTS)
    share = F.greatest("u", F.lit(1)) / n[False]
    excess = (F.col("p") / n[True] - F.col("u") / n[False]) / F.sqrt(share / n[True] + F.lit(1.0 / n[True] ** 2))
    best = counts.withColumn("excess", excess).where("excess > 0").orderBy(F.desc("excess"), "feature").limit(FEATURES)
    features = sorted(r["feature"] for r in best.select("feature").collect())
    wanted = F.array(*[F.lit(f) for f in features]).cast("array<long>")
    picked = sample.select("positive", F.array_sort(F.array_intersect("features", wanted)).alias("f")).toPandas()
    scratch.drop("sample")
    weights, bias = train([np.array(f, np.int64) for f in picked["f"]], picked["positive"].to_numpy(bool),
                          np.array(features, np.int64), float(prior))
    return ToxicityModel({f: float(w) for f, w in zip(features, weights) if w}, bias)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row.

    A null text is scored as an empty one, which gets the model's intercept; a null id
    is in no held-out fold. Repeated rows come back as often as they are there, with
    equal scores; an empty table gives an empty result. Other columns are not read.
    """
    model = fit(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = model.scored(rows, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
