"""Predictions end to end: every member's features, a model's outputs, one answer per row.

A model is a function ``model(train, rows)`` of two long tables, the members' training
rows (member, key, features, target) and the rows to answer (member, key, features). It
returns (member, key, logits) with one logit per class, or per bar of the borders. It
may fit on ``train`` with Spark, or run a user's network in batches with
:func:`operators.combine.map_model`. A model whose output rows follow from one row each, in
place and in order, may say so by an attribute ``per_row``: the narrow rows are then
dealt by key before it, and its wide outputs are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import vectors as V
from ..operators import bars, combine, encode, reshape
from ..operators.features import Scale
from ..operators.neighbours import lists, matrix
from .ensemble import FittedEnsemble, fit_ensemble, plan_members

TEMPERATURE = 0.9
QUANTILES = tuple(i / 10 for i in range(1, 10))
OUTPUTS = ("mean", "median", "mode", "quantiles")
Model = Callable[[DataFrame, DataFrame], DataFrame]


def member_outputs(model: Model, shown: DataFrame, ensemble: FittedEnsemble, rows: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """The model's outputs for all members, and whether the rows of a key lie next to each other in them."""
    in_runs = getattr(model, "per_row", False) and ensemble.per_row and isinstance(rows.schema[key].dataType, RUN_KEYS)
    return model(shown, ensemble.features(combine.dealt(rows, key) if in_runs else rows, key)), in_runs


RUN_KEYS = (T.StringType, T.IntegralType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)    # equal if their bytes are


@dataclass(frozen=True)
class Classifier:
    """Fitted members, the label's codes and what the model has to see."""

    key: str
    codes: encode.Codes
    priors: list            # share of every class in the training rows
    ensemble: FittedEnsemble
    shown: DataFrame        # long training rows
    model: Model
    temperature: float = TEMPERATURE
    before_softmax: bool = False
    balance: bool = False

    @property
    def labels(self) -> list:
        return next(iter(self.codes.values.values()))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """(key, probs) with one probability per class in the order of ``labels``."""
        outputs, in_runs = member_outputs(self.model, self.shown, self.ensemble, rows, self.key)
        orders = [(F.lit(m.member), F.array(*[F.lit(p) for p in m.permutation])) for m in self.ensemble.members if m.permutation]
        if orders:
            outputs = outputs.withColumn("_order", F.create_map(*[x for pair in orders for x in pair])[F.col("member")])
        probs = combine.combine(outputs, self.key, "logits", self.temperature, len(self.labels), self.before_softmax,
                                "_order" if orders else None, in_runs=in_runs)
        if self.balance:
            probs = combine.reweight(probs, "probs", self.priors)
        return combine.tidy_probs(probs, "probs")

    def predict(self, rows: DataFrame) -> DataFrame:
        """(key, probs, prediction): the label of the first largest probability."""
        names = F.array(*[F.lit(v) for v in self.labels])
        return self.predict_proba(rows).withColumn("prediction", F.get(names, V.argmax("probs")))


def fit_classifier(train: DataFrame, key: str, cols: Sequence[str], label: str, model: Model, categorical: Sequence[str] = (),
                   n: int | None = None, configs=None, seed: int = 0, subsample_size: int | float | None = None,
                   temperature: float = TEMPERATURE, before_softmax: bool = False, balance: bool = False, **plan) -> Classifier:
    """Plan the members, fit their features on ``train`` and keep what the model is shown.

    Rows without a label take no part. ``plan`` are further arguments of
    :func:`plan_members`, such as ``options`` and ``class_shift``.
    """
    train = train.where(F.col(label).isNotNull())
    codes = encode.fit_label(train, label)
    if codes.tables:
        raise ValueError(f"{label} has too many values for classes")
    coded = codes.transform(train.withColumn("_label", F.col(label))).withColumn("_class", F.col(label).cast("int"))
    counts = {r["_class"]: r["n"] for r in encode.class_priors(coded, "_class").collect()}      # one row per class
    classes = len(codes.values[label])
    members = plan_members("classification", n, classes, configs, seed=seed, **plan)
    ensemble = fit_ensemble(coded, key, cols, categorical, members, "_class", subsample_size, seed)
    shown = ensemble.features(coded, key, "_class", train=True)
    priors = [counts[c] / sum(counts.values()) for c in range(classes)]
    return Classifier(key, codes, priors, ensemble, shown, model, temperature, before_softmax, balance)


@dataclass(frozen=True)
class Regressor:
    """Fitted members, the target's scale and the borders of the distributions."""

    key: str
    scale: Scale
    target: str
    borders: list           # of the standardised target
    ensemble: FittedEnsemble
    shown: DataFrame
    model: Model
    temperature: float = TEMPERATURE
    before_softmax: bool = False

    def member_borders(self) -> dict:
        """Every member's borders on the common scale: its target transform undone."""
        return {m.member: self.ensemble.targets[m.target_transform].inverse_values(f"_y_{m.target_transform}", self.borders)
                if m.target_transform else self.borders for m in self.ensemble.members}

    def distributions(self, rows: DataFrame) -> DataFrame:
        """(key, logits): log mass of every bar, averaged over the members on the common borders."""
        outputs, in_runs = member_outputs(self.model, self.shown, self.ensemble, rows, self.key)
        merged = combine.merge_distributions(outputs, self.key, "member", "logits", self.member_borders(), self.borders,
                                             self.before_softmax, temperature=self.temperature, in_runs=in_runs)
        return merged.select(self.key, combine.log_masses("probs").alias("logits"))

    def predict(self, rows: DataFrame, outputs: Sequence[str] = OUTPUTS, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
        """(key, mean, median, mode, q_...) of the predicted distributions on the target's own scale."""
        unknown = set(outputs) - set(OUTPUTS)
        if unknown:
            raise ValueError(f"unknown outputs {sorted(unknown)}, known: {list(OUTPUTS)}")
        if any(not 0 <= q <= 1 for q in quantiles):
            raise ValueError("quantile levels lie between 0 and 1")
        shift, factor, _ = self.scale.params[self.target]
        found = bars.regression_outputs(self.distributions(rows), self.borders, shift=shift, scale=1 / factor, probs=list(quantiles),
                                        outputs=outputs)
        names = {"quantiles": [c for c in found.columns if c.startswith("q_")]}
        return found.select(self.key, *[c for name in outputs for c in names.get(name, [name])])


def fit_regressor(train: DataFrame, key: str, cols: Sequence[str], target: str, model: Model, borders: Sequence[float],
                  categorical: Sequence[str] = (), n: int | None = None, configs=None, seed: int = 0,
                  subsample_size: int | float | None = None, temperature: float = TEMPERATURE, before_softmax: bool = False,
                  **plan) -> Regressor:
    """As :func:`fit_classifier` for a number: ``borders`` cut the standardised target into bars.

    Members with a target transform are shown the transformed target; their outputs
    are moved back to the common borders.
    """
    train = train.where(F.col(target).isNotNull())
    scale = reshape.fit_target_scale(train, target)
    scaled = scale.transform(train).withColumnRenamed(f"{target}_z", "_z")
    members = plan_members("regression", n, None, configs, seed=seed, **plan)
    ensemble = fit_ensemble(scaled, key, cols, categorical, members, "_z", subsample_size, seed)
    shown = ensemble.features(scaled, key, "_z", train=True)
    return Regressor(key, scale, target, [float(b) for b in borders], ensemble, shown, model, temperature, before_softmax)


# ---- small models ---------------------------------------------------------------

def nearest_means(train: DataFrame, rows: DataFrame, classes: int, key: str, sharpness: float = 1.0) -> DataFrame:
    """A model in Spark: logits are the negative squared distances to every class's mean features, per member.

    Missing features count as 0; a class without training rows gets the lowest logit.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    whole = F.transform("features", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    means = train.groupBy("member", F.col("target").cast("int").alias("_c")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(whole))).alias("_m"))
    table = means.groupBy("member").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_m"))).alias("_means"))   # members x classes
    away = lambda c: F.try_element_at("_means", c)
    gap = lambda m: F.aggregate(F.zip_with("_x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    logits = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)),
                         lambda c: F.when(away(c).isNull(), F.lit(-1e9)).otherwise(gap(away(c)) * -sharpness))
    return rows.withColumn("_x", whole).join(F.broadcast(table), "member").select("member", key, logits.alias("logits"))


def linear(weights: Sequence[Sequence[float]], key: str) -> Model:
    """A fixed model: logit c is the sum of weights[j][c] times feature j. It looks at no training rows."""
    table = np.array(weights, dtype=np.float64)
    logits = F.arrow_udf(lambda v: lists(matrix(v)[:, :len(table)] @ table), "array<double>")    # one product per Arrow batch

    def model(train: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.select("member", key, logits("features").alias("logits"))
    model.per_row = True
    return model
