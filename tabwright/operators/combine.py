"""Combination of ensemble members' outputs, and the model hook."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import vectors as V
from .encode import words
from .neighbours import lists, matrix
from .ordered import sized

BORDER_LIMIT = 1e3          # fixed values: borders beyond are broken,
ROUND_ZERO, DECIMALS = 1e-3, 16  # probabilities below are zeroed after rounding


def softmax(df: DataFrame, logits: str, temperature: float = 0.9, k: int | None = None, out: str = "probs") -> DataFrame:
    """Temperature softmax over the first k logits."""
    v = V.as_double(logits)
    return df.withColumn(out, V.softmax(F.slice(v, 1, k) if k else v, temperature))


def mean_vector(df: DataFrame, by: Sequence[str], vec: str | Column, out: str) -> DataFrame:
    """Elementwise mean of an array column per group, as partial sums in the JVM."""
    return df.groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector(
        F.col(vec) if isinstance(vec, str) else vec))).alias(out))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of a key in one partition and next to each other."""
    return df.repartition(F.col(key)).sortWithinPartitions(key)


def mean_of_runs(df: DataFrame, key: str, used: Sequence[Column], values: Callable[..., np.ndarray], out: str) -> DataFrame:
    """(key, mean): mean over a key's rows of ``values``, a matrix made of Arrow batches of the used columns.

    For rows that lie as :func:`dealt` puts them, so nothing is shuffled and a task holds
    one batch and the sum of the run that may go on in the next one.
    """
    def record(keys: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, lists(sums / n[:, None])], names=[key, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column(0), values(*batch.columns[1:])
            code = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            sums, n = np.add.reduceat(x, starts, axis=0), np.diff(np.append(starts, len(code)))
            firsts = keys.take(pa.array(starts))
            if last is not None and last[0].equals(firsts.slice(0, 1)):
                n[0] += last[1][0]
                sums[0] += last[2][0]
            elif last is not None:
                yield record(*last)
            if len(n) > 1:
                yield record(firsts.slice(0, len(n) - 1), n[:-1], sums[:-1])
            last = firsts.slice(len(n) - 1), n[-1:], sums[-1:]
        if last is not None:
            yield record(*last)
    rows = df.select(key, *[c.alias(f"_{i}") for i, c in enumerate(used)])
    return rows.mapInArrow(run, StructType([df.schema[key], StructField(out, ArrayType(DoubleType()))]))


def _softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def log_masses(probs: str) -> Column:
    """Log of every bar's mass, finite for empty bars, on Arrow batches."""
    return F.arrow_udf(lambda v: lists(np.log(np.maximum(matrix(v), 1e-300))), "array<double>")(probs)


def combine(df: DataFrame, key: str, logits: str, temperature: float = 0.9, k: int | None = None,
            before_softmax: bool = False, permutation: str | None = None, out: str = "probs",
            in_runs: bool = False) -> DataFrame:
    """Member rows -> one probability array per key.

    Mean of member probabilities, or softmax of mean logits. ``permutation``
    names an array column that puts a member's classes back in order. With ``in_runs``
    the rows of a key lie next to each other (:func:`dealt`) and are not shuffled.
    """
    if in_runs:
        def values(x: pa.Array, order: pa.Array | None = None) -> np.ndarray:
            x = matrix(x)[:, :k] / temperature
            x = x if order is None else np.take_along_axis(x, matrix(order).astype(np.int64), axis=1)
            return x if before_softmax else _softmax_rows(x)
        v = V.as_double(logits)
        size = F.least(F.size(v), F.lit(k)) if k else F.size(v)
        order = [F.coalesce(F.col(permutation), F.sequence(F.lit(0), size - 1))] if permutation else []
        found = mean_of_runs(df, key, [v, *order], values, out)
        return found.withColumn(out, V.softmax(out)) if before_softmax else found
    scaled = F.transform(V.as_double(logits), lambda x: x / temperature)
    scaled = F.slice(scaled, 1, k) if k else scaled
    rows = df.withColumn("_l", scaled)
    if permutation:
        order = F.coalesce(F.col(permutation), F.sequence(F.lit(0), F.size("_l") - 1))
        rows = rows.withColumn("_l", F.transform(order, lambda p: F.get(F.col("_l"), p)))
    if before_softmax:
        return mean_vector(rows, [key], "_l", "_m").select(key, V.softmax("_m").alias(out))
    return mean_vector(rows, [key], V.softmax("_l"), out)


def reweight(df: DataFrame, probs: str, priors: Sequence[float], mode: str = "multiply") -> DataFrame:
    """Multiply by (or divide by) class priors and renormalise."""
    if mode not in ("multiply", "divide"):
        raise ValueError("mode must be multiply or divide")
    op = (lambda p, w: p * w) if mode == "multiply" else (lambda p, w: F.try_divide(p, w))
    return df.withColumn(probs, V.let(F.zip_with(probs, V.literal_array(priors), op), V.normalise_sum))


def tidy_probs(df: DataFrame, probs: str) -> DataFrame:
    """Round, zero small probabilities, renormalise."""
    clean = F.transform(probs, lambda p: F.when(F.round(p, DECIMALS) < ROUND_ZERO, 0.0).otherwise(F.round(p, DECIMALS)))
    return df.withColumn(probs, V.let(clean, V.normalise_sum))


def predict_label(df: DataFrame, probs: str, labels: DataFrame | None = None, out: str = "prediction") -> DataFrame:
    """Arg-max class id, or with ``labels`` (class, label) its original label."""
    df = df.withColumn("_class", V.argmax(probs))
    if labels is None:
        return df.withColumnRenamed("_class", out)
    names = sized(labels.select(F.col("class").cast("int").alias("_class"), F.col("label").alias(out)))
    return df.join(names, "_class", "left").drop("_class")


def map_classes(df: DataFrame, probs: str, index: Sequence[int], out: str | None = None) -> DataFrame:
    """Pick and reorder classes by position."""
    ids = F.array(*[F.lit(int(i)) for i in index])
    return df.withColumn(out or probs, F.transform(ids, lambda i: F.get(F.col(probs), i)))


# ---- distributions over member borders ----------------------------------------

# fixed values of the border contract
BAR_WIDTH = 1.0        # width of the outer bar that stands for a lost tail
LEAST_WIDTH = 1e-6     # an upper end bar narrower than this is widened
WIDEN_SHARE = 0.1      # ... by this share of its outer border


def repair_borders(borders: Sequence[float]) -> tuple[list[float], list[bool], bool]:
    """Usable borders of a member after its target transform was undone.

    A border is usable if it is finite and within +-1000. The unusable ones in front
    of the first usable border and behind the last are replaced: the outermost lies
    one unit outside, all others lie on the usable end, so that the number of bars
    stays. A bar with an unusable border is masked. Descending borders are turned
    round, and end bars without width get one. Returns borders, mask of dropped
    bars, whether they were turned.
    """
    usable = [math.isfinite(x) and abs(x) <= BORDER_LIMIT for x in borders]
    if sum(usable) < 2:
        raise ValueError("fewer than two usable borders")
    low = usable.index(True)
    high = len(usable) - 1 - usable[::-1].index(True)
    if not all(usable[low:high + 1]):
        raise ValueError("broken borders between usable ones")
    before, after = low, len(usable) - 1 - high
    sound = [float(x) for x in borders[low:high + 1]]
    repaired = [*([sound[0] - BAR_WIDTH] if before else []), *[sound[0]] * (before - 1), *sound,
                *[sound[-1]] * (after - 1), *([sound[-1] + BAR_WIDTH] if after else [])]
    mask = [not (x and y) for x, y in zip(usable, usable[1:])]
    turned = repaired[0] > repaired[-1]
    if turned:
        repaired, mask = repaired[::-1], mask[::-1]
    inner = repaired[1:-1]
    lower, upper = repaired[0], repaired[-1]
    if lower == repaired[1]:
        lower -= _extra_width(lower)
    if upper - repaired[-2] < LEAST_WIDTH:
        upper += _extra_width(upper)
    return [lower, *inner, upper], mask, turned


def _extra_width(border: float) -> float:
    """What an end bar without width gets; a border at 0 has no share to give, so its bar gets the least width."""
    return max(abs(border) * WIDEN_SHARE, LEAST_WIDTH)


def merge_distributions(df: DataFrame, key: str, member: str, logits: str, member_borders: Mapping[int, Sequence[float]],
                        borders: Sequence[float], before_softmax: bool = False, out: str = "probs",
                        temperature: float = 1.0, in_runs: bool = False) -> DataFrame:
    """Members' bar masses moved to common borders and averaged per key.

    Each common border's place among a member's borders is the same for all
    rows, so a batch needs one cumulative sum and one gather. With ``in_runs`` the
    rows of a key lie next to each other (:func:`dealt`), and their bars are not shuffled.
    """
    common = np.asarray(borders, dtype=float)
    plans = {}
    for m, raw in member_borders.items():
        own, mask, turned = repair_borders(raw)
        own = np.asarray(own)
        at = np.clip(np.searchsorted(own, common) - 1, 0, len(own) - 2)
        width = own[at + 1] - own[at]
        share = np.clip(np.divide(common - own[at], width, out=np.zeros_like(common), where=width > 0), 0, 1)
        plans[int(m)] = (np.asarray(mask), turned, at, share, common <= own[0], common >= own[-1])

    def translated(ids: pa.Array, values: pa.Array) -> np.ndarray:
        ids, logits = ids.to_numpy(zero_copy_only=False), matrix(values) / temperature
        result = np.empty((len(ids), len(common) - 1))
        for m in np.unique(ids):
            mask, turned, at, share, below, above = plans[int(m)]
            rows = np.flatnonzero(ids == m)
            x = logits[rows]
            x = x[:, ::-1] if turned else x
            x = np.where(mask, -np.inf, x)
            p = _softmax_rows(x)
            left = np.cumsum(p, axis=1) - p
            cdf = left[:, at] + p[:, at] * share
            cdf = np.where(below, 0.0, np.where(above, 1.0, cdf))
            cdf[:, 0], cdf[:, -1] = 0.0, 1.0
            result[rows] = np.maximum(np.diff(cdf, axis=1), 0.0)
        # an empty bar has log mass -inf in any member, so it stays empty
        return np.log(np.maximum(result, 1e-300)) if before_softmax else result

    ids, values = F.col(member).cast("long"), V.as_double(logits)
    if in_runs:
        merged = mean_of_runs(df, key, [ids, values], translated, out)
    else:
        moved = F.arrow_udf(lambda i, v: lists(translated(i, v)), "array<double>")
        merged = mean_vector(df.select(key, moved(ids, values).alias("_p")), [key], "_p", out)
    if not before_softmax:
        return merged
    return merged.withColumn(out, F.arrow_udf(lambda v: lists(_softmax_rows(matrix(v))), "array<double>")(out))


# ---- model hook ---------------------------------------------------------------

def map_model(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 16,
              setup: Callable[[], object] | None = None) -> DataFrame:
    """Run a user's model over rows in batches on the executors.

    ``fn`` gets up to ``batch`` rows and returns rows of ``schema``; with
    ``setup`` (run once per task, e.g. to load weights) it also gets its result.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                yield fn(part, state) if setup else fn(part)
    return df.mapInPandas(run, schema)


def hashed_words(df: DataFrame, text: str, width: int = 64, out: str = "embedding") -> DataFrame:
    """Built-in stand-in model: word counts by md5 bucket, no Python and no shuffle."""
    buckets = F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(width)], inputCol="_buckets", outputCol="_counts")
    return counter.transform(df.withColumn("_buckets", buckets)).withColumn(out, vector_to_array("_counts")).drop(
        "_buckets", "_counts")
