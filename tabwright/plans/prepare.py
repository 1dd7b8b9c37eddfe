"""From a raw table to a feature table, as one declared dataset."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import clean, encode, joins


@dataclass(frozen=True)
class Dataset:
    """Column roles and cleaning rules; roles are names, never positions."""

    key: str
    target: str
    categorical: tuple = ()
    numeric: tuple = ()
    text: tuple = ()
    derive: Mapping[str, Callable[[], Column]] = field(default_factory=dict)  # new or replaced columns
    where: str | None = None            # rows to keep
    target_labels: bool = True          # encode the target as class ids
    require: tuple | None = None        # columns that must not be null; default: all but text


def prepare(table: DataFrame, spec: Dataset, assets: DataFrame | None = None, unknown="error") -> DataFrame:
    """(key, categorical codes, numeric doubles, text, target[, asset columns]).

    Texts are blanked where null and joined with blanks; rows with a missing
    required value are dropped; assets are attached by key.
    """
    df = table.withColumns({c: fn() for c, fn in spec.derive.items()}) if spec.derive else table
    if spec.where:
        df = df.where(spec.where)
    numeric = [F.col(c).cast("double").alias(c) for c in spec.numeric]
    df = df.select(spec.key, *spec.categorical, *numeric, *spec.text, F.col(spec.target).alias("target"))
    df = clean.drop_incomplete(df, spec.require or [*spec.categorical, *spec.numeric, "target"])
    if spec.text:
        df = clean.concat_text(df, spec.text, "_text").drop(*spec.text).withColumnRenamed("_text", "text")
    if spec.categorical:
        df = encode.fit_codes(df, spec.categorical, unknown).transform(df)
    if spec.target_labels:
        df = encode.fit_label(df, "target").transform(df).withColumn("target", F.col("target").cast("int"))
    if assets is not None:
        df = joins.attach_assets(df, assets, spec.key)
    return df


def map_columns(df: DataFrame, transforms: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Row or target transforms given as functions of a column."""
    return df.withColumns({c: fn(F.col(c)) for c, fn in transforms.items()})
