"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators.embed import mean_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL twin if there is one."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the given tables.

    ``spread`` deals the rows of a table with fewer files than cores to all
    cores, for work that is heavy per row; a table of many files stays as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


# class scores: inner products of every whole vector with the mean vectors of the classes
CLASS_SCORES = """CM AS (SELECT c, list(m ORDER BY i) AS m FROM (SELECT label AS c, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY c),
  CV AS (SELECT vec_id, label, list(round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), m), 9) ORDER BY c) AS v FROM embeddings, CM GROUP BY vec_id, label)"""


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, scores): one score per class, in the order of the classes."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = sorted(mean_vectors(df, "label", "embedding").collect())      # one row per class
    x = V.as_double("embedding")
    return df.select("vec_id", "label", F.array(*[F.round(V.dot(x, V.literal_array(m)), 9) for _, m in means]).alias("scores"))
