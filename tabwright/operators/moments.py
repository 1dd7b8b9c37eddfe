"""Similarity statistics over all pairs from sums: mean vectors and Gram matrices instead of pairs.

The sum of a row's inner products with a set is its product with the set's sum vector,
the sum of their squares a quadratic form of the set's Gram matrix. A set of any size
is one matrix of the vectors' length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .neighbours import CHUNK_ROWS, lists, matrix, prepared
from .ordered import cut_points, with_buckets

BLOCK_ROWS = 4_096      # rows whose pairs one task forms when only later rows count


def _extended(x: np.ndarray) -> np.ndarray:
    """Vectors with a 1 and their squared length behind, so that one Gram matrix has all sums."""
    return np.column_stack([x, np.ones(len(x)), (x * x).sum(axis=1)])


def gram_matrix(rows: DataFrame, vec: str = "vec") -> np.ndarray:
    """Gram matrix of the vectors extended by 1 and squared length; per task one partial matrix, added up by matrix row."""
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _extended(matrix(batch.column("v")))
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists(total)], names=["i", "row"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    parts = rows.select(F.col(vec).alias("v")).mapInArrow(partial, "i int, row array<double>")
    found = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("i").collect()
    return np.array([r["row"] for r in found])


def row_moments(rows: DataFrame, key: str, vec: str, measure: str, gram: np.ndarray) -> DataFrame:
    """(key, n, total, squares) of every row's scores with the set that ``gram`` sums up."""
    d = len(gram) - 2
    n, total, square = int(gram[d, d]), gram[:d, d], gram[:d, :d]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = prepared(matrix(batch.column("v")), measure)
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.full(len(x), n)), pa.array(x @ total),
                                                  pa.array(((x @ square) * x).sum(axis=1))], names=["k", "n", "total", "squares"])

    named = rows.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v"))
    whole = named.where(F.col("k").isNotNull() & F.col("v").isNotNull())
    return whole.mapInArrow(run, "k long, n long, total double, squares double").withColumnRenamed("k", key)


def later_moments(rows: DataFrame, n_rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n, total, squares) of every row's scores with the rows of larger keys.

    ``rows`` has key and vec. Rows are cut into key ranges; the Gram matrices of later
    ranges are added up entry by entry, and only the pairs inside a range are formed.
    """
    marked = rows.select("key", "vec")
    cuts = cut_points(marked, ["key"], max(2, math.ceil(n_rows / block_rows)))
    marked = with_buckets(marked, cuts).withColumnRenamed("_b_key", "block")

    def block_gram(part: pa.Table) -> pa.Table:
        x = _extended(matrix(part.column("vec")))
        return pa.table({"block": part.column("block")[:1], "g": lists((x.T @ x).reshape(1, -1))})

    grams = marked.groupBy("block").applyInArrow(block_gram, "block int, g array<double>")
    entries = grams.select("block", F.posexplode("g").alias("i", "v"))
    after = F.coalesce(F.sum("v").over(W.partitionBy("i").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    later = entries.select("block", "i", after.alias("v")).groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("g"))

    def block_moments(part: pa.Table, sums: pa.Table) -> pa.Table:
        x, keys = matrix(part.column("vec")), part.column("key").to_numpy()
        d = x.shape[1]
        g = matrix(sums.column("g")).reshape(d + 2, d + 2)
        n, total, squares = np.full(len(x), g[d, d]), x @ g[:d, d], ((x @ g[:d, :d]) * x).sum(axis=1)
        for a in range(0, len(x), CHUNK_ROWS):
            own = slice(a, a + CHUNK_ROWS)
            s = np.where(keys[own, None] < keys, x[own] @ x.T, np.nan)
            n[own] += (~np.isnan(s)).sum(axis=1)
            total[own] += np.nansum(s, axis=1)
            squares[own] += np.nansum(s * s, axis=1)
        some = n > 0
        return pa.table({"key": keys[some], "n": n[some].astype(np.int64), "total": total[some], "squares": squares[some]})

    marked, later = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (marked, later))
    return marked.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(
        block_moments, "key long, n long, total double, squares double")


def pair_sums(gram: np.ndarray) -> tuple[int, float, float]:
    """Number, sum and sum of squares of the scores of all unordered pairs of different rows."""
    d = len(gram) - 2
    n, lengths, fourth = gram[d, d], gram[d, d + 1], gram[d + 1, d + 1]
    return int(n * (n - 1) / 2), (gram[:d, d] @ gram[:d, d] - lengths) / 2, ((gram[:d, :d] ** 2).sum() - fourth) / 2
