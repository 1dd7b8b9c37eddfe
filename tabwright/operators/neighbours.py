"""Exact nearest and farthest rows by a cell index.

Rows of a set lie in cells around centres. By the triangle inequality the distance of
a query to a cell's centre and the cell's radius bound its score with every row of the
cell; cells are gone through by falling bound, each together with all queries of a chunk
that it may give a better row. Cells are dealt into shards, a task searches one shard for one block of queries, and a query only goes to shards with a cell that it may have to visit.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import written

FIT_ROWS = 8_192       # rows at most that centres are fitted on, the first by hash
CENTRES = 2_048        # centres at most
CELL_ROWS = 256        # rows per centre while there are fewer centres
ROUNDS = 5             # k-means rounds
SHARD_ROWS = 65_536    # index rows of a task
QUERY_ROWS = 65_536    # queries of a task at most
LEAST_QUERIES = 1_024  # blocks of queries are made smaller, down to this, until there is work for all cores
TASKS_A_CORE = 3       # blocks times shards for every core, at least
CHUNK_ROWS = 1_024     # queries that meet a cell together, at most
TILE_ROWS = 1_024      # rows of a cell that meet a chunk of queries in one product
HELD = 524_288         # bounds or scores with centres, cells or the sample that are held together
PAIRS = 8_192          # pairs of vectors that are scored together
CROWD = 8              # times k rows of a tile that reach a query's score before the tile's best are taken first
DIGITS = 12            # scores are rounded, so equal vectors tie
SLACK = 1e-11          # more than rounding to DIGITS changes a score


def matrix(column) -> np.ndarray:
    """A list column as a float64 matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), -1) if len(values) and len(flat) else np.zeros((len(values), 0))


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def rows_held(columns: int, most: int = CHUNK_ROWS) -> int:
    """Rows of a matrix with so many columns that are formed at a time."""
    return max(1, min(most, HELD // max(1, columns)))


def prepared(x: np.ndarray, measure: str) -> np.ndarray:
    """Vectors whose inner product is the measure: unit vectors for cosine, centred unit vectors for pearson."""
    if measure == "pearson" and x.size:
        x = x - x.mean(axis=1, keepdims=True)
    if measure in ("cosine", "pearson") and x.size:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


class CellIndex(NamedTuple):
    rows: DataFrame        # key, by, tag, vec, cell, shard
    centres: np.ndarray
    cells: dict            # per group and centre: by, cell, radius, longest, shortest, last key, first shard, shards
    sample: tuple          # keys, groups and vectors of the rows that the centres were fitted on


def centres_of(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres of the rows of ``x``, started from the first distinct ones."""
    if not x.size:
        return np.zeros((1, x.shape[1]))
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        near = closest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, step = (centres * centres).sum(1) / 2, rows_held(len(centres), 4096)
    return np.concatenate([(half - x[a:a + step] @ centres.T).argmin(axis=1) for a in range(0, len(x), step)] or [np.zeros(0, int)])


def dealt(sizes: list[int], most: int, groups: list[int]) -> tuple[list[int], list[int]]:
    """Cells in order into shards of at most ``most`` rows: first shard and number of shards of each cell.

    A group of cells that would not fit in what is left of a shard starts another one, so small groups are not
    beside parts of a large one.
    """
    whole = Counter()
    for g, n in zip(groups, sizes):
        whole[g] += n
    first, splits, at, room, last = [], [], -1, 0, None
    for n, g in zip(sizes, groups):
        parts = max(1, -(-n // most))
        if parts > 1 or n > room or (g != last and whole[g] > room):
            at, room = at + 1, most
        last = g
        first.append(at)
        splits.append(parts)
        at, room = (at + parts - 1, 0) if parts > 1 else (at, room - n)
    return first, splits


def _rows(df: DataFrame, key: str, vec: str, by: str | None = None, tag: str | None = None) -> DataFrame:
    whole = F.col(key).isNotNull() & F.col(vec).isNotNull()
    long = lambda c: F.col(c).cast("long") if c else F.lit(0).cast("long")
    return df.where(whole).select(F.col(key).cast("long").alias("key"), long(by).alias("by"), long(tag).alias("tag"),
                                  F.col(vec).cast("array<double>").alias("vec"))


def build(df: DataFrame, key: str, vec: str, measure: str = "cosine", by: str | None = None, tag: str | None = None,
          fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS) -> CellIndex | None:
    """The index of a set, None if it has no rows. Rows without key or vector are left out.

    Centres are fitted on the ``fit_rows`` rows that come first in hash order; every row
    is in the cell of its closest centre, and a cell larger than a shard is split by hash.
    """
    rows = _rows(df, key, vec, by, tag)
    first = rows.orderBy(F.xxhash64("key", "by"), "key").limit(fit_rows).toArrow()
    if not first.num_rows:
        return None
    n = first.num_rows if first.num_rows < fit_rows else rows.count()
    x = prepared(matrix(first.column("vec")), measure)
    centres = centres_of(x, max(1, min(CENTRES, first.num_rows // 2, n // cell_rows)))
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("off", DoubleType()),
                         StructField("long", DoubleType())])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                v = prepared(matrix(batch.column("vec")), measure)
                cell = closest(v, centres)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("key", "by", "tag")], lists(v), pa.array(cell.astype(np.int32)),
                     pa.array(np.linalg.norm(v - centres[cell], axis=1)), pa.array(np.linalg.norm(v, axis=1))], names=schema.names)

    placed = written(rows.mapInArrow(assign, schema), "cells")
    found = placed.groupBy("by", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius"), F.max("long").alias("longest"),
                                             F.min("long").alias("shortest"), F.max("key").alias("last"))
    found = found.orderBy("by", "cell").toArrow().to_pydict()     # at most groups x centres
    base, splits = dealt(found.pop("n"), shard_rows, found["by"])
    cells = {c: np.array(v) for c, v in found.items()} | {"base": np.array(base), "splits": np.array(splits)}
    plan = df.sparkSession.createDataFrame(list(zip(found["by"], found["cell"], base, splits)), "by long, cell int, _base int, _splits int")
    shard = F.col("_base") + F.pmod(F.xxhash64("key"), F.col("_splits")).cast("int")
    placed = placed.join(F.broadcast(plan), ["by", "cell"]).select("key", "by", "tag", "vec", "cell", shard.alias("shard"))
    return CellIndex(placed, centres, cells, (first.column("key").to_numpy(), first.column("by").to_numpy(), x))


def upper_bounds(q: np.ndarray, centres: np.ndarray, radius, longest, shortest, largest: bool) -> np.ndarray:
    """Per query and cell what no score of the cell exceeds (for the smallest scores: their negatives).

    From d(q, x) >= d(q, centre) - radius and d(q, x) <= d(q, centre) + radius.
    """
    size = np.linalg.norm(q, axis=1)[:, None]
    middle = q @ centres.T
    away = np.sqrt(np.maximum(size ** 2 + (centres * centres).sum(1) - 2 * middle, 0))
    if largest:
        bound = np.minimum(middle + size * radius, (size ** 2 + longest ** 2 - np.maximum(away - radius, 0) ** 2) / 2)
    else:
        bound = -np.maximum(middle - size * radius, (size ** 2 + shortest ** 2 - (away + radius) ** 2) / 2)
    return bound + 1e-9 * (1 + size * longest)      # rounding


def first_needs(q: np.ndarray, own: np.ndarray, keys: np.ndarray, x: np.ndarray, k: int, largest: bool = True,
                exclude_self: bool = False, after: bool = False) -> np.ndarray:
    """Per query the k-th best score (for the smallest scores: their negatives) with the rows ``x``, -inf if there are fewer."""
    need = np.full(len(q), -np.inf)
    step = rows_held(len(x))
    for a in range(0, len(q) if len(x) >= k else 0, step):
        s = q[a:a + step] @ x.T
        if not largest:
            np.negative(s, out=s)
        if exclude_self or after:
            s[~_allowed(own[a:a + step], keys, exclude_self, after)] = -np.inf
        s.partition(len(x) - k, axis=1)
        need[a:a + step] = s[:, len(x) - k]
    return need


def _allowed(own, keys, exclude_self, after):
    ok = np.ones((len(own), len(keys)), bool)
    if exclude_self:
        ok &= own[:, None] != keys
    if after:
        ok &= own[:, None] < keys
    return ok


def by_pair(fn, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``fn`` of the rows ``i`` of ``a`` and ``j`` of ``b``, some pairs at a time."""
    parts = [fn(a[i[at:at + PAIRS]], b[j[at:at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts or [np.zeros(0)])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _kept(s: np.ndarray, k: int) -> np.ndarray:
    """The k largest of every row of ``s``, the first ones on ties; entries of -inf are never kept."""
    if s.shape[1] <= k:
        return s > -np.inf
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, level = s > least, (s == least) & (s > -np.inf)
    return above | (level & (level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))


def visit(q, own, need, shard: dict, k: int, largest: bool = True, exclude_self: bool = False, after: bool = False):
    """Best k rows of a shard per query: (query, row, score) arrays, and the number of cells visited.

    ``need`` is what the result of a query is known to reach; a query that has no such
    score yet visits its best cells, one by one, until it has k rows. Then the cells are
    gone through by falling bound, each as one matrix product with all queries whose
    k-th score it may beat: cells that nobody needs cost nothing, and vectors without
    structure cost a product per pair.
    """
    sign, keys, starts = 1.0 if largest else -1.0, shard["keys"], shard["starts"]
    bounds = upper_bounds(q, shard["centres"], shard["radius"], shard["longest"], shard["shortest"], largest)
    m, visited = len(q), 0
    score, place, floor = np.full((m, k), -np.inf), np.full((m, k), -1), need.copy()

    # products in single precision find the candidates, which are then scored in double; the error is below d 2^-23 |q| |x|
    x, sizes = shard["x"], np.linalg.norm(q, axis=1)
    longest = float(np.max(shard["longest"], initial=0.0))
    single = all(n == 0 or 1e-3 < n < 1e3 for n in (longest, *(sizes[sizes > 0].min(initial=1.0), sizes.max(initial=0.0))))
    fast = q.astype(np.float32) if single else q
    slack = SLACK + ((q.shape[1] + 8) * 2.0 ** -23 * longest * sizes if single else 0.0)

    def meet(rows, a, b):
        s = fast[rows] @ x[a:b].astype(fast.dtype, copy=False).T
        if largest:
            use = s >= np.nextafter((floor - slack)[rows].astype(s.dtype), s.dtype.type(-np.inf))[:, None]
        else:
            use = s <= np.nextafter((slack - floor)[rows].astype(s.dtype), s.dtype.type(np.inf))[:, None]
        crowded = np.flatnonzero(np.count_nonzero(use, axis=1) > CROWD * k)     # copies, or no score to reach yet
        step = rows_held(b - a)
        for few in (crowded[c:c + step] for c in range(0, len(crowded), step)):
            some = sign * np.round(q[rows[few]] @ x[a:b].T, DIGITS)
            if exclude_self or after:
                some[~_allowed(own[rows[few]], keys[a:b], exclude_self, after)] = -np.inf
            use[few] &= _kept(some, k)
        i, j = np.divmod(np.flatnonzero(use), b - a)
        if exclude_self:
            other = own[rows[i]] != keys[a + j]
            i, j = i[other], j[other]
        if after:
            later = own[rows[i]] < keys[a + j]
            i, j = i[later], j[later]
        found = sign * np.round(by_pair(inner, q, x, rows[i], a + j), DIGITS)
        better = found >= floor[rows[i]]
        i, j, found = i[better], j[better], found[better]
        if not len(i):
            return
        hit = np.unique(i)
        had_i, had_k = np.nonzero(place[rows[hit]] >= 0)
        all_i = np.concatenate([i, hit[had_i]])
        all_s = np.concatenate([found, score[rows[hit]][had_i, had_k]])
        all_p = np.concatenate([a + j, place[rows[hit]][had_i, had_k]])
        by = np.lexsort((keys[all_p], -all_s, all_i))
        all_i, all_s, all_p = all_i[by], all_s[by], all_p[by]
        rank = np.arange(len(all_i)) - np.searchsorted(all_i, all_i)
        keep = rank < k
        score[rows[all_i[keep]], rank[keep]] = all_s[keep]
        place[rows[all_i[keep]], rank[keep]] = all_p[keep]
        floor[rows[hit]] = np.maximum(floor[rows[hit]], score[rows[hit], k - 1])

    def go(rows, c):
        nonlocal visited
        if after:
            rows = rows[shard["last"][c] > own[rows]]
        visited += len(rows)
        for a in range(starts[c], starts[c + 1] if len(rows) else 0, TILE_ROWS):     # the rows of a cell are in the order of their keys
            meet(rows, a, min(a + TILE_ROWS, starts[c + 1]))

    lost = np.flatnonzero(np.isneginf(floor))
    if len(lost):
        order = np.argsort(-bounds[lost], axis=1, kind="stable")
        for r in range(bounds.shape[1]):
            on = np.flatnonzero(np.isneginf(floor[lost]))
            if not len(on):
                break
            cells = order[on, r]
            for c in np.unique(cells):
                go(lost[on[cells == c]], c)
            bounds[lost[on], cells] = -np.inf       # done
    for c in np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable"):
        rows = np.flatnonzero((bounds[:, c] >= floor) & (bounds[:, c] > -np.inf))
        if len(rows):
            go(rows, c)
    i, j = np.nonzero(place >= 0)
    return i, place[i, j], sign * score[i, j], visited


def shard_of(rows: pa.Table, index_cells: dict, centres: np.ndarray) -> dict:
    """A shard's rows in the order of their cells, with the cells' centres and bounds."""
    by, cell, keys = (rows.column(c).to_numpy() for c in ("by", "cell", "key"))
    order = np.lexsort((keys, cell, by))
    by, cell, keys = by[order], cell[order], keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (by[1:] != by[:-1])]))
    place = {pair: i for i, pair in enumerate(zip(index_cells["by"].tolist(), index_cells["cell"].tolist()))}
    at = np.array([place[pair] for pair in zip(by[starts].tolist(), cell[starts].tolist())])
    # the parts of the column go to their places one by one: no second copy of all rows
    rank, done, x = np.empty(len(order), np.int64), 0, None
    rank[order] = np.arange(len(order))
    for part in filter(len, rows.column("vec").chunks):
        v = matrix(part)
        x = np.empty((len(order), v.shape[1])) if x is None else x
        x[rank[done:done + len(v)]] = v
        done += len(v)
    return {"x": x, "keys": keys, "tags": rows.column("tag").to_numpy()[order], "by": by[starts],
            "starts": np.concatenate([starts, [len(keys)]]), "centres": centres[cell[starts]],
            **{c: index_cells[c][at] for c in ("radius", "longest", "shortest", "last")}}


def _of_group(shard: dict, group: int) -> dict | None:
    """The cells of one group; its rows keep their places."""
    some = np.flatnonzero(shard["by"] == group)
    if not len(some):
        return None
    cells = {c: shard[c][some] for c in ("centres", "radius", "longest", "shortest", "last")}
    return shard | cells | {"starts": np.append(shard["starts"][some], shard["starts"][some[-1] + 1])}


FOUND = pa.schema([("key", pa.int64()), ("by", pa.int64()), ("neighbour", pa.int64()), ("sim", pa.float64()),
                   ("distance", pa.float64()), ("tag", pa.int64())])


def meet_shard(left: pa.Table, right: pa.Table, index_cells: dict, centres: np.ndarray, k: int, largest: bool = True,
               exclude_self: bool = False, after: bool = False) -> list[pa.RecordBatch]:
    """What a block of queries finds in one shard. Beside both tables, only the shard in the order of its cells is held whole."""
    found = []
    if not left.num_rows or not right.num_rows:
        return found
    shard = shard_of(right, index_cells, centres)
    own_cells = {g: _of_group(shard, g) for g in np.unique(left.column("by").to_numpy()).tolist()}
    for batch in left.to_batches():
        by = batch.column("by").to_numpy()
        for g in np.unique(by).tolist():
            some = np.flatnonzero(by == g) if own_cells[g] else by[:0]
            step = rows_held(len(own_cells[g]["centres"])) if own_cells[g] else 1
            for a in range(0, len(some), step):
                part = batch.take(pa.array(some[a:a + step]))
                q, own = matrix(part.column("vec")), part.column("key").to_numpy()
                i, p, s, _ = visit(q, own, part.column("need").to_numpy(), own_cells[g], k, largest, exclude_self, after)
                away = by_pair(lambda u, v: np.linalg.norm(u - v, axis=1), q, shard["x"], i, p)
                columns = (own[i], np.full(len(i), g), shard["keys"][p], s, away, shard["tags"][p])
                found.append(pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(f.type.to_pandas_dtype(), copy=False)) for c, f in zip(columns, FOUND)], schema=FOUND))
    return found


def search(index: CellIndex, queries: DataFrame, key: str, vec: str, k: int, measure: str = "cosine", largest: bool = True,
           exclude_self: bool = False, after: bool = False, groups=(0,), query_rows: int = QUERY_ROWS) -> DataFrame:
    """(key, by, neighbour, sim, distance, tag, rank): the k rows with the largest (or smallest) scores per query and group.

    Ties go to smaller keys. ``exclude_self`` leaves out the row of the query's own key,
    ``after`` all rows up to it. The k-th score of the sample is a first bound that the
    result reaches; it decides which shards a query goes to.
    """
    centres, cells, (seen_keys, seen_by, seen) = index.centres, index.cells, index.sample
    groups = [int(g) for g in groups]
    schema = StructType([StructField("key", LongType()), StructField("by", LongType()), StructField("vec", ArrayType(DoubleType())),
                         StructField("home", IntegerType()), StructField("need", DoubleType())])

    def first_bounds(batches):
        known = {g: (seen_keys[seen_by == g], seen[seen_by == g]) for g in groups}
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(a, CHUNK_ROWS)
                q, own = prepared(matrix(part.column("vec")), measure), part.column("key").to_numpy()
                home = closest(q, centres)
                for g in groups:
                    need = first_needs(q, own, *known[g], k, largest, exclude_self, after)
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.full(len(q), g)), lists(q),
                                                      pa.array(home.astype(np.int32)), pa.array(need - 1e-9)], names=schema.names)

    asked = written(_rows(queries, key, vec).select("key", "vec").mapInArrow(first_bounds, schema), "queries")
    # blocks of queries of one group with close homes, so that a block leaves out many shards
    homes = asked.groupBy("by", "home").agg(F.count(F.lit(1)).alias("n")).orderBy("by", "home").toArrow().to_pydict()
    ends = cells["base"] + cells["splits"]
    reach = {g: int(ends[cells["by"] == g].max(initial=0) - cells["base"][cells["by"] == g].min(initial=ends.max())) for g in groups}
    work = sum(n * max(reach[g], 0) for g, n in zip(homes["by"], homes["n"]))
    each = math.ceil(work / (TASKS_A_CORE * queries.sparkSession.sparkContext.defaultParallelism))
    first, splits = dealt(homes["n"], min(query_rows, max(LEAST_QUERIES, each)), homes["by"])
    blocks = {pair: at for pair, at in zip(zip(homes["by"], homes["home"]), zip(first, splits))}
    routed = StructType([*schema.fields, StructField("block", IntegerType()), StructField("shard", IntegerType())])

    def route(batches):
        step = rows_held(len(cells["cell"]))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                q, need, by = matrix(part.column("vec")), part.column("need").to_numpy(), part.column("by").to_numpy()
                bound = upper_bounds(q, centres[cells["cell"]], cells["radius"], cells["longest"], cells["shortest"], largest)
                hit = (bound >= need[:, None]) & (by[:, None] == cells["by"])
                if after:
                    hit &= cells["last"] > part.column("key").to_numpy()[:, None]
                i, c = np.nonzero(hit)
                n = cells["splits"][c]
                i, s = np.repeat(i, n), np.repeat(cells["base"][c] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pairs = np.unique(np.stack([i, s], axis=1), axis=0) if len(i) else np.zeros((0, 2), int)
                picked = part.take(pa.array(pairs[:, 0]))
                at = [blocks[pair] for pair in zip(picked.column("by").to_pylist(), picked.column("home").to_pylist())]
                block = [f + o % n for (f, n), o in zip(at, picked.column("key").to_pylist())]
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(block, pa.int32()),
                                                  pa.array(pairs[:, 1].astype(np.int32))], names=routed.names)

    sent = asked.mapInArrow(route, routed)
    if first and first[-1] + splits[-1] > 1:
        sent = written(sent, "routed")
        rows = index.rows.join(sent.select("shard", "block").distinct(), "shard")
    else:
        rows = index.rows.withColumn("block", F.lit(0))
    sent, rows = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (sent, rows))   # names of their own
    out = "key long, by long, neighbour long, sim double, distance double, tag long"     # as FOUND

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(meet_shard(left, right, cells, centres, k, largest, exclude_self, after), FOUND)

    found = sent.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInArrow(both, out)
    order = F.desc("sim") if largest else F.asc("sim")
    rank = F.row_number().over(W.partitionBy("key", "by").orderBy(order, "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
