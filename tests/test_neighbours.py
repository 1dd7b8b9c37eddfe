"""Cell-index searches, similarity moments and energy distance against numpy on all pairs."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tabwright.operators import embed as E, moments as Mo, neighbours as N


def clustered(seed, n, dims, spread=0.05):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(12, dims))[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, copies, a zero vector, negative keys, and rows without key or vector."""
    x = clustered(1, 150, 6)
    x[100:130] = x[5]
    x[7] = 0
    keys = [int(k) for k in np.random.default_rng(2).permutation(np.arange(-50, 100))]
    rows = [(k, v.tolist(), k % 3) for k, v in zip(keys, x)]
    df = spark.createDataFrame([*rows, (None, x[0].tolist(), 0), (1000, None, 1)], "id long, v array<double>, g int").persist()
    return df, np.array(keys), x


def units(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def plain_search(keys, x, k, measure="cosine", largest=True, exclude_self=False, after=False, keep=None):
    x = N.prepared(x, measure)
    s = np.round(x @ x.T, 12)
    out = {}
    for i, own in enumerate(keys):
        fits = [j for j in range(len(keys)) if (not exclude_self or keys[j] != own) and (not after or keys[j] > own)
                and (keep is None or keep[j])]
        best = sorted(fits, key=lambda j: (-s[i, j] if largest else s[i, j], keys[j]))[:k]
        out[int(own)] = [int(keys[j]) for j in best]
    return out


@pytest.mark.parametrize("options", [{}, {"largest": False}, {"exclude_self": True}, {"after": True}, {"after": True, "largest": False}])
@pytest.mark.parametrize("measure, sizes", [("cosine", (8, 40, 30)), ("pearson", (64, 65_536, 16_384)), ("dot", (20, 25, 1000))])
def test_search_is_exact(points, options, measure, sizes):
    df, keys, x = points
    index = N.build(df, "id", "v", measure, cell_rows=sizes[0], shard_rows=sizes[1], fit_rows=90)
    found = {}
    for r in N.search(index, df, "id", "v", 4, measure, query_rows=sizes[2], **options).orderBy("key", "rank").collect():
        found.setdefault(r["key"], []).append(r["neighbour"])
    expected = {q: best for q, best in plain_search(keys, x, 4, measure, **options).items() if best}
    assert found == expected


def test_groups_are_searched_apart(points):
    df, keys, x = points
    got = E.nearest(df, df, "id", "v", 3, exclude_self=True, by="g", groups=[0, 2], stripe_rows=20)
    found = {}
    for r in got.orderBy("rank").collect():
        found.setdefault(r["g"], {}).setdefault(r["id"], []).append(r["neighbour"])
    for g in (0, 2):
        assert found[g] == plain_search(keys, x, 3, exclude_self=True, keep=keys % 3 == g)
    assert set(found) == {0, 2}


def test_empty_sets(points):
    df, _, _ = points
    none = df.where("false")
    assert E.nearest(df, none, "id", "v", 3).count() == 0 and E.nearest(none, df, "id", "v", 3).count() == 0
    assert E.pair_profile(df, none, "id", "v").count() == 0
    row = E.pair_summary(none, "id", "v").first()
    assert row["n_pairs"] == 0 and row["mean"] is None
    assert E.energy_distance(df, none, "id", "v").first()[0] is None


def test_cells_are_visited_best_first_and_few_of_them():
    x = units(clustered(3, 4000, 8, spread=0.02))
    centres = N.centres_of(x, 40)
    cell = N.closest(x, centres)
    rows = pa.table({"key": np.arange(4000), "by": np.zeros(4000, int), "tag": np.zeros(4000, int), "cell": cell,
                     "vec": N.lists(x)})
    size = np.linalg.norm(x, axis=1)
    some = np.unique(cell)
    cells = {"by": np.zeros(len(some), int), "cell": some,
             "radius": np.array([np.linalg.norm(x[cell == c] - centres[c], axis=1).max() for c in some]),
             "longest": np.array([size[cell == c].max() for c in some]), "shortest": np.array([size[cell == c].min() for c in some]),
             "last": np.array([np.flatnonzero(cell == c).max() for c in some])}
    shard = N.shard_of(rows, cells, centres)
    q, own = x[::40], np.arange(4000)[::40]
    i, place, s, visited = N.visit(q, own, np.full(len(q), -np.inf), shard, 5, exclude_self=True)
    plain = np.round(q @ x.T, 12)
    plain[np.arange(len(q)), own] = -np.inf
    for row in range(len(q)):
        best = np.lexsort((np.arange(4000), -plain[row]))[:5]
        assert shard["keys"][place[i == row]].tolist() == best.tolist()
    assert visited < 0.4 * len(q) * len(some)


def test_row_moments(points):
    df, keys, x = points
    for measure in ("cosine", "pearson", "dot"):
        p = N.prepared(x, measure)
        s = p @ p.T
        got = {r["id"]: r for r in Mo.row_moments(df, "id", "v", measure, Mo.gram_matrix(N.build(df, "id", "v", measure).rows)).collect()}
        assert len(got) == len(keys)
        for i, k in enumerate(keys.tolist()):
            assert got[k]["n"] == len(keys) and np.isclose(got[k]["total"], s[i].sum()) and np.isclose(got[k]["squares"], (s[i] ** 2).sum())


@pytest.mark.parametrize("block", [7, 4096])
def test_moments_with_later_rows(points, block):
    df, keys, x = points
    rows = N.build(df, "id", "v").rows
    s = units(x) @ units(x).T
    got = {r["key"]: r for r in Mo.later_moments(rows, len(keys), block).collect()}
    assert set(got) == set(keys.tolist()) - {max(keys.tolist())}
    for i, k in enumerate(keys.tolist()):
        later = keys > k
        if later.any():
            assert got[k]["n"] == later.sum() and np.isclose(got[k]["total"], s[i, later].sum())
            assert np.isclose(got[k]["squares"], (s[i, later] ** 2).sum())


def test_profiles_and_summary(points):
    df, keys, x = points
    s = np.round(units(x) @ units(x).T, 12)
    for upper in (False, True):
        got = {r["id"]: r for r in E.pair_profile(df, df, "id", "v", upper=upper, stripe_rows=40).collect()}
        for i, k in enumerate(keys.tolist()):
            use = keys > k if upper else np.ones(len(keys), bool)
            if use.any():
                low, high = s[i, use].min(), s[i, use].max()
                assert (got[k]["low"], got[k]["low_key"]) == (low, keys[use & (s[i] == low)].min())
                assert (got[k]["high"], got[k]["high_key"]) == (high, keys[use & (s[i] == high)].min())
    pairs = [(s[i, j], *sorted((int(keys[i]), int(keys[j])))) for i in range(len(keys)) for j in range(i)]
    row = E.pair_summary(df, "id", "v", stripe_rows=40).first()
    values = np.array([p[0] for p in pairs])
    assert row["n_pairs"] == len(pairs) and np.isclose(row["mean"], values.mean()) and np.isclose(row["std"], values.std())
    assert (row["low"], row["low_a"], row["low_b"]) == min(pairs)
    assert (row["high"], row["high_a"], row["high_b"]) == min(pairs, key=lambda p: (-p[0], p[1], p[2]))


@pytest.mark.parametrize("tile", [10, 4096])
def test_energy_distance(points, tile):
    df, keys, x = points
    first = keys % 3 == 0
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    expected = 2 * d[first][:, ~first].mean() - d[first][:, first].mean() - d[~first][:, ~first].mean()
    got = E.energy_distance(df.where("g = 0"), df.where("g <> 0"), "id", "v", tile_rows=tile).first()[0]
    assert np.isclose(got, expected, atol=1e-12)


def test_similarity_queries_form_no_stripes(spark, sf, monkeypatch):
    from tabwright import catalog

    def no(*args, **options):
        raise AssertionError("stripes of all pairs")
    monkeypatch.setattr(E, "stripe_pairs", no)
    queries, _ = catalog.load()
    for name in ("c9_upper_pair_profile", "i1_cosine_profile", "i1_nearest_by_cosine", "i2_pearson_profile", "i5_similarity_summary",
                 "i6_energy_distance", "i7_knn_vote", "i10_spread_score"):
        assert queries[name](spark, sf).count() > 0


class Counted(np.ndarray):
    """An array that counts the matrix products it is part of."""

    products = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **kw):
        Counted.products += ufunc is np.matmul
        return getattr(ufunc, method)(*[np.asarray(x) for x in inputs], **kw)


@pytest.mark.parametrize("scale", [1.0, 1e6])
@pytest.mark.parametrize("largest, after", [(True, False), (False, False), (True, True)])
def test_vectors_without_structure_are_one_product_per_cell(scale, largest, after):
    """Random vectors and many copies: results are those of all pairs, and no cell is gone through query by query."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) * scale
    x[1000:1900] = x[3]
    keys = rng.permutation(3000)
    centres = N.centres_of(x[:1000], 20)
    cell = N.closest(x, centres)
    some, size = np.unique(cell), np.linalg.norm(x, axis=1)
    cells = {"by": np.zeros(len(some), int), "cell": some, "last": np.array([keys[cell == c].max() for c in some]),
             "radius": np.array([np.linalg.norm(x[cell == c] - centres[c], axis=1).max() for c in some]),
             "longest": np.array([size[cell == c].max() for c in some]), "shortest": np.array([size[cell == c].min() for c in some])}
    rows = pa.table({"key": keys, "by": np.zeros(3000, int), "tag": np.zeros(3000, int), "cell": cell, "vec": N.lists(x)})
    shard = N.shard_of(rows, cells, centres)
    own, q = keys[::10], x[::10]
    s = np.round(q @ x.T, N.DIGITS) * (1 if largest else -1)
    s[own[:, None] >= keys if after else own[:, None] == keys] = -np.inf
    seen = np.partition(s[:, :500], 496, axis=1)[:, 496]          # the fourth best of some rows
    Counted.products = 0
    counted = shard | {c: shard[c].view(Counted) for c in ("x", "x32") if c in shard}
    i, place, score, _ = N.visit(q, own, seen - 1e-9 * scale ** 2, counted, 4, largest, not after, after)
    assert Counted.products < 4 * len(some)
    for row in range(len(q)):
        best = [j for j in np.lexsort((keys, -s[row]))[:4] if s[row, j] > -np.inf]
        assert np.allclose(np.sort(score[i == row]), np.sort(s[row][best] * (1 if largest else -1)), rtol=1e-12)
        if scale == 1:
            assert shard["keys"][place[i == row]].tolist() == keys[best].tolist()


def test_the_first_of_equal_scores_are_kept():
    s = np.array([[1.0, 3, 3, 2, 3], [5, -np.inf, -np.inf, -np.inf, -np.inf], [2, 2, 2, 2, 2]])
    assert N._kept(s, 2).tolist() == [[False, True, True, False, False], [True] + [False] * 4, [True, True, False, False, False]]


def test_distance_sums_of_near_copies():
    """Matrix products lose the digits of small distances; these come from differences."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(300, 8))
    b = np.concatenate([a, a + 1e-9 * rng.normal(size=a.shape), rng.normal(size=(200, 8))])
    ga, gb = rng.integers(0, 2, len(a)), rng.integers(0, 2, len(b))
    d = np.linalg.norm(a[:, None] - b, axis=2)
    plain = [[d[ga == i][:, gb == j].sum() for j in (0, 1)] for i in (0, 1)]
    assert np.allclose(E._distance_sums(a, b, ga, gb), plain, rtol=1e-12)
    assert abs(E._distance_sums(a[:1], np.repeat(a[:1], 5, axis=0), ga[:1] * 0, np.zeros(5, int))[0, 0]) == 0


def peak_mb(fn, *args, **options):
    """The result, and the MB that numpy and Python held at most beside what was there before."""
    tracemalloc.start()
    try:
        out = fn(*args, **options)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def shard_table(x, cell):
    """A shard as Spark hands it over, in many parts, and its cells."""
    some, size = np.unique(cell), np.linalg.norm(x, axis=1)
    of = [np.flatnonzero(cell == c) for c in some]
    centres = np.stack([x[rows].mean(axis=0) for rows in of])
    cells = {"by": np.zeros(len(some), int), "cell": some, "last": np.array([rows[-1] for rows in of]),
             "radius": np.array([np.linalg.norm(x[rows] - c, axis=1).max() for rows, c in zip(of, centres)]),
             "longest": np.array([size[rows].max() for rows in of]), "shortest": np.array([size[rows].min() for rows in of])}
    rows = pa.table({"key": np.arange(len(x)), "by": np.zeros(len(x), int), "tag": np.arange(len(x)) % 10, "cell": cell, "vec": N.lists(x)})
    return pa.Table.from_batches(rows.to_batches(max_chunksize=1_000)), cells, centres


def test_memory_does_not_grow_with_centres():
    rng = np.random.default_rng(11)
    x, centres = rng.normal(size=(4096, 16)), rng.normal(size=(2048, 16))
    near, mb = peak_mb(N.closest, x, centres)
    assert mb < 32 and near.tolist() == ((x[:, None, 0] * 0 + (centres * centres).sum(1) / 2) - x @ centres.T).argmin(axis=1).tolist()


def test_memory_of_a_shard_and_of_a_chunk_of_queries_is_bounded():
    """Wide vectors, large cells and many scores that are close: the shard is held once, a chunk needs little beside it."""
    rng = np.random.default_rng(12)
    x = units(1 + 0.3 * rng.normal(size=(12_000, 128)))
    rows, cells, centres = shard_table(x, np.arange(12_000) % 3)
    shard, mb = peak_mb(N.shard_of, rows, cells, centres)
    assert mb < 1.5 * x.nbytes / 1e6
    order = np.lexsort((np.arange(12_000), np.arange(12_000) % 3))
    assert (shard["x"] == x[order]).all()
    q = x[:1024]
    s = np.round(q @ x.T, N.DIGITS)
    need = np.partition(s, -600, axis=1)[:, -600]      # a weak first bound: 200 rows of each cell reach it
    (i, place, score, _), mb = peak_mb(N.visit, q, np.arange(1024), need, shard, 25)
    assert mb < 96
    for row in range(0, 1024, 50):
        best = np.lexsort((np.arange(12_000), -s[row]))[:25]
        assert shard["keys"][place[i == row]].tolist() == best.tolist()


@pytest.mark.parametrize("largest, exclude_self, after", [(True, False, False), (False, True, False), (True, False, True)])
def test_first_needs_in_pieces(largest, exclude_self, after):
    """The bound of every query from a sample is its k-th best score; few queries meet the sample at a time."""
    rng = np.random.default_rng(13)
    x, keys = rng.normal(size=(8192, 16)), rng.permutation(8192)
    q, own = x[:1024], keys[:1024]
    got, mb = peak_mb(N.first_needs, q, own, keys, x, 20, largest, exclude_self, after)
    assert mb < 32
    s = (1 if largest else -1) * (q @ x.T)
    s[own[:, None] >= keys if after else (own[:, None] == keys) & exclude_self] = -np.inf
    assert np.allclose(got, np.sort(s, axis=1)[:, -20], atol=1e-9)
    assert np.isneginf(N.first_needs(q, own, keys[:19], x[:19], 20)).all()


def test_small_groups_are_not_beside_a_part_of_a_large_one():
    assert N.dealt([3, 3, 5, 6, 25, 4], 10, [0, 1, 2, 2, 3, 3]) == ([0, 0, 1, 2, 3, 6], [1, 1, 1, 1, 3, 1])
    assert N.dealt([4, 4, 4], 10, [0, 0, 0]) == ([0, 0, 1], [1, 1, 1])
