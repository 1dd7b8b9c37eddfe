"""MinHash groups, Merkle manifests and hard negatives against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tabwright.llm import merkle, minhash, multiindex, sketches

# ---- shingle sets and sketches -----------------------------------------------


def plain_set(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def test_sets_have_the_plain_sizes_and_intersections():
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(80)]
    for k in (1, 4, 5):
        values, starts = sketches.shingle_sets(texts, k)
        sets = [set(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
        plain = [plain_set(t, k) for t in texts]
        assert [len(s) for s in sets] == [len(s) for s in plain]
        for a, p in zip(sets, plain):
            assert [len(a & b) for b in sets] == [len(p & q) for q in plain]
        digests = sketches.set_digests(values, starts)
        assert len({tuple(d) for d in digests.tolist()}) == len(set(plain))


def plain_sketch(members, size):
    out = [None] * size
    for i in range(2 * size):
        for m in members:
            thrown = int(sketches.mixed(np.array([m], np.uint64) + sketches.mixed(np.array([i + 1], np.uint64) * sketches.ODD))[0])
            bin_ = (thrown & 0xFFFF) * size >> 16 if i < size else i - size
            value = int(sketches.mixed(np.array([thrown], np.uint64))[0])
            if out[bin_] is None or out[bin_][0] == i and out[bin_][1] > value:
                out[bin_] = (i, value)
    return [v for _, v in out]


def test_sketch_follows_its_rounds_and_fills_every_coordinate():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 3, 7, 20)]
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets), 0])
    found = sketches.sketch(values, starts, 16)
    for row, members in zip(found, sets):
        assert row.tolist() == plain_sketch(members.tolist(), 16)
    assert (found[:-1] != sketches.FILL).all() and (found[-1] == sketches.FILL).all()


def test_coordinates_agree_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    for n, similarity in ((10, 2 / 3), (40, 0.6), (300, 0.8), (2000, 0.9)):
        common = round(n * 2 * similarity / (1 + similarity))
        agreed = []
        for _ in range(120):
            pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - common:2 * n - common])
            x, y = sketches.sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]), 128)
            agreed.append((x == y).mean())
        exact = common / (2 * n - common)
        assert abs(np.mean(agreed) - exact) < 0.02
        assert np.std(agreed) < 1.25 * np.sqrt(exact * (1 - exact) / 128)
    assert 0.75 < (minhash.least_agreement() / 2048 - 1 / 16) / (15 / 16) < 0.76 and minhash.band_rows() == 4 and minhash.band_rows(similarity=0.6) == 2


# ---- near-duplicates ---------------------------------------------------------


def plain_components(rows, k, similarity):
    """(id, set size, component) by comparing all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                group[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in least.items()}
    return sorted(((d, len(sets[i]), least[root(i)] if sets[i] else d, d == least[root(i)] if sets[i] else True)
                   for i, (d, _) in enumerate(rows)), key=str)


def found_groups(docs, **options):
    return sorted((tuple(r) for r in minhash.minhash(docs, **options).collect()), key=str)


def near_copies(seed, n_groups=6, n_texts=60):
    """Texts with copies edited so that similarities lie around the threshold, and one large group."""
    rnd, words, rows = random.Random(seed), [f"w{i}" for i in range(400)], []
    bases = [[rnd.choice(words) for _ in range(rnd.choice([3, 4, 5, 30, 80, 200]))] for _ in range(n_groups)]
    for i in range(n_texts):
        text = list(bases[0] if i % 2 else rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 8])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((1000 - i, " ".join(text).upper() if i % 7 == 0 else "  ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"shingle": 4, "similarity": 80}, {"shingle": 2, "similarity": 60}):
        assert found_groups(docs, **options) == plain_components(rows, options["shingle"], options["similarity"])


def test_groups_of_odd_rows(spark, texts):
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    assert found_groups(texts, shingle=4) == plain_components(rows, 4, 80)
    assert minhash.minhash(texts.where("false")).count() == 0
    clashing = texts.selectExpr("doc_id", "text", "1 as id", "2 as n", "'x' as h", "3 as bands", "4 as component_id", "5 as kept")
    assert found_groups(clashing, shingle=4) == found_groups(texts, shingle=4)


def test_blocks_of_a_bucket_lose_no_pair(spark):
    """Every pair with an outside member and like sketches once, from its first common band, whatever the block size."""
    rng = np.random.default_rng(5)
    shorts = rng.integers(0, 2, (40, 8)).astype(np.uint8)     # four bands of two coordinates
    longs = rng.integers(0, 3, (40, 16)).astype(np.uint8)
    component = [0 if i < 25 else i for i in range(40)]
    rows, buckets = [], collections.defaultdict(list)
    for i in range(40):
        for band in range(4):
            key = 1000 * band + 10 * int(shorts[i][2 * band]) + int(shorts[i][2 * band + 1])
            buckets[key].append(i)
            rows.append((key, band, i, component[i]))
    members = spark.createDataFrame(rows, "key long, band int, id long, component long")
    packed = [(i, 10, bytearray(shorts[i].tobytes()), bytearray((longs[i, ::2] | (longs[i, 1::2] << 4)).tobytes())) for i in range(40)]
    prints = spark.createDataFrame(packed, "id long, n long, bytes binary, long binary")
    expected = set()
    for ids in buckets.values():
        for i in ids:
            expected |= {(j, i) for j in ids if j < i and component[i] != component[j] and (longs[i] == longs[j]).sum() >= 6}
    for block in (3, 1000):
        found = minhash.open_pairs(members, prints, agreement=6, rows=2, block=block).collect()
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)


# ---- Merkle manifest ---------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout=8):
    """Digest rows by building every tree in lists."""
    def leaf(row, text):
        parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
        return hashed("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([hashed("".join(last[i:i + fanout])) for i in range(0, len(last), fanout)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // fanout * fanout
            out.append(("".join(level[first:at]), "".join(level[at + 1:first + fanout])))
            at //= fanout
        return out

    groups = collections.defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"], leaf(row, row["text"]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for i, (doc, own, row) in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, place)
            text = row["text"]
            if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
                text = text.translate(LOWER)
            now = leaf(row, text)
            for before, after in steps:
                now = hashed(before + now + after)
            out.append((doc, own, trees[g][-1][0], top[-1][0], hashed("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=str)


def found_manifest(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs, tampered=merkle.lower_cased()).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"en": 9, "de": 64, "": 65}, {f"l{i}": 1 + i % 3 for i in range(11)}])
def test_manifest_of_groups_of_many_sizes(spark, sizes):
    rnd, rows, doc = random.Random(6), [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            doc += rnd.randrange(1, 4)
            rows.append({"doc_id": doc, "source": rnd.choice([None, "", "s"]), "lang": lang, "n_chars": rnd.choice([None, 3]),
                         "text": rnd.choice([None, "", "Some TEXT é", "no capitals"])})
    rnd.shuffle(rows)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    found = found_manifest(docs)
    assert found == plain_manifest(rows)
    tampered = {r["doc_id"] for r in rows if r["text"] == "Some TEXT é" and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0}
    assert {r[0] for r in found if not r[-1]} == tampered


def test_manifest_of_odd_rows(spark, texts):
    docs = texts.selectExpr("*", "1 as grp", "2 as pos", "3 as hash", "4 as leaf", "5 as path", "6 as n", "7 as _lang")
    assert found_manifest(docs) == plain_manifest([r.asDict() for r in texts.collect()])
    assert found_manifest(texts.where("false")) == []


def test_slot_pivot(spark):
    """Children spread into slot columns; the own column left out gives before and after."""
    nodes = spark.createDataFrame([(0, i, 10, f"{i:02d}") for i in range(10)], "grp long, pos long, n long, hash string")
    level = merkle.parents(nodes)
    rows = {r.pos: r for r in level.collect()}
    assert [rows[0][f"c{k}"] for k in range(8)] == [f"{k:02d}" for k in range(8)] and rows[1].c1 == "09" and rows[1].c2 is None
    assert rows[1].hash == hashed("0809") and rows[1].n == 2 and not rows[1].alone
    above = spark.createDataFrame([(0, 0, []), (0, 1, [])], "grp long, pos long, path array<struct<before:binary,after:binary>>")
    paths = {r.pos: r.path for r in merkle.siblings(level, above).collect()}
    assert paths[9][0].before.hex() == "08" and paths[9][0].after == b"" and paths[2][0].after.hex() == "0304050607" and len(paths) == 10


# ---- hard negatives ----------------------------------------------------------


def plain_negatives(rows, every=100, positives=5, negatives=10):
    seen = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in v))
        if row not in seen:
            seen.append(row)
    dims = max((len(v) for _, _, v in seen), default=0)
    seen = [(i, label, (*v, *[0] * (dims - len(v)))) for i, label, v in seen]
    out = []
    for a, label, v in seen:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, same == label) for i, same, w in seen if i != a)
        for score, i, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and 30 * -score <= 100 * -s[0] <= 90 * -score][:negatives]
            out += [(a, i, rank, j, -score, -s) for rank, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def clustered(seed, n, dims, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(int(i), int(rng.integers(0, 4)), [float(x) for x in centres[rng.integers(0, 6)] + rng.normal(size=dims) * 0.3])
            for i in (range(n) if ids is None else ids)]


def found_negatives(rows, spark, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return sorted(tuple(r) for r in multiindex.hard_negatives(df, **options).collect())


def as_floats(rows):
    return [(i, label, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_rows": 3, "fit_rows": 64}])
def test_negatives_are_those_of_all_pairs(spark, options):
    rows = as_floats(clustered(7, 400, 8))
    assert found_negatives(rows, spark, every=20, **options) == plain_negatives(rows, every=20)


def test_negatives_of_odd_rows(spark):
    rows = as_floats(clustered(8, 60, 5, ids=range(-30, 30)))
    rows += rows[3:9]                                              # repeated rows
    rows += [(i, 2, [1.0] * 5) for i in range(100, 140)]           # one vector many times: ties
    rows += [(i, i % 3, [0.0] * 5) for i in range(200, 230)]       # scores of zero
    rows += [(300, 1, [0.5, 0.25]), (10, 3, [1.0, 1.0, 1.0, 1.0, 1.0]), (301, 1, [])]
    rows += [(None, 1, [1.0] * 5), (400, None, [1.0] * 5), (500, 1, None), (600, 1, [1.0, None, 1.0, 1.0, 1.0]),
             (700, 1, [float("nan")] * 5), (800, 1, [float("inf")] * 5)]
    expected = plain_negatives(rows, every=10)
    assert expected and found_negatives(rows, spark, every=10, shard_rows=20) == expected
    assert found_negatives(rows[:0], spark) == [] and found_negatives([(7, 1, [1.0])], spark) == []
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    clashing = df.selectExpr("*", "1 as row", "2 as shard", "3 as c1", "4 as windows", "5 as score", "6 as rank", "7 as vec")
    assert sorted(tuple(r) for r in multiindex.hard_negatives(clashing, every=10).collect()) == expected


def test_search_ends_before_all_cells_are_visited():
    """Bounds of half scores and radii: far cells are not visited, and the results are those of a full scan."""
    rng = np.random.default_rng(9)
    x = np.round(100 * (rng.normal(size=(30, 6))[rng.integers(0, 30, 3000)] + 0.02 * rng.normal(size=(3000, 6))))
    books = tuple(multiindex.codebook(p, 12) for p in (x[:, :3], x[:, 3:]))
    near = [multiindex.nearest(p, b) for p, b in zip((x[:, :3], x[:, 3:]), books)]
    off = [np.linalg.norm(p - b[c], axis=1) for p, b, c in zip((x[:, :3], x[:, 3:]), books, near)]
    import pyarrow as pa
    rows = pa.table({"vec_id": np.arange(3000), "label": np.arange(3000) % 2, "vec": pa.array(x.astype(int).tolist()),
                     "c1": near[0], "c2": near[1], "r1": off[0], "r2": off[1]})
    shard = multiindex.shard_of(rows)
    cells, most = len(shard["starts"]) - 1, 0
    for i in range(0, 3000, 100):
        scores = (x @ x[i]).astype(int)
        high = int(scores.max())
        windows = np.array([[0, 1, -2**62, 2**62, 5, -2**62], [1, 0, high // 3, high // 2, 10, high // 3]])
        found, visited = multiindex.visit(x[i], i, i % 2, windows, shard, books)
        most = max(most, visited)
        for (_, same, low, top, k, _), (_, got, ids) in zip(windows.tolist(), found):
            plain = sorted((-s, j) for j, s in enumerate(scores.tolist()) if (j % 2 == i % 2) == bool(same) and j != i and low <= s <= top)
            assert list(zip((-got).tolist(), ids.tolist())) == plain[:k]
    assert cells > 15 and most < cells
