from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import embed as E, split as S
from tabwright.operators.fitted import Chain
from tabwright.operators import reshape as R
from tabwright.session import scratch_table
from tabwright.streaming import apply as A, meters as M


@pytest.fixture(scope="module")
def emb(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").persist()


@pytest.fixture(scope="module")
def copies(spark):
    """A third of the vectors are copies of one."""
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [math.sin(i), math.cos(i * 7), math.sin(i * 3)]) for i in range(300)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").persist()


def brute(df, k):
    rows = sorted(df.collect())
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    return {int(ids[i]): [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]] for i in range(len(ids))}


@pytest.mark.parametrize("stripe", [16_384, 37])
def test_nearest_matches_brute_force_with_copies(copies, stripe):
    got = E.nearest(copies, copies, "vec_id", "embedding", 5, exclude_self=True, stripe_rows=stripe)
    found = {}
    for r in got.orderBy("vec_id", "rank").collect():
        found.setdefault(r["vec_id"], []).append(r["neighbour"])
    assert found == brute(copies, 5)


def test_fewer_rows_than_k(copies):
    few = copies.where("vec_id < 4")
    assert E.nearest(few, few, "vec_id", "embedding", 50).groupBy("vec_id").count().first()["count"] == 4


def test_stripes_do_not_change_profiles(copies):
    for measure in ("cosine", "pearson", "euclidean"):
        a = E.row_similarity(E.pair_profile(copies, copies, "vec_id", "embedding", measure, stripe_rows=29), "vec_id").toPandas()
        b = E.row_similarity(E.pair_profile(copies, copies, "vec_id", "embedding", measure), "vec_id").toPandas()
        a, b = a.sort_values("vec_id").reset_index(drop=True), b.sort_values("vec_id").reset_index(drop=True)
        assert np.allclose(a, b, atol=1e-9)


def test_energy_distance_of_a_set_with_itself(copies):
    assert abs(E.energy_distance(copies, copies, "vec_id", "embedding").first()[0]) < 1e-9


def test_knn_grid_averages_tries(emb):
    out = E.knn_eval(emb, emb, "vec_id", "embedding", "label", [3], [5, -1], 2, 10).collect()
    got = {r["n_per_class"]: r["top_1"] for r in out}
    x = {r["vec_id"]: (np.array(r["embedding"], dtype=float), r["label"]) for r in emb.collect()}
    accuracies = []
    sample = S.per_class_sample(emb.select("vec_id", "label"), "vec_id", "label", 5, 2).collect()
    for t in (0, 1):
        ids = sorted(r["vec_id"] for r in sample if r["try"] == t)
        base = np.array([x[i][0] / np.linalg.norm(x[i][0]) for i in ids])
        hits = []
        for q, (v, y) in x.items():
            s = np.round(base @ (v / np.linalg.norm(v)), 12)
            near = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:3]
            mass = np.zeros(10)
            for j in near:
                mass[x[ids[j]][1]] += math.exp((s[j] - s[near[0]]) / 0.07)
            hits.append(int(mass.argmax()) == y)
        accuracies.append(np.mean(hits))
    assert math.isclose(got[5], float(np.mean(accuracies)), abs_tol=1e-9)
    assert got[-1] >= got[5]


def test_balanced_assignment_is_balanced(emb):
    df = emb.withColumn("s", F.slice("embedding", 1, 4))
    out = E.balanced_assign(df, "s", 0.1, iters=30)
    sums = np.array([r["assignment"] for r in out.collect()])
    assert np.allclose(sums.sum(axis=1), 1) and np.allclose(sums.sum(axis=0), len(sums) / 4, rtol=1e-3)


def test_probe_prefers_the_best_c(emb):
    table, model = E.probe_sweep(emb.where("vec_id % 5 > 0"), emb.where("vec_id % 5 = 0"), "embedding", "label", cs=(1e-6, 1.0, 100.0), max_iter=30)
    rows = table.collect()
    assert sum(r["best"] for r in rows) == 1
    assert max(r["top_1"] for r in rows) == next(r["top_1"] for r in rows if r["best"])
    assert model.numClasses == 10 and len(E.PROBE_CS) == 45 and math.isclose(E.PROBE_CS[-1], 1e5)


def test_pool_tokens_without_average(spark):
    rows = [(1, layer, token, [float(layer), float(token)]) for layer in range(3) for token in range(3)]
    df = spark.createDataFrame(rows, "key int, layer int, token int, vec array<double>")
    assert E.pool_tokens(df, "key", 2, average=False).first()["pooled"] == [1.0, 0.0, 2.0, 0.0]
    assert E.pool_tokens(df, "key", 1).first()["pooled"] == [2.0, 0.0, 2.0, 1.5]


def test_stream_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = scratch_table(spark, "test-events")
    events.repartition(3).write.parquet(source)
    fitted = Chain([R.fit_quantile(events, ["value"], 11)])
    out = scratch_table(spark, "test-out")
    stream = A.read_files(spark, source, events.schema, files_per_trigger=1)
    A.apply_fitted(stream, fitted, out, scratch_table(spark, "test-state"), ["event_id", "value"]).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(fitted.transform(events).select("event_id", "value").collect())


def test_repeated_batch_counts_once(spark):
    meter = M.RunningMeter(scratch_table(spark, "test-meter"), "s", "t", "v", last=3)
    first = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "s string, t long, v double")
    second = spark.createDataFrame([("a", 5, 50.0), ("b", 0, 1.0)], "s string, t long, v double")
    meter.update(first, 0)
    meter.update(second, 1)
    meter.update(second, 1)
    got = {r["s"]: r for r in meter.values(spark, 1).collect()}
    assert got["a"]["median"] == 4.0 and got["a"]["max"] == 50.0 and math.isclose(got["a"]["global_avg"], 10.0)
    assert got["b"]["avg"] == 1.0


def test_asset_files_are_written_by_all_cores(spark, tmp_path):
    """One input split is dealt to many tasks; every row has its file, and the checksum is that of its bytes."""
    import hashlib
    import re
    from tabwright.sources import tables as S
    path = str(tmp_path / "assets")
    S.write_assets(spark.range(64).coalesce(1).selectExpr("id", "concat('text ', id) AS text"), path, "id")
    sums = {int(re.search(r"id=(\d+)", r["path"])[1]): (r["sha1"], re.search(r"part-(\d+)", r["path"])[1])
            for r in S.file_checksum(S.read_assets(spark, path, "*.txt")).collect()}
    assert {i: s for i, (s, _) in sums.items()} == {i: hashlib.sha1(f"text {i}\n".encode()).hexdigest() for i in range(64)}
    assert len({task for _, task in sums.values()}) >= spark.sparkContext.defaultParallelism


def test_asset_files_are_those_of_sparks_writer_and_reader(spark, tmp_path):
    """Files of shared, missing and odd keys, hidden and nested ones; the driver keeps no list of them."""
    from tabwright.sources import tables as S
    rows = [("a/b=c%d", "one"), ("a/b=c%d", "two\nlines"), (None, "lost"), ("", "empty"), ("plain", None), ("üñ [x]", ""), ("a b", "é")]
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    S.write_assets(df, ours, "id")
    df.repartition(1, "id").write.partitionBy("id").text(theirs)
    spark_reads = lambda path: spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)

    def found(df, root):
        lines = {}
        for r in df.collect():      # a missing and an empty key may have a file each in one folder
            lines.setdefault(r["path"].split(f"{root}/")[1].rsplit("/", 1)[0], set()).update(bytes(r["content"]).split(b"\n"))
        return lines
    files = S.read_assets(spark, ours, "*.txt")
    assert found(files, "ours") == found(spark_reads(theirs), "theirs") and len(found(files, "ours")) == 5
    assert files.inputFiles() == [] and not list((tmp_path / "ours").rglob("*.txt.crc")) and (tmp_path / "ours" / "_SUCCESS").exists()
    for name in ("_hidden/a.txt", "_x=1/a.txt", ".b/a.txt", "deep/er/a.txt", "deep/a.csv", "deep/.a.txt", "deep/_a.txt", "deep/a.txt._COPYING_", "a.txt"):
        (tmp_path / "ours" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "ours" / name).write_text(name)
    for glob in ("*.txt", "*", "?.txt"):
        plain = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(ours)
        assert sorted(S.read_assets(spark, ours, glob).collect()) == sorted(plain.collect())
    assert S.read_assets(spark, ours, "*").schema.simpleString() == plain.schema.simpleString()
    with pytest.raises(FileExistsError):
        S.write_assets(df, ours, "id")
    with pytest.raises(ValueError, match="one text column"):
        S.write_assets(spark.range(2), str(tmp_path / "other"), "id")


def test_contents_of_large_files_come_few_at_a_time(tmp_path, monkeypatch):
    from tabwright.sources import tables as S
    monkeypatch.setattr(S, "CONTENT_BYTES", 100)
    paths = []
    for i, size in enumerate((10, 0, 95, 300, 1, 40)):
        (tmp_path / f"{i}").write_bytes(bytes([i]) * size)
        paths.append(f"file:{tmp_path}/{i}")
    pieces = [p.to_pylist() for p in S._contents(paths)]
    assert [len(p) for p in pieces] == [3, 1, 2] and [len(x) for p in pieces for x in p] == [10, 0, 95, 300, 1, 40]
    assert [p.to_pylist() for p in S._contents([])] == [[]]
