"""Fingerprints, near and exact duplicates, toxicity, packing, archives and the pipeline against plain Python."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm import components, packing, simhash, suffixes, syncmers, toxicity, warc
from tabwright.llm.common import Scratch

# ---- syncmers ----------------------------------------------------------------


def plain_anchors(codes, k, s):
    def mixed(part):
        value = 0
        for c in part:
            value = (value * int(syncmers.BASE) + c + 1) % 2**64
        return int(syncmers._mixed(np.array([value], np.uint64))[0])
    found = []
    for i in range(len(codes) - k + 1):
        inner = [mixed(codes[i + j:i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, mixed(codes[i:i + k])))
    return found


@pytest.mark.parametrize("k, s", [(16, 5), (54, 8), (8, 8), (13, 1)])
def test_anchors(k, s):
    rng = np.random.default_rng(k)
    for n in (0, 5, 16, 60, 150):
        codes = rng.integers(0, 3, n)
        assert list(zip(*(x.tolist() for x in syncmers.anchors(codes, k, s)))) == plain_anchors(codes.tolist(), k, s)


def test_edited_fingerprint_is_that_of_the_edited_text():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab é") for _ in range(rnd.choice([0, 1, 15, 16, 17, 40, 100]))) for _ in range(2))
        text, mark = syncmers.Document(1, a).edited(syncmers.Document(2, b))
        tail = len(a) // 3
        assert text == a[:len(a) - tail] + b[:tail]
        assert str(mark) == str(syncmers.Document(3, text).print)


def test_likeness_is_the_longest_chain_of_all_anchors():
    rnd = random.Random(5)

    def chain(a, b):
        """Longest rising run of common anchors by comparing all pairs."""
        x, y = (dict(reversed(list(zip(d.hashes.tolist(), d.positions.tolist())))) for d in (a, b))
        common = sorted((x[h], y[h]) for h in x.keys() & y.keys())
        best = [1] * len(common)
        for i, (_, q) in enumerate(common):
            best[i] = 1 + max((best[j] for j in range(i) if common[j][1] < q), default=0)
        union = len(x.keys() | y.keys())
        return max(best, default=0) / union if union else 1.0
    for _ in range(40):
        parts = ["".join(rnd.choice("abcd ") for _ in range(60)) for _ in range(5)]
        a, b = ("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 7))) for _ in range(2))
        first, second = syncmers.Document(1, a), syncmers.Document(2, b)
        assert first.print.likeness(second.print) == second.print.likeness(first.print) == pytest.approx(chain(first, second))


def test_a_shared_passage_of_long_texts_counts():
    """360 characters in common of 24,000: likeness is their share of the anchors, not chance."""
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rnd.choice(letters) for _ in range(360))
    for _ in range(5):
        texts = ["".join(rnd.choice(letters) for _ in range(24_000)) for _ in range(2)]
        a, b = (syncmers.Document(i, t[:9000 * (i + 1)] + passage + t[9000 * (i + 1):]) for i, t in enumerate(texts))
        assert 0.004 < a.print.likeness(b.print) < 0.012
        assert str(a.print).count("@") == 64


def test_edited_likeness(spark, texts, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in syncmers.edited_likeness(docs).collect()}
    plain = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    for (i, a), (_, b) in zip(plain, plain[1:] + plain[:1]):
        tail = len(a) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((a[:len(a) - tail] + b[:tail]).encode()).hexdigest()
        assert rows[i].n_chars == len(a) and 0 <= rows[i].near_next <= 1 and 0 <= rows[i].near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.95 * len(rows)
    odd = syncmers.edited_likeness(texts).collect()
    assert len(odd) == texts.count()
    alike = collections.defaultdict(set)
    for r, t in zip(sorted(odd, key=lambda r: r.n_chars), sorted((r.text or "" for r in texts.collect()), key=len)):
        assert r.n_chars == len(t)
    for r in odd:
        alike[r.fingerprint].add(r.n_chars)
    assert all(len(v) == 1 for v in alike.values())
    assert syncmers.edited_likeness(texts.where("false")).count() == 0
    table = syncmers.anchor_table(texts.where("doc_id = 1")).collect()
    assert [(r.position, r.hash % 2**64) for r in table] == plain_anchors(
        [ord(c) for c in texts.where("doc_id = 1").first().text], syncmers.K, syncmers.S)


def test_likeness_follows_from_the_written_fingerprints(spark):
    """Texts of far more than 64 anchors: what is written holds all of them, and both likenesses follow from it."""
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (6000, 6000, 9, 0, 40)]
    texts.append(texts[0][:4000] + texts[1][:500])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in syncmers.edited_likeness(docs).collect()}
    for i, r in rows.items():
        mark, edited, following = (syncmers.Fingerprint.read(f) for f in (
            r.fingerprint, r.edited_fingerprint, rows[(i - 1) % len(texts)].fingerprint))
        whole = syncmers.Document(i, texts[i]).print
        assert mark.hashes.tolist() == whole.hashes.tolist() and mark.positions.tolist() == whole.positions.tolist()
        assert mark.likeness(edited) == r.near_edited and mark.likeness(following) == r.near_next
    assert len(syncmers.Fingerprint.read(rows[0].fingerprint).hashes) > 500


# ---- SimHash -----------------------------------------------------------------


def plain_fingerprint(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    parts = [" ".join(found[i:i + shingle]) for i in range(len(found) - shingle + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for r in texts.collect():
        assert simhash.fingerprint(r.text) % 2**64 == plain_fingerprint(r.text)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_linked_fingerprints(spark, distance):
    rnd = random.Random(distance)
    prints = {0, -1}
    for _ in range(30):
        value = rnd.getrandbits(64)
        for _ in range(6):
            prints.add(value - (value >> 63 << 64))
            for bit in rnd.sample(range(64), rnd.randrange(1, 4)):
                value ^= 1 << bit
    prints = sorted(prints)
    label = {p: p for p in prints}
    near = {p: [q for q in prints if bin((p ^ q) % 2**64).count("1") <= distance] for p in prints}
    while any(label[p] != (m := min(label[q] for q in near[p])) and not label.update({p: m}) for p in prints):
        pass
    got = simhash.classes(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), distance).collect()
    assert {r.fingerprint: r.component for r in got} == label


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([(500, 400), (500, 450), (7, 7)], "a long, b long"))
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}


def test_simhash_of_odd_rows(spark, texts):
    rows = simhash.simhash(texts).collect()
    assert len(rows) == texts.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {7} and len(zero) == 4
    kept = simhash.one_of_each(texts)
    assert kept.columns == texts.columns and kept.count() == len({r.component_id for r in rows}) + 1   # id 3 has two texts
    assert simhash.simhash(texts.where("false")).count() == 0 and simhash.one_of_each(texts.where("false")).count() == 0


# ---- suffixes ----------------------------------------------------------------


def plain_removal(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            part = data[p:p + length]
            if part in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i is None, i or 0, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_removal(docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in suffixes.remove_repeats(docs).collect())


def shared_passages(n, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefg é") for _ in range(300)) for _ in range(8)]
    part = lambda: rnd.choice([rnd.choice(base)[rnd.randrange(200):][:rnd.randrange(250)],
                               "".join(rnd.choice("abc d") for _ in range(rnd.randrange(80)))])
    rows = [(3 * i - 100, "".join(part() for _ in range(rnd.randrange(6)))) for i in range(n)]
    return rows + [(9001, "a" * 1000), (9002, "ab" * 600), (9003, "a" * 99), (9004, "a" * 100), (9005, None), (9006, "")], base


def test_repeats_are_those_of_plain_search(spark, monkeypatch):
    rows, base = shared_passages(200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_removal(docs) == plain_removal(sorted(rows))
    monkeypatch.setattr(suffixes, "CHUNK", 256)   # texts cut into blocks
    assert found_removal(docs) == plain_removal(sorted(rows))


def test_repeats_with_shared_ids_and_without(spark, texts):
    rows, base = shared_passages(60, 6)
    rows += [(None, base[0]), (None, base[1]), (None, base[0]), (5, "q" * 50), (5, "q" * 50), (8, base[2]), (8, base[2] + "x"), (None, None)]
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    assert found_removal(spark.createDataFrame(rows, "doc_id long, text string")) == plain_removal(sorted(rows, key=order))
    rows = sorted(((r.doc_id, r.text) for r in texts.collect()), key=order)
    assert found_removal(texts) == plain_removal(rows)
    assert found_removal(texts.where("false")) == []
    assert suffixes.without_repeats(texts).columns == texts.columns


def test_texts_without_repeats(spark):
    docs = spark.createDataFrame([(1, "é" * 80, 80, "k"), (2, "x" + "é" * 80 + "yz", 83, "j")], "doc_id long, text string, n_chars long, q string")
    got = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert (got[2].text, got[2].n_chars, got[2].q) == ("xyz", 3, "j")


def test_a_sorted_round_leaves_no_shuffle_files(spark):
    """The next round writes its own; both at a time took more disk than the texts allow."""
    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size())} if held.size() else set()
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, "".join(map(chr, rng.integers(97, 123, 3_000)))) for i in range(40)], "doc_id long, text string")
    before = files()
    marked, _ = suffixes.ranked(suffixes.families(docs.selectExpr("doc_id d", "cast(text as binary) data")),
                                Scratch(spark), "families")
    for _ in range(50):     # Spark drops them in the background
        left = [f for f in files() - before if f.endswith(".data")]
        if not left:
            break
        time.sleep(0.1)
    assert not left and marked.isEmpty()


# ---- toxicity ----------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(1)
    neutral = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(1500):
        toxic = int(rnd.random() < 0.15)
        found = [rnd.choice(neutral) for _ in range(60)] + [rnd.choice(["zzvile", "zzfoul"]) + rnd.choice(["", "er", "ing"])] * toxic
        rnd.shuffle(found)
        rows.append((i, " ".join(found), toxic))
    rows += [(2000, None, None), (2001, "", None), (None, "abc", None), (2000, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(table.drop("toxic"), table.select("doc_id", "toxic")).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    judged = [r for r in held if truth[r.doc_id] is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in judged]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.toxicity(table.drop("toxic"), table.select("doc_id", F.lit(0).alias("toxic")))
    assert none.where("score > 0").count() == 0
    assert toxicity.toxicity(table.drop("toxic").where("false"), table.select("doc_id", "toxic")).count() == 0


# ---- packing -----------------------------------------------------------------


def test_encoder_gives_the_tokenizer_s_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    import pyarrow as pa
    odd = ["a\x01b c. d's 'x", "", "\x01", " é\tÉ ", "<|endoftext|> q<|startoftext|>", "́a b́", "Stop... X.! É.. a.b. 3. ...",
           "<|EndOfText|>. <|endoftext|>.", "İ İ. K.", "x y \x85 z", "Words WORDS words. words!!"]
    got = packing.Encoder(tokenizer)(pa.array(odd))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_packed_pieces(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(texts, path, capacity=256).collect()
    expected = []
    for r in texts.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(r.doc_id, k // 256, k, len(ids[k:k + 256]), zlib.crc32(ids[k:k + 256].tobytes())) for k in range(0, len(ids), 256)]
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(texts.where("false"), path).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 33, 300)
    bins, offsets = packing.place(sizes, 32)
    fill, gaps = {}, collections.Counter()
    for size, b, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        best = None
        for gap in [g for g in range(size, 32) if gaps[g]] + [32]:
            after = gaps.copy()
            after[gap] -= gap < 32
            after[gap - size] += 1
            cost = sum(n * n for g, n in after.items() if 0 < g < 32)
            best = min(best, (cost, gap)) if best else (cost, gap)
        assert (fill.get(b, 0), 32 - fill.get(b, 0)) == (offset, best[1])
        gaps[best[1]] -= best[1] < 32
        gaps[best[1] - size] += 1
        fill[b] = offset + size


# ---- archives ----------------------------------------------------------------

PAGES = [(1, "http://a/", "x" * 1000), (2, None, "x" * 1000), (5, "u\r\nv", "x" * 1000), (5, "u", "x" * 1000), (None, "q", "x" * 1000),
         (None, "q", "y" * 2000), (None, "q", "y" * 2000), (3, "z", None), (4, "z", ""), (6, "é", "é" * 999), (7, "é", "é" * 999),
         (8, "s", "small"), (9, "s", "small")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, size string")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in warc.round_trip(pages, shard_bytes=3000, roll_bytes=200).collect()]
    expected = []
    for i, (page, _, html) in enumerate(PAGES):
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data]
        first = max((p for p in same if p is not None), default=None)
        repeated = any(p[0] == page and p[2] == html for p in PAGES[:i])
        revisit = len(data) >= 1000 and (page != first or repeated)
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_are_reproducible_and_checked(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifests = []
    for name, rows in (("a", pages), ("b", pages.repartition(5))):
        manifests.append(sorted(map(tuple, warc.write(rows, str(tmp_path / name), shard_bytes=3000, roll_bytes=200).collect())))
    assert manifests[0] == manifests[1] and sum(m[1] for m in manifests[0]) == len(PAGES)
    for file, _, size, sha in manifests[0]:
        data = (tmp_path / "a" / "data" / file).read_bytes()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
    assert not list((tmp_path / "a" / "_temporary").iterdir())
    record = warc.page_member(1, "u", b"payload", 0, False, None)
    import io
    (raw,) = warc.members(io.BytesIO(record))
    assert warc.parse(raw)[1].endswith(b"payload")
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"pay1oad"))


# ---- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, before, sf)
        if i < 4:
            assert after.columns == docs.columns
            after = spark.createDataFrame(after.collect(), docs.schema)
        rows, was = after.collect(), {r.doc_id: r for r in before.collect()}
        if i == 0:
            assert {r.doc_id for r in rows} < set(was) and all(was[r.doc_id] == r for r in rows)
        if i == 1:
            groups = collections.defaultdict(set)
            for r in simhash.simhash(before).collect():
                groups[r.component_id].add(r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(min(g) for g in groups.values())
        if i == 2:
            plain = plain_removal(sorted((d, r.text) for d, r in was.items()))
            removed = {p[1]: p[3] for p in plain}
            for r in rows:
                assert r.n_chars == len(r.text) and (r == was[r.doc_id]) == (not removed[r.doc_id])
        before = after
    assert sum(r.length for r in rows) > 0 and json.dumps([n for n, _ in pipeline.STAGES])


def test_pipeline_run_keeps_only_what_its_result_reads(spark, sf):
    import os
    import corpus_pipeline as pipeline

    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    result = pipeline.run(spark, sf)
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before)
    assert left == ["llm-pieces", "llm-stage-3"]
    rows = result.collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 2048


def test_one_of_each_without_a_broadcast(spark, texts):
    """What goes may be too many keys to broadcast; repeated rows stay once either way."""
    rows = simhash.one_of_each(texts, shingle=3, distance=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, simhash.one_of_each(texts, shingle=3, distance=2, most=0).collect()))
    again = simhash.one_of_each(texts.unionByName(texts), shingle=3, distance=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
