"""Mixing, sharding, URL verdicts and quality rules against plain Python."""

from __future__ import annotations

import collections
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabwright.llm import mix, quality, queries, shard, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, Fraction(sum(sizes.values())), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        for s in over:
            target[s], left = Fraction(3 * sizes[s]), left - 3 * sizes[s]
        free -= over
        if not over:
            target.update({s: share[s] for s in free})
            break
    return target


def test_mix_takes_each_source_to_its_target(spark, texts):
    rows = mix.mix_sizes(texts).collect()
    assert len(rows) == texts.count()
    sizes = collections.Counter()
    for r in texts.collect():
        sizes[r.source] += len(words(r.text))
    target = plain_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]))
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:   # a source may be short by fewer words than a row at its cut has copies
        assert int(target[s]) - 1 <= taken[s] <= target[s]
    assert sorted(map(str, rows)) == sorted(map(str, mix.mix_sizes(texts.repartition(7)).collect()))


def test_mix_cuts_inside_the_range_that_holds_the_budget(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
                                    F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    sizes = docs.select("source", mix.word_count("text").alias("size"), mix.row_key("k", "doc_id").alias("key"))
    coarse, fine = (mix.plan(sizes, bucket_rows=n).collect() for n in (10**6, 10))
    assert sorted(map(str, coarse)) == sorted(map(str, fine))


def test_mixed_texts_hold_the_words_taken(spark, texts):
    mixed = mix.mix(texts)
    assert mixed.columns == texts.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(words(r.text))
        assert r.n_chars == len(r.text or "")
    expected = collections.Counter()
    for r in mix.mix_sizes(texts).collect():
        expected[r.doc_id, r.source] += r.taken
    for k, n in expected.items():   # a cut at 0 words of a shared rest may leave the row out
        assert got[k] == n
    assert mix.mix(texts.where("false")).count() == 0 and mix.mix_sizes(texts.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(shard.permuted(F.col("id"), n, "t")).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert sum(a == i for i, a in enumerate(got)) < n / 10


def test_shards_are_even_and_slots_gapless(spark, texts):
    rows = shard.shard(texts, 4).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert len(rows) == texts.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    plain = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                   for r in texts.collect())
    assert plain == sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows)
    assert [r.row_number for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.row_number))] == list(range(len(rows)))
    assert sorted(map(str, rows)) == sorted(map(str, shard.shard(texts.repartition(6), 4).collect()))
    assert shard.shard(texts.where("false"), 4).count() == 0


ADDRESSES = ["http://Example.ORG/es/1", "https://a.example.org/en/1x?q", "http://example.org/en/2", "http://notexample.org/es/",
             "https://x.com/fr/", "https://x.com/de/#a", "https://x.com/fr", "http://example.net/en/1", "no address", None, "",
             "://", "http://org", "http://É.com/de/é?x", "ftp://user@x.COM:80/fr/a\nb", "http://a.org?p=/es/", "a://b://c.com/fr/"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def test_url_parts_and_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(ADDRESSES)] + [(None, ADDRESSES[0], "x"), (0, ADDRESSES[0], "x")]
    judged = urls.judge(spark.createDataFrame(rows, "page_id int, url string, host string")).collect()
    assert len(judged) == len(rows)
    for r in judged:
        url = ADDRESSES[r.page_id or 0]
        host, path = plain_parts(url)
        fits = [x for x in urls.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2])
        assert r.verdict == best[0] if best else r.verdict == ("allow" if r.score >= 0.5 else "block")


def test_url_model_on_held_out_hosts(spark):
    rows = [(f"{w}{i}.{d}", f"/{p}/{i}", int(p == "good")) for i in range(150) for w, d, p in
            [("news", "net", "good"), ("shop", "net", "spam")]]
    train = spark.createDataFrame(rows[:200], "host string, path string, label int")
    test = spark.createDataFrame(rows[200:], "host string, path string, label int")
    scored = urls.fit(train).scored(test, "host", "path", "score").collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in scored) >= 0.95 * len(scored)
    assert urls.fit(train.where("label = 1")).scored(test, "host", "path", "score").where("score < 1").count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def plain_counts(text):
    found = words(text)
    windows = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    often = collections.Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


def test_text_statistics(spark, texts):
    more = spark.createDataFrame([(t,) for t in ("x y z w v " * 4, "a\n\n a\na\n \n \na", "1 2 3 4 5 6 1 2 3 4 5", "a b c d")], "text string")
    for r in quality.text_statistics(texts.select("text").unionByName(more)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)


def test_quality_rejects_outliers_only(spark, texts):
    prose = "the little river runs past old houses and under bridges made from stone while people walk along it".split()
    rows = [(i, " ".join(prose[(i * 7 + j * j + j * i) % len(prose)] + chr(97 + (i + j) % 26) for j in range(40 + i % 30)), "en", "a")
            for i in range(400)]
    junk = [(1000 + i, "$$$ %%% &&& ".join(f"w{i}{j}" for j in range(40)), "en", "a") for i in range(20)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i, *_ in rows) and not any(got[i].kept for i, *_ in junk)
    few = quality.quality_rules(texts).collect()
    assert len(few) == texts.count() and all(not r.kept for r in few if r.base_failed)
    for r in few:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    kept = quality.accepted(texts)
    assert kept.columns == texts.columns and kept.count() == sum(r.kept for r in few)
    assert quality.quality_rules(texts.where("false")).count() == 0 and quality.accepted(texts.where("false")).count() == 0


def test_chi_square():
    assert quality._chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert quality._chi2_quantile(0.95, 6) == pytest.approx(12.592, abs=1e-3)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    from tools.compare import compare, connect
    note, _, _ = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.SQL[name])
    assert note.startswith("ok"), note


def test_mix_of_very_many_sources(spark):
    """More sources than are held as a broadcast: the cuts are a written table."""
    docs = spark.range(10_001).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.col("id")).alias("text"),
                                      F.concat(F.lit("s"), F.col("id")).alias("source"))
    taken = mix.mix(docs).groupBy("source").count()
    assert taken.count() == 10_001 and taken.agg(F.max("count")).first()[0] <= 3
