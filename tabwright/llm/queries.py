"""The registered queries of this package, their production parameters and SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import merkle, minhash, mix, multiindex, packing, quality, shard, simhash, suffixes, syncmers, toxicity, urls, warc

QUERIES = {}
SQL = {}

WORD_SQL = r"'[^\x20\x09-\x0D]+'"
SHARDS = 24


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL twin if there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_sql(seed: str, *cols: str) -> str:
    """Twin of ``common.row_key``."""
    parts = ", ".join(f"coalesce('=' || {c}, '0')" for c in cols)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15))::BIGINT"


MIX_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD_SQL}))::BIGINT AS size,
         {key_sql(mix.SEED, 'doc_id', 'text')} AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sizes GROUP BY source),
steps AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::BIGINT AS left_over,
         (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0))::BIGINT AS units
  FROM sources
  WINDOW earlier AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (
  SELECT left_over, units FROM steps WHERE left_over * w <= cap * units
  ORDER BY cap / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.left_over * s.w > s.cap * s.units THEN s.cap::DOUBLE
              ELSE (f.left_over * s.w)::DOUBLE / f.units END AS target
  FROM steps s, free f),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
runs AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS earlier FROM sizes)
SELECT r.doc_id, r.source, r.size, b.source_size, b.target,
       (b.epochs * r.size + greatest(0, least(r.size, floor(b.target)::BIGINT - b.epochs * b.source_size - r.earlier)))::BIGINT AS taken
FROM runs r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark, sf):
    return mix.mix_sizes(table(spark, sf, "documents"))


def feistel_sql(x: str, side: str) -> str:
    left, right = f"(({x}) // {side})", f"(({x}) % {side})"
    for add, times in shard.round_keys("shard"):
        mixed = f"(({right} + {add}) % {shard.PRIME})"
        left, right = right, f"(({left} + {mixed} * {mixed} % {shard.PRIME} * {times} % {shard.PRIME}) % {side})"
    return f"({left} * {side} + {right})"


# CRC-32 byte by byte: the table of 256 remainders follows from the polynomial
CRC_SQL = """bits AS (
  SELECT i, 0 AS step, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS entries FROM bits WHERE step = 8)"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; the table ``crc`` must be in scope."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda a, b: xor(a // 256, entries[xor(a, b) % 256 + 1])))"""


SHARD_SQL = f"""
WITH RECURSIVE sizes AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS side FROM documents),
{CRC_SQL},
rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS text,
         row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) - 1 AS row_number
  FROM documents),
digests AS (SELECT row_number, {crc32_sql('text')} AS text_crc32 FROM rows, crc),
walk AS (
  SELECT row_number, {feistel_sql('row_number', 'side')} AS v FROM rows, sizes
  UNION ALL
  SELECT row_number, {feistel_sql('v', 'side')} AS v FROM walk, sizes WHERE v >= n)
SELECT doc_id, size, text_crc32, row_number, v AS place, (v % {SHARDS})::INT AS shard, v // {SHARDS} AS slot,
       'rows' AS law, NULL::INT AS grown_shard
FROM rows JOIN walk USING (row_number) JOIN digests USING (row_number), sizes WHERE v < n
"""


@query("op2_shard_feistel", SHARD_SQL)
def op2(spark, sf):
    rows = shard.shard(table(spark, sf, "documents"), SHARDS)
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query("op9_simhash_ball")
def op9(spark, sf):
    return simhash.simhash(table(spark, sf, "documents"), shingle=3, distance=2)


WARC_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
largest AS (
  SELECT payload_digest, max(page_id) AS page FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page <> page_id THEN page END AS refers_to
FROM payloads LEFT JOIN largest USING (payload_digest)
"""


@query("op10_warc_archive", WARC_SQL)
def op10(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


@query("op8_sum_of_squares_packing")
def op8(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_robust_quality")
def op5(spark, sf):
    return quality.quality_rules(table(spark, sf, "documents"))


@query("op4_url_filter")
def op4(spark, sf):
    return urls.judge(table(spark, sf, "pages"))


@query("op6_toxicity_nnpu")
def op6(spark, sf):
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_syncmer_fingerprints")
def op3(spark, sf):
    return syncmers.edited_likeness(table(spark, sf, "documents"))


@query("op7_suffix_dedup")
def op7(spark, sf):
    return suffixes.remove_repeats(table(spark, sf, "documents")).drop("spans")


@query("op11_minhash_fast_sketches")
def op11(spark, sf):
    return minhash.minhash(table(spark, sf, "documents"), shingle=4, similarity=80)


def merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """Twin of op12 for up to 8 ** levels rows a language and 8 ** upper languages.

    A group's only node goes up as it is, so groups of any size below that take all levels.
    """
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    digest = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.FIELDS) + ")"
    parts = [f"""lowered AS (
  SELECT *, CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 AND doc_id IS NOT NULL
         THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM documents, crc),
leaves AS (SELECT doc_id, lang, {digest('text')} AS leaf, {digest('now')} AS fold FROM lowered),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof FROM leaves),
nodes_0 AS (SELECT g, pos, n, leaf AS h FROM placed),
walk_0 AS (SELECT *, NULL AS subroot FROM placed)"""]
    for k in range(levels + upper):
        if k == levels:   # the languages' last nodes are the leaves of one more tree
            parts.append(f"""turned AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM nodes_{k}),
joined AS (SELECT w.* REPLACE (0 AS g, w.g AS pos, t.h AS subroot) FROM walk_{k} w JOIN turned t ON t.pos = w.g)""")
        nodes, walk = ("turned", "joined") if k == levels else (f"nodes_{k}", f"walk_{k}")
        before, after = "coalesce(array_to_string(f.kids[:w.pos % 8], ''), '')", "coalesce(array_to_string(f.kids[w.pos % 8 + 2:], ''), '')"
        parts.append(f"""family_{k} AS (SELECT g, pos // 8 AS up, any_value(n) AS n, list(h ORDER BY pos) AS kids FROM {nodes} GROUP BY g, pos // 8),
nodes_{k + 1} AS (SELECT g, up AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h FROM family_{k}),
walk_{k + 1} AS (
  SELECT w.* REPLACE (w.pos // 8 AS pos, CASE WHEN f.n = 1 THEN proof ELSE proof || {before} || {after} END AS proof,
                      CASE WHEN f.n = 1 THEN fold ELSE sha256({before} || fold || {after}) END AS fold)
  FROM {walk} w JOIN family_{k} f ON f.g = w.g AND f.up = w.pos // 8)""")
    top = levels + upper
    return f"""
WITH RECURSIVE {CRC_SQL},
{", ".join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM walk_{top}, nodes_{top}
"""


@query("op12_merkle_slot_pivot", merkle_sql())
def op12(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"), tampered=merkle.lower_cased())


NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
     AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_inverted_multi_index", NEGATIVES_SQL)
def op13(spark, sf):
    return multiindex.hard_negatives(table(spark, sf, "embeddings"))
