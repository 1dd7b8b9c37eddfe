"""A: scans, sinks, asset indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import as_double, l2_normalise
from ..operators.ordered import sized
from ..session import scratch_table
from ..sources import assets as A, tables as S
from .base import query, table

LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_tax double, l_returnflag string")


@query("a1_table_scan", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def _(spark, sf):
    df = S.read_table(spark, f"{sf}/lineitem.parquet", LINEITEM, "parquet")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("a1_csv_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch_table(spark, "customer-csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option(
        "header", True).csv(path)
    return S.read_table(spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("a2_tab_separated_scan", """SELECT l_quantity::INTEGER AS heads, round(avg(l_tax), 6) AS mean, round(stddev_samp(l_tax), 6) AS std
    FROM lineitem GROUP BY l_quantity""")
def _(spark, sf):
    path = scratch_table(spark, "grid-tsv")
    grid = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("heads")).agg(
        F.round(F.avg("l_tax"), 6).alias("mean"), F.round(F.stddev_samp("l_tax"), 6).alias("std"))
    grid.write.option("header", True).option("sep", "\t").csv(path)
    return S.read_table(spark, path, "heads int, mean double, std double", sep="\t")


@query("a3_asset_index", r"""SELECT regexp_extract(url, '/([a-z]{2})/(\d+)', 1) AS key, regexp_extract(url, '/([a-z]{2})/(\d+)', 2)::INTEGER AS slot, url AS path
    FROM pages WHERE regexp_matches(url, '/([a-z]{2})/(\d+)')""")
def _(spark, sf):
    return A.asset_index(table(spark, sf, "pages"), "url", r"/([a-z]{2})/(\d+)")


@query("a4_asset_content", """SELECT page_id % 16 AS bucket, count(*) AS n_pages, sum(strlen(html) + 1)::BIGINT AS n_bytes FROM pages GROUP BY 1""")
def _(spark, sf):
    pages = table(spark, sf, "pages").withColumn("bucket", F.col("page_id") % 16)
    path = scratch_table(spark, "assets")
    pages.select("bucket", "html").write.partitionBy("bucket").text(path)
    assets = S.read_assets(spark, path, "*.txt")
    sizes = (assets.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"),
                           F.length("content").cast("long").alias("n_bytes"))
             .groupBy("bucket").agg(F.sum("n_bytes").alias("n_bytes")))
    return pages.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_pages")).join(sizes, "bucket")


@query("a5_folder_index", """SELECT 'NATION_' || (page_id % 25) AS class_id, page_id AS actual_index, n_nationkey AS class_index, 'R' || n_regionkey AS class_name
    FROM pages JOIN nation ON n_nationkey = page_id % 25""")
def _(spark, sf):
    name = F.concat(F.lit("NATION_"), F.col("page_id") % 25)
    paths = table(spark, sf, "pages").select(F.concat(F.lit("train/"), name, F.lit("/"), name, F.lit("_"),
                                                      F.col("page_id"), F.lit(".JPEG")).alias("path"))
    labels = table(spark, sf, "nation").select(F.col("n_name").alias("class_id"), F.col("n_nationkey").alias("class_index"),
                                               F.concat(F.lit("R"), "n_regionkey").alias("class_name"))
    return A.folder_index(paths, labels)


@query("a6_block_index", """WITH l AS (SELECT event_type AS class_id, event_id * 3 AS block, CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'n' || event_id || '.JPEG' END AS filename FROM events),
      r AS (SELECT *, lead(block) OVER (PARTITION BY class_id ORDER BY block) AS nxt FROM l)
    SELECT class_id, filename, 512 * block AS start_offset, 512 * nxt AS end_offset FROM r
    WHERE filename IS NOT NULL AND nxt IS NOT NULL AND filename <> 'n77.JPEG'""")
def _(spark, sf):
    lines = table(spark, sf, "events").select(F.col("event_type").alias("class_id"), F.concat(
        F.lit("block "), F.col("event_id") * 3, F.lit(": "),
        F.when(F.col("event_id") % 50 == 0, A.NUL_BLOCK).otherwise(F.concat(F.lit("n"), "event_id", F.lit(".JPEG")))).alias("value"))
    return A.block_index(lines, skip=("n77.JPEG",))


@query("a7_class_dictionary", """SELECT label AS class_index, max('c' || label) AS class_id, max(n_name) AS class_name
    FROM embeddings JOIN nation ON n_nationkey = label GROUP BY label""")
def _(spark, sf):
    names = sized(table(spark, sf, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("class_name")))
    entries = table(spark, sf, "embeddings").join(names, "label").select(
        F.col("label").alias("class_index"), F.concat(F.lit("c"), "label").alias("class_id"), "class_name")
    return A.class_dictionary(entries)


@query("a8_derived_cache", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE))
    / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings""")
def _(spark, sf):
    root = scratch_table(spark, "cache")
    key = {"dataset": "embeddings", "modality": "image", "model": "unit"}

    def build():
        return table(spark, sf, "embeddings").select("vec_id", l2_normalise("embedding").alias("unit"))
    S.cached(spark, root, key, build)
    unit = S.cached(spark, root, key, lambda: 1 / 0)  # the second call must read
    return unit.select("vec_id", F.round(F.aggregate(as_double("unit"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a9_split_sink", """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def _(spark, sf):
    path = scratch_table(spark, "split-csv")
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, "test")
                                           .otherwise("train").alias("split"))
    S.write_split(df, path)
    back = S.read_table(spark, path, "o_orderkey bigint, o_totalprice double, split string")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a10_metric_sink", """SELECT event_type AS series, s.step, count(*) AS n, round(avg(value) * s.step, 6) AS score
    FROM events, (VALUES (1), (2)) s(step) GROUP BY event_type, s.step""")
def _(spark, sf):
    path = scratch_table(spark, "metrics-json")
    per_type = table(spark, sf, "events").groupBy(F.col("event_type").alias("series")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    for step in (1, 2):
        S.write_metrics(per_type.select("series", F.lit(step).alias("step"), "n",
                                        F.round(F.col("mean") * step, 6).alias("score")), path)
    return S.read_table(spark, path, "series string, step int, n bigint, score double", "json")


@query("a11_table_checksum", """WITH h AS (SELECT ('0x' || substr(md5(len(o_custkey::VARCHAR) || ':' || o_custkey || len(o_orderkey::VARCHAR) || ':' || o_orderkey || len(o_orderpriority) || ':' || o_orderpriority || len(o_orderstatus) || ':' || o_orderstatus), 1, 15))::BIGINT AS h FROM orders)
    SELECT count(*) AS n_rows, bit_xor(h) AS digest_xor, sum(h % 1000003)::BIGINT AS digest_sum FROM h""")
def _(spark, sf):
    return S.table_checksum(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("a11_file_checksum", "SELECT page_id, sha1(html || chr(10)) AS sha1 FROM pages")
def _(spark, sf):
    path = scratch_table(spark, "assets")
    S.write_assets(table(spark, sf, "pages").select("page_id", "html"), path, "page_id")   # a file per page
    sums = S.file_checksum(S.read_assets(spark, path, "*.txt"))
    return sums.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "sha1")
