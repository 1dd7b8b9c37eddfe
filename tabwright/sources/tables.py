"""Table readers, writers, the derived-table cache and checksums."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from ..session import mounted_folder


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "csv", sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Read with a declared schema; nothing is inferred for text formats."""
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if schema is None:
        raise ValueError("a schema is needed for text formats")
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"') \
        .option("multiLine", multi_line).csv(path)


TASKS_A_CORE = 4          # tasks per core that write, list and read files, so that slow ones even out
NAMES_AT_ONCE = 10_000    # names or files of a folder in one batch
CONTENT_BYTES = 8 << 20   # content of files in one batch, beside its last file

ASSETS = "path string, modificationTime timestamp, length long"


def read_assets(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files as rows (path, modificationTime, length, content); content is read only if selected.

    Spark's reader keeps all files of all folders on the driver. In a folder that executors
    reach by name, one task lists the entries and all tasks look into them, when the result is run.
    """
    folder = mounted_folder(spark, path) if recursive and not re.search(r"[*?\[\]{},\\]", path) else None
    if folder is None or re.search(r"[\[\]{}\\]", glob) or not path_exists(spark, path):
        return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                .option("recursiveFileLookup", recursive).load(path))
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    entries = spark.range(1, numPartitions=1).mapInArrow(lambda _: _entries(folder), "path string")
    files = entries.repartition(tasks, "path").mapInArrow(lambda batches: _files(batches, glob), ASSETS)

    @F.arrow_udf("binary")
    def content(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in paths:
            yield from _contents(batch.to_pylist())
    return files.withColumn("content", content("path"))


def _shown(name: str) -> bool:
    """Whether Spark's readers look at a file or folder of this name."""
    if name.startswith(("_common_metadata", "_metadata")):
        return True
    return not (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name)


def _entries(folder: str) -> Iterator[pa.RecordBatch]:
    """The names that a folder shows, or the file itself, some at a time."""
    names = (e.path for e in os.scandir(folder) if _shown(e.name)) if os.path.isdir(folder) else iter([folder])
    while some := [n for _, n in zip(range(NAMES_AT_ONCE), names)]:
        yield pa.RecordBatch.from_pydict({"path": some})


def _files(batches: Iterator[pa.RecordBatch], glob: str) -> Iterator[pa.RecordBatch]:
    """(path, modificationTime, length) of the files at or below the entries whose names match."""
    schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
    rows: list[tuple] = []
    for batch in batches:
        for entry in batch.column(0).to_pylist():
            for file in _below(entry):
                if fnmatchcase(os.path.basename(file), glob):
                    found = os.stat(file)
                    rows.append((f"file:{file}", found.st_mtime_ns // 1_000_000 * 1000, found.st_size))
                if len(rows) == NAMES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _below(entry: str) -> Iterator[str]:
    """The file, or the files below the folder."""
    if not os.path.isdir(entry):
        yield entry
        return
    for top, folders, names in os.walk(entry):
        folders[:] = [n for n in folders if _shown(n)]
        yield from (os.path.join(top, n) for n in names if _shown(n))


def _contents(paths: list[str]) -> Iterator[pa.Array]:
    """The bytes of files, few at a time if they are large."""
    some, size = [], 0
    for path in paths:
        with open(path.removeprefix("file:"), "rb") as file:
            some.append(file.read())
        size += len(some[-1])
        if size >= CONTENT_BYTES:
            yield pa.array(some, pa.binary())
            some, size = [], 0
    if some or not paths:
        yield pa.array(some, pa.binary())


def write_assets(df: DataFrame, path: str, key: str) -> None:
    """A text file per row below ``<key>=<value>``, from the other column.

    A file costs the same whatever its size, so rows are dealt to all cores by key and not by
    bytes. Spark's writer starts four processes that set access rights for each file of a mounted
    folder; where executors reach the folder by name, tasks write there themselves. A file
    appears under its name once it is whole, and under the same name if its task is run again.
    """
    spark = df.sparkSession
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    folder, dealt = mounted_folder(spark, path), df.repartition(tasks, F.col(key))
    if folder is None:   # tasks move their own files into place, since one after the other takes the driver too long
        dealt.write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    text = [c for c in df.columns if c != key]
    if len(text) != 1 or not isinstance(df.schema[text[0]].dataType, StringType):
        raise ValueError(f"one text column is needed beside {key!r}, not {text}")
    if path_exists(spark, path):
        raise FileExistsError(path)
    job = uuid.uuid4().hex
    dealt = dealt.select(F.col(key).cast("string").alias("k"), F.col(text[0]).alias("t")).sortWithinPartitions("k")
    dealt.mapInArrow(lambda batches: _written_files(batches, folder, key, job), "files long").write.format("noop").mode("overwrite").save()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target).close()


# characters that Spark's writers do not leave in the name of a folder
NOT_IN_NAMES = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def _folder_name(key: str, value: str | None) -> str:
    """``key=value`` as Spark's writers name it."""
    escaped = [NOT_IN_NAMES.sub(lambda m: f"%{ord(m[0]):02X}", part) for part in (key, value or "__HIVE_DEFAULT_PARTITION__")]
    return "=".join(escaped)


def _written_files(batches: Iterator[pa.RecordBatch], folder: str, key: str, job: str) -> Iterator[pa.RecordBatch]:
    """Write rows (k, t), sorted by k: a file per key, a line per row; the number of files."""
    task = TaskContext.get()
    name, trial = f"part-{task.partitionId():05d}-{job}.txt", task.taskAttemptId()
    done, last, file, at = 0, (), None, ""

    def close():
        file.close()
        os.replace(f"{at}/.{name}.{trial}", f"{at}/{name}")
    for batch in batches:
        for value, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if last != (value or None,):     # an empty value has the folder of a missing one
                if file:
                    close()
                last, at, done = (value or None,), f"{folder}/{_folder_name(key, value)}", done + 1
                os.makedirs(at, exist_ok=True)
                file = open(f"{at}/.{name}.{trial}", "wb")
            if text.is_valid:
                file.write(text.as_buffer())
            file.write(b"\n")
    if file:
        close()
    yield pa.RecordBatch.from_pydict({"files": [done]})


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, root: str, key: Mapping[str, str], build: Callable[[], DataFrame]) -> DataFrame:
    """Read a derived table if a finished copy exists, else build and write it.

    The key (dataset, modality, model, mode) names the folder; an unfinished
    write has no ``_SUCCESS`` file and is built again.
    """
    path = "/".join([root.rstrip("/"), *[f"{k}={v}" for k, v in key.items()]])
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_split(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(split).option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows as JSON lines."""
    df.write.mode("append").json(path)


def row_digest(df: DataFrame) -> Column:
    """First 60 bits of the md5 of all columns, in column-name order.

    Each value goes with its length and null has a mark of its own, so no two different
    rows give the same bytes.
    """
    texts = [F.col(c).cast("string") for c in sorted(df.columns)]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("long")


def table_checksum(df: DataFrame) -> DataFrame:
    """Order-free checksum: row count, xor and folded sum of row digests."""
    h = row_digest(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest_xor"),
                  F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0)).alias("digest_sum"))


def file_checksum(assets: DataFrame) -> DataFrame:
    return assets.select("path", F.sha1("content").alias("sha1"))
