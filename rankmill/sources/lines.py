"""Raw line ingest: text files to lines, appended under a load id, latest load kept."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankmill.functions.text import file_name, is_blank


def read_raw_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(raw_line, source_file) for every non-blank line of the matching files.

    Spark drops a byte order mark and splits at any line end; invalid bytes become U+FFFD. A
    missing folder raises.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return lines.select(
        F.make_valid_utf8("value").alias("raw_line"), file_name().alias("source_file")
    ).filter(~is_blank("raw_line"))


COMMITS = "_commits"  # one file for each load that is whole; readers of data pass over such a folder
_STORED = "raw_line string, source_file string, load_id string, attempt string"


def append_load(lines: DataFrame, store: str, load_id: str) -> bool:
    """Append the lines to the store as one load. Load ids must sort in load order.

    Each attempt writes a folder of its own, which counts once a file that names it is in place, put there by one rename.
    So a load is visible whole or not at all, what a lost attempt left is never read, and a load that is
    there already is not written again (returns false).
    """
    spark = lines.sparkSession
    if load_id in committed_loads(spark, store):
        return False
    attempt = uuid.uuid4().hex
    parts = {"load_id": F.lit(load_id), "attempt": F.lit(attempt)}
    lines.withColumns(parts).write.mode("append").partitionBy(*parts).parquet(store)
    return _commit(spark, store, load_id, attempt)


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def _commit(spark: SparkSession, store: str, load_id: str, attempt: str) -> bool:
    """An empty file that names load and attempt; of several attempts that end at once the first name counts."""
    files, folder = _folder(spark, f"{store}/{COMMITS}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hidden = path(folder, f".{attempt}")
    files.create(hidden, True).close()
    files.rename(hidden, path(folder, f"{quote(load_id, safe='')}@{attempt}"))
    return committed_loads(spark, store)[load_id] == attempt


def committed_loads(spark: SparkSession, store: str) -> dict[str, str]:
    """Load ids and the attempt that counts, in load order, from one listing of names."""
    files, folder = _folder(spark, f"{store}/{COMMITS}")
    if not files.exists(folder):
        return {}
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    found: dict[str, str] = {}
    for load, _, attempt in (name.rpartition("@") for name in sorted(names) if not name.startswith(".")):
        found.setdefault(unquote(load), attempt)
    return dict(sorted(found.items()))


def read_loads(spark: SparkSession, store: str) -> DataFrame:
    """Lines of all whole loads with their load id."""
    attempts = list(committed_loads(spark, store).values())
    loads = spark.read.schema(_STORED).parquet(store)
    return loads.filter(F.col("attempt").isin(attempts)).drop("attempt")


def latest_load(loads: DataFrame, load_id: str = "load_id") -> DataFrame:
    """Rows of the newest load."""
    return loads.filter(F.col(load_id) == loads.agg(F.max(load_id)).scalar())


def _partitions(names: list[str], load_id: str = "load_id") -> dict[str, str]:
    """Load id, with escapes undone, to the partition's name; in load order."""
    pairs = (name.split("=", 1) for name in names if "=" in name)
    return dict(sorted((unquote(value), f"{key}={value}") for key, value in pairs if key == load_id))


def load_folders(spark: SparkSession, store: str) -> dict[str, str]:
    """Load ids of a store and their folders, from one listing of the store's folder; no file is opened."""
    files, folder = _folder(spark, store)
    return _partitions([entry.getPath().getName() for entry in files.listStatus(folder) if entry.isDirectory()])


def read_latest_load(spark: SparkSession, store: str) -> DataFrame:
    """Newest whole load of a store. Its id comes from the names of the store's folders; files of other
    loads and attempts are neither listed nor read."""
    loads = committed_loads(spark, store)
    if not loads:
        raise ValueError(f"no load in {store}")
    newest, attempt = list(loads.items())[-1]
    folder = load_folders(spark, store).get(newest)
    schema = "raw_line string, source_file string"
    if folder is None:  # a load without lines
        lines = spark.createDataFrame([], schema)
    else:
        lines = spark.read.schema(schema).parquet(f"{store.rstrip('/')}/{folder}/attempt={attempt}")
    return lines.withColumn("load_id", F.lit(newest))


def drop_older_loads(spark: SparkSession, table: str, load_id: str = "load_id") -> int:
    """Delete all but the newest load from a table partitioned by load id; returns how many went."""
    loads = _partitions([row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()], load_id)
    old = list(loads)[:-1]
    for name in old:
        value = name.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} DROP PARTITION ({load_id} = '{value}')")
    return len(old)
