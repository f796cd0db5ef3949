"""State tables.

Keyed state is a directory of immutable versions; a reader takes the newest *finished* one, so a path is
never overwritten while it is read, and a job that dies half-way leaves the previous version in force.
A version is bucketed by its key and remembers how, so a join on the key, with another version or with new rows, does not shuffle it.
A writer claims its version; a second one fails. Logs are appended, partitioned by day so that retention and reports prune.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession, root: str, prefix: str, number: Callable = int, finished: bool = True) -> list[tuple]:
    """(number, path) of the finished folders `<prefix><number>`, ascending (a finished write leaves a _SUCCESS marker)."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return []
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith(prefix) and (not finished or fs.exists(marker(status.getPath(), "_SUCCESS"))):
            found.append((number(name[len(prefix) :]), status.getPath().toString()))
    return sorted(found)


def children(spark: SparkSession, root: str) -> list[str]:
    """Names of what lies in a folder."""
    fs, path = _file_system(spark, root)
    return [status.getPath().getName() for status in fs.listStatus(path)]


def remove(spark: SparkSession, paths: list[str]) -> None:
    for each in paths:
        fs, path = _file_system(spark, each)
        fs.delete(path, True)


def _versions(spark: SparkSession, root: str) -> list[int]:
    return [n for n, _ in folders(spark, root, "v=")]


def _exists(spark: SparkSession, root: str) -> bool:
    fs, path = _file_system(spark, root)
    return fs.exists(path)


class StateConflict(RuntimeError):
    """Another writer has claimed the version."""


def read_small(spark: SparkSession, file: str) -> str | None:
    fs, path = _file_system(spark, file)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_small(spark: SparkSession, file: str, text: str, overwrite: bool) -> bool:
    """Whether the file could be written; without `overwrite` only one of several writers can."""
    fs, path = _file_system(spark, file)
    try:
        stream = fs.create(path, overwrite)
    except Exception:
        if not overwrite and fs.exists(path):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def _path(root: str, version: int) -> str:
    return f"{root}/v={version:012d}"


def _layout(spark: SparkSession, root: str, version: int) -> dict:
    text = read_small(spark, f"{_path(root, version)}/_layout")
    return json.loads(text) if text else {}


def latest_version(spark: SparkSession, root: str, below: int | None = None, writer: str | None = None) -> int | None:
    """The newest finished version: below `below`, and not the one that `writer` wrote itself."""
    found = [v for v in _versions(spark, root) if below is None or v < below]
    if found and writer is not None and _layout(spark, root, found[-1]).get("writer") == writer:
        found.pop()
    return found[-1] if found else None


def scan_state(spark: SparkSession, root: str, schema: str, below: int | None = None, writer: str | None = None) -> DataFrame:
    """S3: the newest version, or an empty table if there is none yet. Corrupt files raise: starting over
    from an empty state would submit everything again. A `writer` that is run again gets what it got the first time."""
    version = latest_version(spark, root, below, writer)
    if version is None:
        return spark.createDataFrame([], schema)
    path, layout = _path(root, version), _layout(spark, root, version)
    if not layout:
        return spark.read.schema(schema).parquet(path)
    # buckets belong to tables: one is declared over the files for as long as it takes to resolve it
    name = f"state_{uuid.uuid4().hex}"
    key, buckets = layout["key"], layout["buckets"]
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_state(df: DataFrame, root: str, key: str, version: int | None = None, writer: str | None = None, buckets: int | None = None, keep: int = 2) -> int:
    """Write a new version, bucketed and sorted by `key`, and return its number; all but the newest `keep` are removed.

    The version is claimed first. A claim of another writer raises `StateConflict`, also when that writer died (`release` gives it up).
    `writer` names the job: run again, it replaces its unfinished attempt, and a version that it finished stays as it is. A given
    `version` is claimed by that number. There are as many buckets as shuffle partitions unless `buckets` says otherwise."""
    spark = df.sparkSession
    newest = latest_version(spark, root)
    if writer is not None and newest is not None and _layout(spark, root, newest).get("writer") == writer:
        return newest
    own = writer or (f"version {version}" if version is not None else uuid.uuid4().hex)
    version = version if version is not None else (newest or 0) + 1
    claim = f"{root}/_claims/{version:012d}"
    if not write_small(spark, claim, own, overwrite=False) and read_small(spark, claim) != own:
        raise StateConflict(f"version {version} of {root} is being written by {read_small(spark, claim)}")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"state_{uuid.uuid4().hex}", _path(root, version)
    laid = df.repartition(buckets, key).sortWithinPartitions(key)
    laid.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    write_small(spark, f"{path}/_layout", json.dumps({"key": key, "buckets": buckets, "writer": own}), overwrite=True)
    old = [v for v in _versions(spark, root) if v <= version][:-keep]
    remove(spark, [_path(root, v) for v in old] + [f"{root}/_claims/{v:012d}" for v in old])
    return version


def release(spark: SparkSession, root: str, version: int) -> None:
    """Gives up the claim of a writer that died, so that another can write the version."""
    if version not in _versions(spark, root):
        remove(spark, [f"{root}/_claims/{version:012d}"])


def append_log(df: DataFrame, root: str, entry: str | None = None) -> None:
    """Append rows with a `ts` to a log, one directory per day. One shuffle keeps the number of files
    per day small without sending a day to a single task.

    With `entry` (the run's id; for all rows of a log or none) the rows are one entry of the log: writing it again replaces it, so a repeated job does
    not double its rows."""
    dated = df.withColumn("run_date", F.to_date("ts"))
    folder, mode = (root, "append") if entry is None else (f"{root}/entry={quote(entry, safe='')}", "overwrite")
    dated.repartition("run_date", F.pmod(F.xxhash64(*df.columns), F.lit(32))).write.mode(mode).partitionBy("run_date").parquet(folder)


def scan_log(spark: SparkSession, root: str, schema: str, since: str | None = None, without: str | None = None) -> DataFrame:
    """S3 for logs: the rows that were appended, from day `since` (YYYY-MM-DD) on, `without` those of one entry. Only the folders of
    these days are read."""
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)
    fs, path = _file_system(spark, root)
    entries = any(s.getPath().getName().startswith("entry=") for s in fs.listStatus(path))
    extra = "entry STRING, run_date DATE" if entries else "run_date DATE"
    rows = spark.read.schema(f"{schema}, {extra}").parquet(root)
    if since is not None:
        rows = rows.filter(F.col("run_date") >= F.lit(since).cast("date"))
    if entries and without is not None:
        rows = rows.filter(F.col("entry") != without)
    return rows.drop("run_date", "entry")


def purge_log(spark: SparkSession, root: str, before: str) -> None:
    """Removes the folders of the days before `before` (YYYY-MM-DD)."""
    if not _exists(spark, root):
        return
    fs, path = _file_system(spark, root)
    tops = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    days = [d for d in tops if d.getName().startswith("run_date=")]
    for entry in tops:
        if entry.getName().startswith("entry="):
            days += [s.getPath() for s in fs.listStatus(entry) if s.getPath().getName().startswith("run_date=")]
    cutoff = dt.date.fromisoformat(before)
    dated = [(d.getName().removeprefix("run_date="), d.toString()) for d in days]
    remove(spark, [where for day, where in dated if day[:4].isdigit() and dt.date.fromisoformat(day) < cutoff])
