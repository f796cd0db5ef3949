"""Sinks that make a micro-batch repeatable: whatever a batch writes is named by its id.

A job owns one folder. Its checkpoint is `<root>/checkpoint`, its tables lie beside it, so a job that is called again with
the same folder goes on where it stopped, and batch ids never begin anew over old output.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.sources.state import children, folders, read_small, remove, write_small


def drain(stream: DataFrame, root: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that is available, in as many batches as the source cuts, then stop."""
    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
        .awaitTermination()
    )


def append_to_table(stream: DataFrame, root: str) -> DataFrame:
    """Append-mode stream into parquet files (exactly once, by the file sink's own log)."""
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def write_batch(rows: DataFrame, table: str, batch_id: int, by: str | None = None) -> None:
    """`by`: a column with few values in a batch, whose values later reads ask for."""
    writer = rows.write.mode("overwrite")
    (writer if by is None else writer.partitionBy(by)).parquet(f"{table}/batch={batch_id:012d}")


def read_batches(spark: SparkSession, table: str, schema: str, after: int = -1, below: int | None = None) -> DataFrame:
    """What the finished batches with ids above `after` and below `below` wrote."""
    paths = [path for n, path in folders(spark, table, "batch=") if n > after and (below is None or n < below)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(*paths).drop("batch")


# --- folded tables --------------------------------------------------------------------------------
#
# A table of folds is dealt into buckets by its key. A batch folds its rows into the buckets they belong to and writes only
# those, as `fold=<number>/bucket=<k>`; a reader takes the newest of each bucket. What a fold replaces stays until the next one, so a
# result that was built before it can still be read, and then goes: there are at most two folders for each bucket.


def _folds(spark: SparkSession, table: str, below: int | None = None) -> list[tuple[int, str, list[int]]]:
    """(number, path, buckets) of the finished folds, newest first."""
    found = []
    for number, path in reversed(folders(spark, table, "fold=")):
        marker = read_small(spark, f"{path}/_buckets")
        if marker is not None and (below is None or number < below):
            found.append((number, path, json.loads(marker)))
    return found


def _bucket_of(spark: SparkSession, table: str, key: Sequence[str]) -> Column:
    """The number of buckets is that of the shuffle partitions when the table begins."""
    count = read_small(spark, f"{table}/_count")
    if count is None:
        count = spark.conf.get("spark.sql.shuffle.partitions")
        write_small(spark, f"{table}/_count", count, overwrite=True)
    return F.pmod(F.xxhash64(*key), F.lit(int(count))).cast("int")


def read_folded(spark: SparkSession, table: str, schema: str, only: list[int] | None = None, below: int | None = None) -> DataFrame:
    """The newest rows of every bucket (of the buckets `only`), each read once."""
    taken, paths = set(), []
    for _, path, buckets in _folds(spark, table, below):
        new = {b for b in buckets if b not in taken and (only is None or b in only)}
        taken |= new
        if new:
            there = set(children(spark, path))  # a bucket that was folded to nothing has no folder
            paths += [f"{path}/bucket={b}" for b in sorted(new) if f"bucket={b}" in there]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _write_fold(rows: DataFrame, table: str, number: int, bucket: Column, buckets: list[int]) -> None:
    spark, path = rows.sparkSession, f"{table}/fold={number:012d}"
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    write_small(spark, f"{path}/_buckets", json.dumps(buckets), overwrite=True)
    newer: dict[int, int] = {}
    for _, old, held in _folds(spark, table):
        dead = [b for b in held if newer.get(b, 0) >= 2]
        for b in held:
            newer[b] = newer.get(b, 0) + 1
        if dead and len(dead) == len(held):
            remove(spark, [old])
        elif dead:
            write_small(spark, f"{old}/_buckets", json.dumps([b for b in held if b not in dead]), overwrite=True)
            remove(spark, [f"{old}/bucket={b}" for b in dead])


def fold_batch(delta: DataFrame, table: str, schema: str, key: Sequence[str], fold: Callable[[DataFrame], DataFrame], batch_id: int) -> None:
    """Folds the rows of a batch into the buckets they belong to. A finished batch that is run again changes nothing."""
    spark, number = delta.sparkSession, 2 * batch_id
    if any(n == number for n, _, _ in _folds(spark, table)):
        return
    bucket = _bucket_of(spark, table, key)
    delta = delta.persist()
    touched = sorted(r[0] for r in delta.select(bucket).distinct().collect())  # at most as many as there are buckets
    if touched:
        old = read_folded(spark, table, schema, only=touched, below=number)
        _write_fold(fold(old.unionByName(delta.select(*old.columns))), table, number, bucket, touched)
    delta.unpersist()


def refold(spark: SparkSession, table: str, schema: str, key: Sequence[str], fold: Callable[[DataFrame], DataFrame]) -> None:
    """Folds every bucket anew, for instance to drop what has expired. Not to be run beside the job that writes the table."""
    folds = _folds(spark, table)
    if folds and folds[0][0] % 2 == 0:  # odd numbers are refolds: one after each batch is enough
        buckets = sorted({b for _, _, held in folds for b in held})
        _write_fold(fold(read_folded(spark, table, schema)), table, folds[0][0] + 1, _bucket_of(spark, table, key), buckets)


def sum_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])
