"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.session import fresh_path
from feedtide.sources.state import remove

POSITION_BITS = 33  # of monotonically_increasing_id: the row number in its partition


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no later plan reads: what was made of them must be stored, too."""
    for table in tables:
        remove(table.sparkSession, [table.stored_at])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def numbered(rows: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Row numbers from 0 in the given total order, without a task that sees every row.

    One range-partitioned sort, stored; a row's number is its position in its partition plus the rows of
    the partitions before it. The table of partition counts (one row per partition) is what is broadcast.
    """
    laid = store(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_place", POSITION_BITS)
    position = F.col("_place").bitwiseAND((1 << POSITION_BITS) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        laid.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(counts), "_part")
        .withColumn(name, position + F.col("_before"))
        .drop("_part", "_place", "_before")
    )


def bounded_sample(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """At most `limit` rows, those with the smallest hashes of the columns `by`; always the same ones.

    Rows whose hash cannot be among them (but for a chance below 1e-9) are filtered out first, so that what reaches the final sort is
    a few times `limit` however many tasks there are.
    """
    share = 4.0 * limit / max(rows.count(), 1)
    hashed = F.xxhash64(*by)
    if share < 1:
        rows = rows.filter(hashed < int(-(1 << 63) + share * (1 << 64)))
    return rows.orderBy(hashed, *by).limit(limit)
