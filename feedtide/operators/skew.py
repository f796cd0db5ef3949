"""Building blocks that stay balanced when one key owns a large share of the rows.

* `join_dimension`: join with a table holding one row per key. A table estimated below the broadcast
  threshold is joined as it is, and Spark broadcasts it. Any other table is salted: a hot key is spread over
  `SALTS` tasks, which AQE can split further.
* `first_k_within`: the first k rows per group. Up to GROUP_LIMIT they are cut down in salted sub-groups before
  the shuffle; beyond it the rows are ranked by `rank_within` and cut by rank.
* `rank_within`: exact row numbers of *all* rows of a group. One range-partitioned sort lays the rows out,
  blocks are counted, and the rank is the block's offset plus the position in the block. No task ever
  holds more than a block.
* `running_within`: exact running sums per group, computed in blocks of the ordering column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedtide.session import durable

SALTS = 32
BLOCK_BITS = 20
GROUP_LIMIT = 1000  # Spark's default bound for cutting groups below a shuffle


def _salt(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _broadcastable(table: DataFrame) -> bool:
    """Whether Spark's own size estimate puts the table below the session's broadcast threshold."""
    if table.isStreaming:
        return False
    session = table._jdf.sparkSession()
    limit = session.sessionState().conf().autoBroadcastJoinThreshold()
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= int(str(limit))


def join_dimension(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join `rows` with a table unique on `keys`; `spread` are columns that vary within a key."""
    if _broadcastable(table):
        return rows.join(table, [*keys], how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("_salt", _salt(spread)).join(salted, [*keys, "_salt"], how).drop("_salt")
    )


def without_keys(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str]
) -> DataFrame:
    """Rows whose key is not in `table`: an anti join that stays balanced for few, hot keys."""
    marked = table.select(*keys).distinct().withColumn("_listed", F.lit(True))
    return join_dimension(rows, marked, keys, spread).filter(F.col("_listed").isNull()).drop("_listed")


def first_k_within(
    rows: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    name: str = "k",
) -> DataFrame:
    """Rows numbered 1..k per group; `order` must be total within a group.

    For k up to GROUP_LIMIT both filters become Spark's WindowGroupLimit, so rows beyond the k-th are dropped before they are
    shuffled. Spark does not do so for larger k, and a window would then gather whole groups: such rows are ranked over one
    range-partitioned sort, in which a hot group is spread over many tasks."""
    if k > GROUP_LIMIT:
        return rank_within(rows, groups, order, name).filter(F.col(name) <= k)
    salted = Window.partitionBy(*groups, "_salt").orderBy(*order)
    final = Window.partitionBy(*groups).orderBy(*order)
    return (
        rows.withColumn("_salt", _salt(spread))
        .withColumn("_sub", F.row_number().over(salted))
        .filter(F.col("_sub") <= k)
        .drop("_salt", "_sub")
        .withColumn(name, F.row_number().over(final).cast("bigint"))
        .filter(F.col(name) <= k)
    )


def rank_within(
    rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "k"
) -> DataFrame:
    """Row number of every row in its group; `order` must be total within the group."""
    keys = [F.col(g).asc() for g in groups]
    laid_out = durable(
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        laid_out.groupBy(*groups, "_block")
        .agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1)
        .drop("_n", "_first")
    )
    return (
        laid_out.join(blocks, [*groups, "_block"])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_block", "_pos", "_shift")
    )


def running_within(
    rows: DataFrame,
    groups: Sequence[str],
    order: str,
    value: Column,
    name: str,
    start: DataFrame | None = None,
) -> DataFrame:
    """Running sum of an integer `value` along the BIGINT column `order`, unique within a group.
    `start` (groups and `start_value`) holds the sums to begin with, 0 where it has no row.

    A block is a range of 2^20 ordering values, hence at most that many rows. Block totals are
    pre-aggregated before the shuffle; only they are scanned per group."""
    marked = rows.withColumn("_value", value.cast("bigint")).withColumn(
        "_block", F.shiftright(F.col(order), BLOCK_BITS)
    )
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        marked.groupBy(*groups, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    if start is not None:
        before = (
            before.join(start, [*groups], "left")
            .withColumn("_before", F.col("_before") + F.coalesce("start_value", F.lit(0)))
            .drop("start_value")
        )
    inside = (
        Window.partitionBy(*groups, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("_inside", F.sum("_value").over(inside))
        .join(before, [*groups, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_before")
    )
