"""Audit of a submit log against a rolling rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_budget_audit(
    submits: DataFrame, limit: int, window_seconds: int = 60, block_seconds: int | None = None
) -> DataFrame:
    """Submits in the trailing window (both ends inclusive), whether they exceed `limit`, and the wait
    until a slot frees, seen right after the row's own submit.

    `submits` has account, submit_id, ts and kind; answers "already_archived" cost no budget and are left
    out. Time is cut into blocks of at least one window. A submit counts in its own block and is copied as
    context into the next one while it can still matter there, so a busy account is spread over its blocks
    and the result is exact."""
    window_us = window_seconds * 1_000_000
    block_us = max(block_seconds or 0, 10 * window_seconds) * 1_000_000
    at = F.unix_micros(F.col("ts"))
    home, last = at - F.pmod(at, F.lit(block_us)), at + window_us - F.pmod(at + window_us, F.lit(block_us))
    placed = (
        submits.filter(F.col("kind") != "already_archived")
        .withColumn("at_us", at)
        .withColumn("home", home)
        .withColumn("block", F.explode(F.sequence(home, last, F.lit(block_us).cast("bigint"))))
    )
    # Frames that begin with the block are summed up row by row; a frame that moves at both ends would be counted anew for every row.
    # The latest submits come first: `later` of them follow the row, and the row asks again where its window begins.
    block = Window.partitionBy("account", "block")
    latest_first = block.orderBy(F.desc("at_us")).rangeBetween(Window.unboundedPreceding, -1)
    asked = placed.withColumn("later", F.count("*").over(latest_first)).withColumn("asks", F.explode(F.array(F.lit(False), F.lit(True))))
    asked = asked.filter(~F.col("asks") | (F.col("block") == F.col("home")))
    asked = asked.withColumn("place", F.when(F.col("asks"), F.col("at_us") - window_us).otherwise(F.col("at_us")))
    down_to = block.orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    submit_us = F.when(~F.col("asks"), F.col("at_us"))
    waited = F.col("at_us") - F.col("oldest_us")
    wait = F.greatest(F.lit(0.0), F.lit(float(window_seconds)) - waited / F.lit(1_000_000.0) + F.lit(0.1))
    return (
        asked.withColumn("in_window", F.count(submit_us).over(down_to) - F.col("later"))
        .withColumn("oldest_us", F.min(submit_us).over(down_to))
        .filter("asks")
        .select(
            "account",
            "submit_id",
            "ts",
            "in_window",
            (F.col("in_window") > limit).alias("over_limit"),
            F.when(F.col("in_window") < limit, F.lit(0.0)).otherwise(wait).alias("wait_seconds"),
        )
    )
