"""Removal by age (R1-R4). The cutoff is as_of minus the retention period; the comparison is strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.params import Params


def _expired_state(params: Params) -> Column:
    old = F.col("first_seen").isNull() | (F.col("first_seen") < params.retention_cutoff())
    return ~F.coalesce(F.col("status") == "pending", F.lit(False)) & old


def purge_seen(seen: DataFrame, params: Params) -> DataFrame:
    """The state that stays. Pending rows always stay; a missing first_seen counts as oldest."""
    return seen.filter(~_expired_state(params))


def purged_seen_count(seen: DataFrame, params: Params) -> DataFrame:
    """How many rows `purge_seen` removes."""
    return seen.agg(F.count_if(_expired_state(params)).alias("purged"))


def purge_by_time(rows: DataFrame, params: Params) -> DataFrame:
    """Rows of a log with ts at or after the cutoff. On tables partitioned by run_date the date
    filter prunes whole partitions."""
    kept = rows.filter(F.col("ts") >= params.retention_cutoff())
    if "run_date" in rows.columns:
        kept = kept.filter(F.col("run_date") >= F.to_date(params.retention_cutoff()))
    return kept
