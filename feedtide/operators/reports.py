"""Monitoring tables over run history, feed statistics and the loss log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.functions.dates import feed_date
from feedtide.functions.status import reason_label
from feedtide.params import Params

# Thresholds and lengths of the monitoring page.
RATE_OK, RATE_WARN = 80, 50
RATE_LIMITED_WARN = 150
RECENT_RUNS = 20
RECENT_DROPPED = 100

TREND_SERIES = [
    "success", "already_archived", "pending", "error_retry", "error_permanent", "rate_limited",
    "deferred",
]


def _rounded(value: Column) -> Column:
    """Half up, as a whole number."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def run_health(history: DataFrame) -> DataFrame:
    """Success rate and warning flags of every run."""
    attempts = F.col("success") + F.col("error")
    rate = F.when(attempts > 0, _rounded(F.lit(100.0) * F.col("success") / attempts)).otherwise(F.lit(100))
    return history.withColumn("success_rate", rate.cast("bigint")).select(
        "run_id",
        "ts",
        "success",
        "error",
        "success_rate",
        F.when(F.col("success_rate") >= RATE_OK, F.lit("ok"))
        .when(F.col("success_rate") >= RATE_WARN, F.lit("warn"))
        .otherwise(F.lit("bad"))
        .alias("rate_class"),
        F.coalesce("error_retry", F.lit(0)).alias("error_retry"),
        F.coalesce("error_permanent", F.lit(0)).alias("error_permanent"),
        F.coalesce(F.col("error_permanent") > 0, F.lit(False)).alias("permanent_warn"),
        F.coalesce("rate_limited", F.lit(0)).alias("rate_limited"),
        F.coalesce(F.col("rate_limited") > RATE_LIMITED_WARN, F.lit(False)).alias("rate_limited_warn"),
        F.coalesce("deferred", F.lit(0)).alias("deferred"),
    )


def latest_per_source(stats: DataFrame) -> DataFrame:
    """The last statistics row of each source, by an aggregate that is combined on the map side."""
    rest = [c for c in stats.columns if c != "source"]
    return (
        stats.groupBy("source")
        .agg(F.max_by(F.struct(*rest), F.struct("ts", "run_id")).alias("last"))
        .select("source", "last.*")
    )


def coverage_alerts(stats: DataFrame) -> DataFrame:
    """Sources that lost URLs in their latest run."""
    return (
        latest_per_source(stats)
        .filter(F.col("dropped_unarchived_count") > 0)
        .select("source", "run_id", "dropped_unarchived_count")
    )


def _percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(F.lit(1000.0) * part / total + F.lit(0.5)) / F.lit(10.0))


def source_status(stats: DataFrame) -> DataFrame:
    """D3: latest row per source with shares and feed span; `position` puts rotating sources first."""
    latest = latest_per_source(stats).withColumn("exhaustive", F.col("dropped_count").isNull())
    seconds = F.unix_seconds(feed_date(F.col("newest_published_at"))) - F.unix_seconds(
        feed_date(F.col("oldest_published_at"))
    )
    hours = F.when(~F.col("exhaustive"), _rounded(seconds / F.lit(3600.0)))
    return latest.withColumn("_hours", hours).select(
        "source",
        "exhaustive",
        "item_count",
        "new_count",
        _percent(F.col("new_count"), F.col("item_count")).alias("new_pct"),
        "dropped_count",
        _percent(F.col("dropped_count"), F.col("item_count")).alias("dropped_pct"),
        "dropped_unarchived_count",
        F.coalesce("already_archived_count", F.lit(0)).alias("already_archived_count"),
        F.coalesce("rate_limited_count", F.lit(0)).alias("rate_limited_count"),
        "newest_published_at",
        F.when(F.col("_hours") < 48, F.col("_hours"))
        .otherwise(_rounded(F.col("_hours") / F.lit(24.0)))
        .alias("span"),
        F.when(F.col("_hours") < 48, F.lit("h")).when(F.col("_hours").isNotNull(), F.lit("d")).alias("span_unit"),
    ).orderBy("exhaustive", "source")


def run_trend(history: DataFrame) -> DataFrame:
    """The chart series in long form; nothing while there is a single run."""
    runs = history.agg(F.count("*")).scalar()
    filled = history.filter(runs > 1).select(
        "run_id", "ts", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in TREND_SERIES]
    )
    return filled.unpivot(["run_id", "ts"], TREND_SERIES, "series", "n")


def recent_runs(history: DataFrame, dropped_by_run: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """The newest runs with their losses: 0 if none, NULL for a run without id."""
    newest = history.orderBy(F.col("ts").desc(), F.col("run_id").desc_nulls_last()).limit(limit)
    losses = F.when(F.col("run_id") != "", F.coalesce(F.col("dropped_count"), F.lit(0)))
    return (
        newest.join(dropped_by_run, "run_id", "left")
        .select(
            "run_id", "ts", "success", "error_retry", "error_permanent", "already_archived", "pending",
            "rate_limited", "deferred", losses.alias("dropped_count"),
        )
        .orderBy(F.col("ts").desc(), F.col("run_id").desc_nulls_last())
    )


def recent_dropped(dropped: DataFrame, limit: int = RECENT_DROPPED) -> DataFrame:
    """The newest losses with their label, and how many there are in all."""
    total = dropped.agg(F.count("*")).scalar()
    return (
        dropped.orderBy(F.col("ts").desc(), "source", "norm_url")
        .limit(limit)
        .select("ts", "source", "norm_url", reason_label(F.col("reason")).alias("label"), total.alias("total"))
    )


def data_freshness(history: DataFrame, params: Params) -> DataFrame:
    """Age of the last run in minutes (< 60), hours (< 48) or days."""
    last = history.agg(F.max("ts").alias("last_run"))
    age_us = F.unix_micros(params.now()) - F.unix_micros(F.col("last_run"))
    return (
        last.withColumn("minutes", _rounded(age_us / F.lit(60e6)))
        .withColumn("hours", _rounded(F.col("minutes") / F.lit(60.0)))
        .select(
            "last_run",
            F.when(F.col("minutes") < 60, F.col("minutes"))
            .when(F.col("hours") < 48, F.col("hours"))
            .otherwise(_rounded(F.col("hours") / F.lit(24.0)))
            .alias("age"),
            F.when(F.col("minutes") < 60, F.lit("min"))
            .when(F.col("hours") < 48, F.lit("h"))
            .when(F.col("hours").isNotNull(), F.lit("d"))
            .alias("unit"),
        )
    )


def recheck_worklist(dropped: DataFrame, availability: DataFrame) -> DataFrame:
    """Lost URLs still not found captured, i.e. worth another check."""
    found = availability.filter(F.col("archived")).select("norm_url")
    return dropped.select("norm_url").distinct().join(found, "norm_url", "left_anti")
